"""Key paths with offsets from configuration text: JSON, YAML, ini, TOML, env, properties and XML, whole or as an excerpt (problem 6).

Nothing is refused: what is not of these formats ends the open path, and reading goes on behind it.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Setting(NamedTuple):
    """path: names from the outermost, list elements by number; start and end: the value in the text, without quotes."""

    path: tuple[str, ...]
    start: int
    end: int


_FLOW = re.compile(r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/|(?<!\S)\#[^\n]*)|(?P<str>"(?:[^"\\\n]|\\.)*(?:"|\Z)|'(?:[^'\\\n]|\\.|'')*(?:'|\Z))|(?P<punct>[{}\[\]:,])|(?P<plain>[^\s,\[\]{}:"'][^,\[\]{}\n"']*?(?=\s*(?:[,\[\]{}\n]|:\s|:$|\s\#|\Z)))|(?P<other>.)""", re.S)
_SCALAR = re.compile(r"-?\d[\d.eE+\-]*|true|false|null")
_NAMES, _VALUES = ("name", "key", "variable", "var"), ("value", "val", "default", "secret")
_LINE = re.compile(r"""(?P<dashes>(?:-[ \t]+|-$)*)(?:(?P<key>"(?:[^"\\\n]|\\.)*"|'[^'\n]*'|[\w.$@/][\w.$@/\- ]*?)[ \t]*:(?=[ \t]|$)[ \t]*)?(?P<rest>.*)""")
_INI = re.compile(r"""(?:export[ \t]+)?(?P<key>"[^"\n]+"|'[^'\n]+'|[A-Za-z_][\w.\-]*(?: [\w.\-]+)*)[ \t]*=(?![=>])[ \t]*(?P<rest>.*)""")
_SECTION = re.compile(r"\[{1,2}[ \t]*(?P<name>[\w.\-:/ \"']+?)[ \t]*\]{1,2}[ \t]*(?:[#;].*)?$")
_BLOCK = re.compile(r"[|>][+\-\d]*[ \t]*(?:#.*)?$")
_TAGS = re.compile(r"(?:[&!][\w!./\-:]*[ \t]*)+")
_QUOTED = re.compile(r"""(?:"(?P<d>(?:[^"\\]|\\.)*)"|'(?P<s>(?:[^']|'')*)')[ \t]*(?:,|[#;].*)?$""", re.S)


def _bare(token: str) -> str:
    return token[1:-1] if len(token) > 1 and token[0] == token[-1] and token[0] in "\"'" else token.strip("\"'")


class _Node:
    """An open mapping or list: its path, the key or number that comes next, and its name and value fields."""

    def __init__(self, path: tuple, is_list: bool):
        self.path, self.is_list, self.key, self.count, self.name, self.held = path, is_list, None, 0, None, []

    def child(self) -> tuple:
        if self.is_list:
            return (*self.path, str(self.count))
        return self.path if self.key is None else (*self.path, self.key)

    def scalar(self, out: list, text: str, start: int, end: int) -> None:
        key = self.key.lower() if self.key and not self.is_list else ""
        if key in _NAMES:
            self.name = text[start:end]
        if key in _VALUES:
            self.held.append((key, start, end))
        elif self.is_list or self.key is not None:
            out.append(Setting(self.child(), start, end))

    def close(self, out: list) -> None:
        for key, start, end in self.held:
            out.append(Setting((*self.path, *([self.name] if self.name else []), key), start, end))
        self.held = []


def flow(text: str, at: int = 0, path: tuple = (), plain: bool = False) -> tuple[list[Setting], int]:
    """(settings, end) of JSON from ``at``. ``plain``: bare words count, and the reading ends with the brackets it began with."""
    out: list[Setting] = []
    stack = [_Node(path, False)]
    word: tuple[str, int, int] | None = None

    def settle() -> None:
        nonlocal word
        if word:
            stack[-1].scalar(out, text, word[1], word[2])
        word = None

    while m := _FLOW.match(text, at):
        kind, token, at = m.lastgroup, m[0], m.end()
        if kind == "space":
            continue
        if kind == "punct":
            top = stack[-1]
            if token == ":":
                if word and not top.is_list:
                    top.key = word[0]
                word = None
            elif token in "{[":
                word = None
                stack.append(_Node(top.child(), token == "["))
            else:
                settle()
                if token == ",":
                    top.count += 1
                    top.key = None
                else:
                    top.close(out)
                    if len(stack) > 1:
                        stack.pop()
                    if plain and len(stack) == 1:
                        return out, at
        elif kind == "str" or kind == "plain" and (plain or _SCALAR.fullmatch(token)):
            settle()
            start = m.start() + (kind == "str")
            word = (_bare(token), start, at - (kind == "str" and len(token) > 1 and token[-1] == token[0]))
        else:
            settle()
            for node in stack:
                node.close(out)
            if plain:
                break
            stack = [_Node(path, False)]
    settle()
    for node in stack:
        node.close(out)
    return out, at


def lines(text: str) -> list[Setting]:
    """Settings of the lines of YAML, ini and env text; a line of another kind ends what is open."""
    out: list[Setting] = []
    stack: list[tuple[int, _Node]] = []
    section: tuple = ()
    unsure: list[Setting] = []  # assignments of lists before any section: settings unless the text is a program
    code = False
    spans, at = [], 0
    for row in text.split("\n"):
        spans.append((at, at + len(row.rstrip("\r"))))
        at += len(row) + 1
    k, n = 0, len(spans)

    def leave(column: int) -> None:
        while stack and stack[-1][0] > column:
            stack.pop()[1].close(out)

    def value(node: _Node, start: int, end: int, column: int, k: int) -> int:
        """Takes the value at ``start``; gives the line to go on with."""
        if m := _TAGS.match(text, start, end):
            start = m.end()
        rest = text[start:end]
        if not rest or rest.startswith("#"):
            return k + 1
        if _BLOCK.match(rest):
            k += 1
            inside = []
            while k < n:
                a, b = spans[k]
                body = text[a:b]
                if body.strip():
                    if len(body) - len(body.lstrip()) <= column:
                        break
                    inside.append((a + len(body) - len(body.lstrip()), a + len(body.rstrip())))
                k += 1
            if inside and not any(" " in text[a:b] for a, b in inside):
                inside = [(inside[0][0], inside[-1][1])]
            for a, b in inside:
                node.scalar(out, text, a, b)
            return k
        if rest[0] in "[{" and not rest.startswith(("{{", "${")):
            got, stop = flow(text, start, node.child(), True)
            out.extend(got)
            while k < n and spans[k][1] < stop:
                k += 1
            return k + 1
        if rest[0] in "\"'":
            m = _QUOTED.match(rest)
            if m:
                part = "d" if m["d"] is not None else "s"
                node.scalar(out, text, start + m.start(part), start + m.end(part))
            return k + 1
        body = re.split(r"[ \t]+[#;]", rest, maxsplit=1)[0].rstrip().rstrip(",")
        node.scalar(out, text, start, start + len(body))
        return k + 1

    while k < n:
        a, b = spans[k]
        row = text[a:b]
        bare = row.strip()
        if not bare or bare[0] in "#;" or bare in ("---", "..."):
            k += 1
            continue
        column = len(row) - len(row.lstrip())
        if column == 0 and (m := _SECTION.match(row)):
            leave(-1)
            section = tuple(x.strip(" \"'") for x in m["name"].split("."))
            k += 1
            continue
        m = _INI.match(text, a + column, b)
        if m and (section or " " not in _bare(m["key"]) and not bare.endswith((";", "{", "("))):
            leave(-1)
            node = _Node(section, False)
            node.key = _bare(m["key"])
            had = len(out)
            k = value(node, m.start("rest"), b, column, k)
            node.close(out)
            if not section and m["rest"].startswith(("[", "{")):
                unsure += out[had:]
                del out[had:]
            continue
        m = _LINE.match(text, a + column, b)
        if not m["dashes"] and m["key"] is None:
            top = stack[-1] if stack else None
            if top and column > top[0] and top[1].key is not None and " " not in bare:  # the value of the key above
                k = value(top[1], a + column, b, column, k)
                continue
            leave(-1)
            section = ()
            code = True
            k += 1
            continue
        section = ()
        at_column = column
        for dash in re.finditer(r"-[ \t]*", m["dashes"]):
            here = column + dash.start()
            leave(here)
            if not (stack and stack[-1][0] == here and stack[-1][1].is_list):
                if stack and stack[-1][0] == here and stack[-1][1].key is None:
                    stack.pop()[1].close(out)
                stack.append((here, _Node(stack[-1][1].child() if stack else (), True)))
            else:
                stack[-1][1].count += 1
            at_column = column + dash.end()
        if m["key"] is None:
            k = value(stack[-1][1], m.start("rest"), b, at_column - 1, k)
            continue
        leave(at_column)
        if stack and stack[-1][0] == at_column and stack[-1][1].is_list and not m["dashes"]:
            stack.pop()[1].close(out)
        if not (stack and stack[-1][0] == at_column and not stack[-1][1].is_list):
            stack.append((at_column, _Node(stack[-1][1].child() if stack else (), False)))
        stack[-1][1].key = _bare(m["key"])
        k = value(stack[-1][1], m.start("rest"), b, at_column, k)
    leave(-1)
    return out if code else out + unsure


_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<(?P<end>/)?(?P<name>[A-Za-z_][\w:.\-]*)(?P<attributes>(?:\s++[\w:.\-]++\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'))*+)\s*+(?P<alone>/)?>""", re.S)
_ATTRIBUTE = re.compile(r"""(?P<name>[\w:.\-]+)\s*=\s*(?:"(?P<d>[^"]*)"|'(?P<s>[^']*)')""")


def markup(text: str) -> list[Setting]:
    """Settings of XML: the text of an element without children below its names, and attributes; ``name="x" value="y"`` names y."""
    out: list[Setting] = []
    path: list[str] = []
    begun = -1  # where the text of the innermost element begins, while it has no child
    for m in _TAG.finditer(text):
        if m["name"] is None:
            continue
        if m["end"]:
            if m["name"] in path:
                body = text[begun : m.start()] if begun >= 0 and path[-1] == m["name"] else ""
                if body.strip():
                    inner = re.fullmatch(r"\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*", body, re.S)
                    out.append(Setting(tuple(path), begun + inner.start(1), begun + inner.end(1)))
                while path.pop() != m["name"]:
                    pass
            begun = -1
            continue
        named, held = None, []
        for x in _ATTRIBUTE.finditer(text, m.start("attributes"), m.end("attributes")):
            part = "d" if x["d"] is not None else "s"
            if x["name"].lower() in _NAMES:
                named = x[part]
            held.append((x["name"], x.start(part), x.end(part)))
        for name, start, end in held:
            if name.lower() not in _NAMES:
                out.append(Setting((*path, m["name"], *([named] if named and name.lower() in _VALUES else []), name), start, end))
        if not m["alone"]:
            path.append(m["name"])
            begun = m.end()
        else:
            begun = -1
    return out


def settings(text: str) -> list[Setting]:
    """The settings of a text in order; of two readings of a value the one with the longer path stands."""
    best: dict[int, Setting] = {}
    for s in [*flow(text)[0], *lines(text), *(markup(text) if "</" in text or "/>" in text else ())]:
        if s.start not in best or len(s.path) > len(best[s.start].path):
            best[s.start] = s
    return sorted(best.values(), key=lambda s: s.start)
