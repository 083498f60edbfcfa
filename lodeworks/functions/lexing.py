"""A string- and comment-aware lexer for several languages, shared by operators over source text."""

from __future__ import annotations

import re
from typing import NamedTuple


class Span(NamedTuple):
    """A comment or string literal: kind is ``line``, ``block`` or ``string``; ``closed`` is False at a missing end."""

    kind: str
    start: int
    end: int
    closed: bool


_C_STRINGS = r"""(?P<string>"(?:[^"\\\n]|\\.|\\\n)*(?P<e1>")?|'(?:[^'\\\n]|\\.|\\\n)*(?P<e2>')?"""
_PATTERNS = {
    "py": r"""(?P<line>\#[^\n]*)|(?P<string>(?<!\w)[rRbBuUfFtT]{0,2}(?:\"{3}(?:[^"\\]|\\.|"(?!""))*(?P<e1>\"{3})?|'{3}(?:[^'\\]|\\.|'(?!''))*(?P<e2>'{3})?|"(?:[^"\\\n]|\\.)*(?P<e3>")?|'(?:[^'\\\n]|\\.)*(?P<e4>')?)|\"{3}(?:[^"\\]|\\.|"(?!""))*(?P<e5>\"{3})?|"(?:[^"\\\n]|\\.)*(?P<e6>")?|'(?:[^'\\\n]|\\.)*(?P<e7>')?)""",
    "java": r"(?P<line>//[^\n]*)|(?P<block>/\*(?:[^*]|\*(?!/))*(?P<e0>\*/)?)|(?P<string>\"{3}(?:[^\"\\]|\\.|\"(?!\"\"))*(?P<e3>\"{3})?|" + _C_STRINGS.replace("(?P<string>", "", 1) + ")",
    "go": r"(?P<line>//[^\n]*)|(?P<block>/\*(?:[^*]|\*(?!/))*(?P<e0>\*/)?)|" + _C_STRINGS + r"|`[^`]*(?P<e3>`)?)",
    "js": r"(?P<line>//[^\n]*)|(?P<block>/\*(?:[^*]|\*(?!/))*(?P<e0>\*/)?)|" + _C_STRINGS + r"|`(?:[^`\\]|\\.)*(?P<e3>`)?)|(?P<slash>/(?![/*]))",
}
_PATTERNS["ts"] = _PATTERNS["js"]
_LEXERS = {k: re.compile(p, re.S) for k, p in _PATTERNS.items()}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: What may stand before a slash that begins a regular expression rather than a division.
_BEFORE_REGEX = re.compile(r"(?:^|[=(,;:!&|?{}\[+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else))\s*$")


def language(path: str) -> str:
    """The extension that names the language, in lower case; none gives the empty string."""
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def spans(text: str, lang: str) -> list[Span]:
    """Comments and strings of a text in order. Regular expressions of JavaScript count as strings; an unknown language gives none."""
    lexer, out, at = _LEXERS.get(lang), [], 0
    if lexer is None:
        return out
    while m := lexer.search(text, at):
        kind, at = m.lastgroup, m.end()
        if m.group("line") is not None:
            out.append(Span("line", *m.span(), True))
        elif "slash" in m.re.groupindex and m.group("slash"):
            if _BEFORE_REGEX.search(text, max(0, m.start() - 40), m.start()) and (r := _REGEX.match(text, m.start())):
                out.append(Span("string", r.start(), r.end(), True))
                at = r.end()
        else:
            kind = "block" if "block" in m.re.groupindex and m.group("block") is not None else "string"
            ends = [g for g in m.re.groupindex if g[0] == "e" and g[1:].isdigit()]
            out.append(Span(kind, *m.span(), any(m.group(g) is not None for g in ends)))
    return out


def blanked(text: str, found: list[Span]) -> str:
    """The text with comments and strings replaced by spaces, line breaks kept, so that what is left is code."""
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], re.sub(r"[^\n]", " ", text[s.start : s.end])]
        at = s.end
    return "".join([*out, text[at:]])


_BRACKET = re.compile(r"[(){}\[\]]")


def closing(code: str, at: int) -> int:
    """Position after the bracket that closes the one at ``at`` in blanked code, or -1 where none does."""
    depth = 0
    for m in _BRACKET.finditer(code, at):
        depth += 1 if m[0] in "({[" else -1
        if depth == 0:
            return m.end()
    return -1
