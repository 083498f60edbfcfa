"""Units and imports taken from source text: signatures by pattern, bodies by matched braces or indents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import lexing

_STARTS = {
    "py": re.compile(r"^(?P<indent>[ \t]*)(?P<async>async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*\(", re.M),
    "js": re.compile(r"^(?P<indent>[ \t]*)(?:export[ \t]+)?(?:default[ \t]+)?(?:(?P<async>async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>\w+)[ \t]*(?:<[^>\n]*>)?\(|(?:const|let|var)[ \t]+(?P<arrow>\w+)[ \t]*=[ \t]*(?P<async2>async[ \t]*)?\((?=[^;\n]*=>)|(?P<async3>async[ \t]+)?(?P<method>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|constructor\b)\w+)[ \t]*\((?=[^;\n]*\)[^;\n=]*\{[ \t\r]*$))", re.M),
    "java": re.compile(r"^(?P<indent>[ \t]*)(?:(?:public|private|protected|static|final|abstract|synchronized)[ \t]+)+(?:<[^>\n]+>[ \t]*)?[\w.<>\[\], ?]+[ \t]+(?P<name>\w+)[ \t]*\(", re.M),
    "go": re.compile(r"^(?P<indent>)func[ \t]+(?:\([^)\n]*\)[ \t]*)?(?P<name>\w+)[ \t]*(?:\[[^\]\n]*\])?\(", re.M),
}
_STARTS["ts"] = _STARTS["js"]
_CLASS = re.compile(r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:(?:public|private|protected|static|final|abstract)[ \t]+)*class[ \t]+(\w+)", re.M)


def _close(code: str, at: int, opens: str) -> int:
    m = re.compile(re.escape(opens)).search(code, at)
    return lexing.closing(code, m.start()) if m else -1


def units_of(path: str, text: str) -> list[tuple[str, str, int, int, bool]]:
    """(name, kind, first line, last line, is_async) of the functions of a text; methods are named after their class."""
    lang = lexing.language(path)
    starts = _STARTS.get(lang)
    if starts is None or not text:
        return []
    code = lexing.blanked(text, lexing.spans(text, lang))
    line_of = lambda at: code.count("\n", 0, at) + 1
    classes = []
    for m in _CLASS.finditer(code):
        if lang == "py":
            indent = len(m[0]) - len(m[0].lstrip())
            after = re.compile(rf"^(?=[ \t]{{0,{indent}}}\S)", re.M).search(code, m.end() + 1)
            classes.append((m[1], m.start(), after.start() if after else len(code)))
        else:
            end = _close(code, m.end(), "{")
            classes.append((m[1], m.start(), end if end > 0 else len(code)))
    out = []
    for m in starts.finditer(code):
        g = m.groupdict()
        name = g.get("name") or g.get("arrow") or g.get("method")
        params = lexing.closing(code, m.end() - 1)
        if params < 0:
            continue
        if lang == "py":
            head = code.find(":", params)
            if head < 0:
                continue
            begin = code.find("\n", head)
            after = re.compile(rf"^(?=[ \t]{{0,{len(g['indent'])}}}\S)", re.M).search(code, begin + 1) if begin >= 0 else None
            end = after.start() if after else len(code)
            last = line_of(len(code[:end].rstrip()))
        else:
            brace = re.compile(r"[{;]").search(code, params)
            if brace is None or brace[0] == ";" and not g.get("arrow"):
                continue
            end = lexing.closing(code, brace.start()) if brace[0] == "{" else brace.end()
            if end < 0:
                continue
            last = line_of(end - 1)
        at = m.start() + len(g["indent"])
        owner = [c for c, a, b in classes if a < at < b]
        method = bool(owner) and (lang in ("java", "py") or bool(g.get("method")))
        if g.get("method") and not owner:
            continue
        out.append((f"{owner[-1]}.{name}" if method else name, "method" if method else "function", line_of(at), last, any(g.get(k) for k in ("async", "async2", "async3"))))
    return out


UNITS = "file_path string, name string, kind string, start_line long, end_line long, is_async boolean"


def units(contents: DataFrame) -> DataFrame:
    """The functions of every text of (path, content); partitions are worked apart, nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *u) for p, t in zip(b["path"], b["content"]) for u in units_of(p, t)]
            yield pd.DataFrame(rows, columns=["file_path", "name", "kind", "start_line", "end_line", "is_async"])

    return contents.filter(F.col("path").isNotNull() & F.col("content").isNotNull()).select("path", "content").mapInPandas(run, UNITS)


#: Branches of a parsed script, besides the operators: if, the conditional, loops, cases and catches. Fixed values.
_BRANCHES = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?\?(?!=)|\?\.(?!\d)|\?(?![?.:,)=>\]])")
_CALLS = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*(?:\s*\??\.\s*[A-Za-z_$][\w$]*)*))\s*(?:<[\w\s,.\[\]|]*>)?\(")
_TYPES = re.compile(r"[:<|&,]\s*([A-Z][\w$]*(?:\.[\w$]+)*)|\b(?:as|extends|implements|satisfies)\s+([A-Z][\w$]*)")
_NO_CALL = frozenset("if for while switch catch return function await typeof new super import".split())


def measures(code: str) -> tuple[int, list[str], list[str]]:
    """(cyclomatic complexity, first thirty calls, first thirty type names) of blanked script code: one more than its branches."""
    calls = [re.sub(r"\s", "", m[1]) for m in _CALLS.finditer(code)]
    types = [m[1] or m[2] for m in _TYPES.finditer(code)]
    first = lambda found: list(dict.fromkeys(found))[:30]
    return 1 + len(_BRANCHES.findall(code)), first(c for c in calls if c not in _NO_CALL and len(c) < 80), first(t for t in types if len(t) < 60)


MEASURED = "file_path string, name string, start_line long, complexity long, calls array<string>, types array<string>"


def measured(contents: DataFrame) -> DataFrame:
    """(file_path, name, start_line, complexity, calls, types) of every function of script texts, strings and comments left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"]):
                code = lexing.blanked(text, lexing.spans(text, lexing.language(path))).split("\n")
                for name, _, first, last, _ in units_of(path, text):
                    rows.append((path, name, first, *measures("\n".join(code[first - 1 : last]).split("(", 1)[-1])))
            yield pd.DataFrame(rows, columns=["file_path", "name", "start_line", "complexity", "calls", "types"])

    scripts = contents.filter(F.col("path").rlike(r"\.(js|ts|jsx|tsx)$") & F.col("content").isNotNull())
    return scripts.select("path", "content").mapInPandas(run, MEASURED)


def tree(paths: DataFrame, depth: int) -> DataFrame:
    """(path, parent, level, kind, files): the directory tree as a flat table, down to ``depth`` levels.

    ``files`` counts the files below a directory; a file is a node of its own with the count 1.
    """
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    nodes = paths.select("path", F.explode(F.expr("sequence(1, size(split(regexp_replace(path, '^/', ''), '/')))")).alias("level"), F.size(parts).alias("n")).filter(F.col("level") <= depth)
    name = F.expr("array_join(slice(split(regexp_replace(path, '^/', ''), '/'), 1, level), '/')")
    parent = F.expr("array_join(slice(split(regexp_replace(path, '^/', ''), '/'), 1, level - 1), '/')")
    kind = F.when(F.col("level") == F.col("n"), "file").otherwise("directory")
    return nodes.select(name.alias("node"), parent.alias("parent"), "level", kind.alias("kind")).groupBy("node", "parent", "level", "kind").agg(F.count(F.lit(1)).alias("files"))
