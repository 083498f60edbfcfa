"""Functions and methods paired with their documentation (problem 7).

Each file is lexed once. From the line on which a function's signature begins, braces (or indentation in Python)
delimit its code; documentation is the docstring at the head of the body, or the comment that ends right above,
with only annotations and tool directives between. What is left of it after tags, directives, marks, dead code and
the function's own name must be prose.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import lexing

MIN_WORDS = 5
_DIRECTIVE = re.compile(
    r"(?i)^\W*(?:eslint|prettier-|tslint|jshint|jslint|istanbul|c8 ignore|v8 ignore|@ts-|@flow|pylint|noqa|type:|mypy|pyright|flake8|fmt:|yapf|isort|black|ruff|pragma|nosec|nolint|go:|\+build|nosonar|checkstyle|spotbugs|noinspection|biome-|stylelint|codespell|coverage:|region\b|endregion\b|sourcery|deno-lint|webpack|vite-|@vite|lint:|lint-|formatter:|@formatter|cspell|pytype)"
)
_TODO = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|hack|tbd|bug)\b")
_TAG = re.compile(r"^\s*(?:[@\\][A-Za-z]\w*|:(?:param|type|returns?|rtype|raises?|arg|args|keyword|var|ivar|cvar)\b)")
_SECTION = re.compile(r"(?i)^\s*(?:args|arguments|parameters|params|returns?|yields?|raises?|throws|keyword args|keyword arguments|other parameters|attributes|examples?|see also|todo)\s*:?\s*$")
_RULE = re.compile(r"^\s*[-=~*#_/+.]{3,}\s*$")
_CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:const|let|var|def|func|return|import|from|class|if|for|while|public|private|elif|else|try|except|raise|throw|await|async def|package|@\w+)\b[^.!?]*[=({:;\[]|^\s*[\w.\[\]\"']+\s*(?::?=|[+\-*/]=)\s*\S|^\s*[\w.]+\([^)]*\)\s*;?\s*$|^\s*return\b[^.!?]*$|=>|^\s*</?\w+[^>]*>\s*$"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_IDENT = re.compile(r"[A-Za-z_]\w*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def name_words(name: str) -> set[str]:
    """The function's own name, whole and in its words, in lower case. The class before the dot is not part of it."""
    last = (name or "").rsplit(".", 1)[-1]
    return {last.lower(), (name or "").lower(), *(w.lower() for w in _PART.findall(last))}


def prose(lines: list[str]) -> list[str]:
    """Documentation lines without tag entries, sections of them, rules, marks, directives and dead code."""
    out, skip = [], ""
    for line in lines:
        if not line.strip():
            skip = "" if skip == "tag" else skip
            continue
        indent = len(line) - len(line.lstrip())
        if isinstance(skip, int) and indent > skip:
            continue
        if skip == "tag" and not _TAG.match(line) and indent > 0 and line[:1] == " " and indent >= 2:
            continue
        skip = ""
        if _TAG.match(line):
            skip = "tag"
        elif _SECTION.match(line):
            skip = indent
        elif not (_RULE.match(line) or _TODO.match(line) or _DIRECTIVE.match(line) or _CODE.search(line)):
            out.append(line.strip())
    return out


def word_count(lines: list[str], name: str) -> int:
    """Words of prose that are not the function's own name."""
    own = name_words(name)
    text = " ".join(prose(lines))
    return sum(1 for w in _WORD.findall(_IDENT.sub(lambda m: " " if m[0].lower() in own or "_" in m[0] else m[0], text)) if w.lower() not in own)


def _comment_lines(text: str) -> list[str]:
    """The text of a comment, its marks taken off, line by line with the inner indent kept."""
    body = re.sub(r"^/\*+!?|\*+/\s*$", "", text.replace("\r", ""))
    rows = [re.sub(r"^\s*(?:\*(?!/)|//+!?|#+!?)? ?", "", r, count=1) for r in body.split("\n")]
    return [r.rstrip() for r in rows]


def _string_lines(literal: str) -> list[str]:
    """The lines of a docstring with their common indent taken off."""
    body = re.sub(r"^[rRuU]*(\"{3}|'{3}|\"|')", "", literal.replace("\r", ""))
    body = re.sub(r"(\"{3}|'{3}|\"|')$", "", body)
    rows = body.split("\n")
    least = min((len(r) - len(r.lstrip()) for r in rows[1:] if r.strip()), default=0)
    return [rows[0].strip(), *(r[least:].rstrip() for r in rows[1:])]


class Source:
    """A lexed file that answers for the function on a given line."""

    def __init__(self, path: str, text: str):
        self.lang, self.text = lexing.language(path), text
        self.spans = lexing.spans(text, self.lang)
        self.code = lexing.blanked(text, self.spans)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.at = {s.start: s for s in self.spans}
        self.ending = {}
        for s in self.spans:
            if s.kind != "string":
                self.ending[self.line_of(max(s.start, s.end - 1))] = s

    def line_of(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def row(self, line: int) -> tuple[int, int]:
        return self.starts[line - 1], self.starts[line] if line < len(self.starts) else len(self.text)

    def _code_of(self, line: int) -> str:
        a, b = self.row(line)
        return self.code[a:b].strip()

    def extent(self, line: int) -> tuple[int, int, int]:
        """(start, head of body, end) of the function whose signature begins on ``line``."""
        start, _ = self.row(line)
        if self.lang == "py":
            at, depth = start, 0
            for m in re.compile(r"[(\[{]|[)\]}]|:").finditer(self.code, start):
                depth += (m[0] in "([{") - (m[0] in ")]}")
                if m[0] == ":" and depth == 0:
                    at = m.end()
                    break
            else:
                return start, len(self.text), len(self.text)
            indent = len(self.text[start:]) - len(self.text[start:].lstrip(" \t"))
            end = self.row(self.line_of(at))[1]
            while end < len(self.text):
                n = self.line_of(end)
                a, b = self.row(n)
                if self.code[a:b].strip() and len(self.code[a:b]) - len(self.code[a:b].lstrip(" \t")) <= indent:
                    break
                end = b
            return start, at, end
        at = start
        while True:  # parameter lists and types are stepped over as wholes
            m = re.compile(r"[({\[;]|=>").search(self.code, at)
            if m is None or m[0] == ";":
                return start, m.end() if m else len(self.text), m.end() if m else len(self.text)
            if m[0] == "=>":
                rest = re.compile(r"\s*").match(self.code, m.end()).end()
                if self.code[rest : rest + 1] != "{":
                    stop = re.compile(r"[;\n]").search(self.code, rest)
                    return start, m.end(), stop.end() if stop else len(self.text)
                at = rest
                continue
            end = lexing.closing(self.code, m.start())
            if m[0] == "{":
                return start, m.end(), end if end > 0 else len(self.text)
            if end < 0:
                return start, len(self.text), len(self.text)
            at = end

    def docstring(self, head: int) -> list[str]:
        """The lines of a docstring that is the first statement after ``head``."""
        at = head
        while at < len(self.text):
            if self.text[at].isspace():
                at += 1
            elif (s := self.at.get(at)) and s.kind == "line":
                at = s.end
            elif s and s.kind == "string" and re.match(r"[rRuU]?[\"']", self.text[at : at + 2]):
                rest = self.code[s.end : self.row(self.line_of(max(s.start, s.end - 1)))[1]].strip()
                return _string_lines(self.text[s.start : s.end]) if not rest or rest[0] == ";" else []
            else:
                return []
        return []

    def above(self, line: int) -> list[str]:
        """The lines of the comment that ends right above ``line``, past annotations and directives."""
        n = line - 1
        while n >= 1:
            a, b = self.row(n)
            raw = self.text[a:b].strip()
            if not raw:
                return []
            code = self._code_of(n)
            if code:
                if code[0] == "@" and self.lang != "go":
                    n -= 1
                    continue
                if code[0] in ")]}\"'" and (up := self._annotation_above(n)):
                    n = up - 1
                    continue
                return []
            s = self.ending.get(n)
            if s is None:
                return []
            if s.kind == "block":
                first = self.line_of(s.start)
                if self.code[self.row(first)[0] : s.start].strip():
                    return []
                rows = _comment_lines(self.text[s.start : s.end])
                if all(not r.strip() or _DIRECTIVE.match(r) for r in rows):
                    n = first - 1
                    continue
                return rows
            rows = []
            while n >= 1 and (s := self.ending.get(n)) and s.kind == "line" and not self._code_of(n):
                rows[:0] = _comment_lines(self.text[s.start : s.end])
                n -= 1
            rows_left = [r for r in rows if not _DIRECTIVE.match(r)]
            if rows_left:
                return rows_left
        return []

    def _annotation_above(self, n: int) -> int:
        """The line on which an annotation begins whose argument list closes on line ``n``, or 0: its brackets are counted back."""
        depth = 0
        for k in range(n, 0, -1):
            code = self._code_of(k)
            for c in reversed(code):
                depth += (c in ")]}") - (c in "([{")
                if depth <= 0 and c in "([{":
                    return k if depth == 0 and code.startswith("@") else 0
            if depth <= 0 and code:
                return 0
        return 0

    def documentation(self, line: int) -> tuple[str, list[str]]:
        """(kind, lines) of the documentation of the function on ``line``; kind is empty where there is none."""
        if not 1 <= line <= len(self.starts):
            return "", []
        if self.lang == "py" and (rows := self.docstring(self.extent(line)[1])):
            return "docstring", rows
        rows = self.above(line)
        return ("comment", rows) if rows else ("", [])


PAIRS = "file_path string, start_line long, name string, doc_kind string, words int, documentation string, code string"


def pairs(units: DataFrame, contents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per function of ``units`` (file_path, start_line, name) whose documentation has ``min_words`` of prose.

    ``contents`` has one row per path; of repeats the longest text stands. Units of files without content, null
    lines or paths, and lines beyond the file give nothing; repeats count once. A null name has no words of its own.
    The units of a file are gathered beside its text, which bounds their number; the text is shuffled once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, lines, names in zip(b["path"], b["content"], b["lines"], b["names"]):
                source = Source(path, text)
                for line, name in zip(lines, names):
                    kind, doc = source.documentation(int(line))
                    if kind and (n := word_count(doc, name)) >= min_words:
                        start, _, end = source.extent(int(line))
                        rows.append((path, int(line), name, kind, n, "\n".join(doc).strip(), text[start:end]))
            yield pd.DataFrame(rows, columns=["file_path", "start_line", "name", "doc_kind", "words", "documentation", "code"])

    once = units.filter(F.col("file_path").isNotNull() & F.col("start_line").isNotNull()).groupBy("file_path", "start_line").agg(F.max("name").alias("name"))
    listed = once.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("start_line", F.coalesce("name", F.lit("")).alias("name")))).alias("u"))
    text = contents.filter(F.col("content").isNotNull() & (F.col("content") != "")).select(F.col("path").alias("path"), "content")
    text = text.groupBy("path").agg(F.max_by("content", F.struct(F.length("content"), "content")).alias("content"))
    joined = text.join(listed, F.col("path") == F.col("file_path"))
    return joined.select("path", "content", F.col("u.start_line").alias("lines"), F.col("u.name").alias("names")).mapInPandas(run, PAIRS)
