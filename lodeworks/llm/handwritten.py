"""Generated, minified, vendored and data files told apart from hand-written source (problem 3).

Three sources of knowledge, strongest first: attribute files in the tree that mark paths as generated or vendored
(with globs, resolved per directory), evidence in the text itself (notices, shape), and path patterns. Patterns are
conventions, written as an attribute file of lowest rank, and those mined from the corpus: a directory or file name
that repositories with attribute files declare, or whose files bear evidence far more often than others do in several
repositories, is applied to all files under it that nothing is declared of.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import lexing
from lodeworks.plans.lineage import cut

#: Conventional places and names, in the syntax of attribute files. Fixed values.
CONVENTIONS = """
**/node_modules/** linguist-vendored
**/bower_components/** linguist-vendored
**/site-packages/** linguist-vendored
**/third_party/** linguist-vendored
**/third-party/** linguist-vendored
**/thirdparty/** linguist-vendored
**/vendor/** linguist-vendored
**/_vendor/** linguist-vendored
**/vendored/** linguist-vendored
**/external/** linguist-vendored
**/extern/** linguist-vendored
**/deps/** linguist-vendored
**/Godeps/** linguist-vendored
**/Pods/** linguist-vendored
**/dist/** linguist-generated
**/*.min.js linguist-generated
**/*.min.css linguist-generated
**/*_pb2.py linguist-generated
**/*_pb2_grpc.py linguist-generated
**/*.pb.go linguist-generated
**/package-lock.json linguist-generated
**/npm-shrinkwrap.json linguist-generated
**/yarn.lock linguist-generated
**/pnpm-lock.yaml linguist-generated
**/Cargo.lock linguist-generated
**/poetry.lock linguist-generated
**/composer.lock linguist-generated
"""
MIN_SUPPORT, MIN_SHARE, MIN_LIFT, MIN_REPOS = 8, 0.3, 4.0, 2
#: Declared files of a name from which it is a pattern, and the share of its files in declaring repositories.
MIN_DECLARED, DECLARED_SHARE = 3, 0.8
#: Rows up to which rules and patterns are broadcast; beyond that both sides are shuffled.
BROADCAST_ROWS = 100_000
_ATTRIBUTES = {"linguist-generated": "generated", "linguist-vendored": "vendored"}


def glob_regex(pattern: str) -> str:
    """The regular expression, over a path relative to the attribute file, that an attribute glob stands for.

    ``*`` and ``?`` stay within a directory, ``**`` crosses them, a pattern without a slash matches at any depth.
    """
    body = pattern.lstrip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{'' if '/' in pattern.rstrip('/') else '(?:.*/)?'}{out}$"


def parse_attributes(text: str) -> list[tuple[int, str, str, bool]]:
    """(order, regex, attribute, set) of an attribute file's lines; remarks and other attributes are passed over."""
    rules = []
    for n, line in enumerate((text or "").splitlines()):
        parts = line.split()
        if not parts or parts[0].startswith("#"):
            continue
        for word in parts[1:]:
            name, _, value = word.lstrip("-!").partition("=")
            if name in _ATTRIBUTES:
                rules.append((n, glob_regex(parts[0]), _ATTRIBUTES[name], word[0] not in "-!" and value.lower() not in ("false", "unset", "0")))
    return rules


_GENERATED = re.compile(
    r"(?im)\bauto[\s-]?generated\b(?!\s+(?:by hand|\w+\s+(?:stub|name|id)s?\b))|@generated\b|<auto-?generated|\bcode generated by\b|\bgenerated (?:on|by|from|with|automatically|code|file)\b|\bautomatically (?:produced|generated|created|written)\b|\bproduced by (?:the|a) [\w\- ]{0,40}(?:compiler|generator|tool)\b|\bdo not (?:edit|modify)\b[^\n]{0,40}\b(?:by hand|manually|directly|generated|file)\b|\bmanual changes will be (?:lost|overwritten)\b|^\W*source: [\w./\-]+\.(?:proto|thrift|avdl|graphql|ya?ml|json|xsd|wsdl|g4|y|l)\b[^\n]*|\bthis file (?:is|was) (?:machine|auto)[\w\- ]*(?:generated|produced|written)"
)
_BY_HAND = re.compile(r"(?i)maintained by hand|written by hand|hand[\s-]?written|edited by hand|not generated")
_FOREIGN = re.compile(
    r"(?im)\bSPDX-License-Identifier:|\blicensed under the\b|\bredistribution and use in source and binary\b|@licen[sc]e\b|\breleased under the [\w\- .]+ licen[sc]e\b|\bpermission is hereby granted\b|^\W*upstream: https?://|\bcopied (?:verbatim )?from https?://|\bvendored from\b|\bported from https?://|\(c\) the [\w\- ]+ authors\b|\bcopyright \(c\)|\b(?:mozilla public|gnu (?:lesser )?general public) license"
)
#: Any notice of either kind holds one of these, in lower case.
_PARTS = ("generated", "automatically ", "produced by", "do not edit", "do not modify", "manual changes", "source:", "this file", "spdx-", "licensed under", "redistribution and", "@licen", "released under", "permission is", "upstream:", "copied ", "vendored from", "ported from", "(c) the", "copyright (c)", "mozilla public", "gnu ")
#: What blocks of data are made of: numbers, strings without words, brackets and separators.
_DATUM = re.compile(r"""["'`][^"'`\s]*(?:\d[^"'`\s]*|[A-Za-z0-9+/=_\-]{40,})["'`]|(?<![\w])[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[lLuUnf]?(?![\w])|[\s\[\]{}(),:;=]+""")
_LOCK = re.compile(r'"lockfileVersion"\s*:|^# yarn lockfile|(?m:^lockfileVersion:)|^# This file is automatically @generated by')
CODE = {"py", "js", "ts", "java", "go", "jsx", "tsx", "mjs", "cjs", "c", "h", "cpp", "cs", "rb", "php", "rs", "css"}


def evidence(path: str, text: str, own: str = "") -> str:
    """What the text itself says: generated, lock, vendored, compiled, minified, data, or the empty string.

    ``own`` is a pattern of the notices of the corpus's own project, which do not make a file a foreign one.
    """
    mine = re.compile(own or r"(?!)", re.I)
    ext = lexing.language(path)
    if not text:
        return ""
    if ext in ("json", "yaml", "yml", "md"):
        return "lock" if _LOCK.search(text) else ""
    head = _head(text, ext)
    notice = _GENERATED.search(head)
    if notice and not _BY_HAND.search(head):
        return "generated"
    if _FOREIGN.search(head) and not mine.search(head):
        return "vendored"
    if ext not in CODE:
        return ""
    for block in _later(text, ext, len(head)):
        if _BY_HAND.search(block):
            continue
        if _GENERATED.search(block):
            return "generated"
        if _FOREIGN.search(block) and not mine.search(block):
            return "vendored"
    size = len(text)
    if size >= 400 and sum(c.isdigit() for c in text) * 12 >= size and len(_DATUM.sub("", text)) <= 0.3 * size:
        return "data"
    if re.search(r'Object\.defineProperty\(exports, ["\']__esModule["\']', text) or re.search(r"(?m)^(?://|/\*)# sourceMappingURL=", text):
        return "compiled"
    if ext in ("js", "mjs", "cjs", "ts", "css", "jsx", "tsx"):
        code = lexing.blanked(text, [s for s in lexing.spans(text, "js") if s.kind != "string"])
        rows = [r for r in code.split("\n") if r.strip()]
        longest = max(map(len, rows), default=0)
        solid = sum(map(len, rows))
        if longest >= 250 and solid / len(rows) >= 120:
            long = max(rows, key=len)
            if sum(c == " " for c in long.strip()) / len(long.strip()) < 0.12:
                return "minified"
    return ""


def _head(text: str, ext: str) -> str:
    """The comments before the first code, of any length: where notices stand."""
    if ext in ("py", "rb", "sh"):
        m = re.match(r"(?:\s*+(?:#[^\n]*+|\"{3}[^\"]*+(?:\"(?!\"\")[^\"]*+)*+\"{3}|'{3}[^']*+(?:'(?!'')[^']*+)*+'{3})(?:\n|$))*+", text)
    else:
        m = re.match(r"(?:\s*+(?:#![^\n]*+|//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/|['\"]use strict['\"];?))*+", text)
    return m[0] if m else ""


def _later(text: str, ext: str, at: int) -> list[str]:
    """The comments behind ``at`` that begin a line, neighbours together: a notice may stand below the first code."""
    low = text[at:].lower()
    if not any(p in low for p in _PARTS):
        return []
    out, end = [], -1
    for s in lexing.spans(text, ext):
        if s.start < at or s.kind == "string" or s.start and text[s.start - 1] != "\n":
            continue
        if end >= 0 and not text[end : s.start].strip():
            out[-1] += "\n" + text[s.start : s.end]
        else:
            out.append(text[s.start : s.end])
        end = s.end
    return out


def path_parts(path: str) -> list[str]:
    """Pattern keys of a path: its directories below the repository and the shape of its file name."""
    bits = path.split("/")
    name = bits[-1]
    below = bits[4:-1] if path.startswith("/") else bits[:-1]
    keys = [f"d:{b}" for b in dict.fromkeys(below)]
    keys += [f"d:{a}/{b}" for a, b in zip(below, below[1:])]
    if m := re.search(r"(?<=[\w])([._][A-Za-z]+[0-9]?)(\.[A-Za-z]+)$", name):
        keys.append(f"n:{m[1].lower()}")
    return keys


RULE = "dir string, depth int, line int, regex string, kind string, on boolean"
EVIDENCE = "path string, repo string, evidence string, keys array<string>, rules array<struct<dir:string,depth:int,line:int,regex:string,kind:string,on:boolean>>"


def examine(contents: DataFrame, own: str = "") -> DataFrame:
    """(path, repo, evidence, keys, rules) of each path, from one reading of the texts.

    Of repeats of a path the greatest evidence stands; ``rules`` holds what an attribute file declares.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rules = [[{"dir": p.rsplit("/", 1)[0], "depth": p.count("/"), "line": n, "regex": x, "kind": k, "on": on} for n, x, k, on in parse_attributes(t)] if t and p.rsplit("/", 1)[-1] == ".gitattributes" else [] for p, t in zip(b["path"], b["content"])]
            yield pd.DataFrame({"path": b["path"], "repo": b["path"].map(_repo), "evidence": [evidence(p, t, own) for p, t in zip(b["path"], b["content"])], "keys": b["path"].map(path_parts), "rules": rules})

    rows = contents.filter(F.col("path").isNotNull()).select("path", "content").mapInPandas(run, EVIDENCE)
    return rows.groupBy("path").agg(F.max("repo").alias("repo"), F.max("evidence").alias("evidence"), F.max("keys").alias("keys"), F.max("rules").alias("rules"))


def _repo(path: str) -> str:
    bits = path.split("/")
    return bits[3] if path.startswith("/") and len(bits) > 4 else bits[0]


def mined(labelled: DataFrame) -> DataFrame:
    """(key, kind) of the path patterns of ``labelled`` (repo, declares, declared, evidence, keys), each key once.

    A name is a pattern where repositories with attribute files declare nearly all of its files, else where its files
    bear evidence of one kind far more often than files at large, in several repositories.
    """
    flag = F.col("evidence") != ""
    base = labelled.agg(F.avg(flag.cast("double")).alias("base")).scalar()
    each = labelled.select("repo", "declares", "declared", "evidence", F.explode("keys").alias("key"))
    of_repo = each.groupBy("key", "repo").agg(
        F.count(F.lit(1)).alias("files"), F.sum(flag.cast("long")).alias("marked"),
        F.sum(F.col("declares").cast("long")).alias("judged"), F.sum((F.col("declared") != "").cast("long")).alias("said"),
    )
    share = of_repo.groupBy("key").agg(F.sum("files").alias("files"), F.sum("marked").alias("marked"), F.sum((F.col("marked") > 0).cast("long")).alias("repos"), F.sum("judged").alias("judged"), F.sum("said").alias("said"))
    by_word = (F.col("said") >= MIN_DECLARED) & (F.col("said") >= F.col("judged") * DECLARED_SHARE)
    by_text = (F.col("marked") >= MIN_SUPPORT) & (F.col("repos") >= MIN_REPOS) & (F.col("marked") >= F.col("files") * MIN_SHARE) & (F.col("marked") >= F.col("files") * F.least(base * MIN_LIFT, F.lit(0.9)))
    kept = share.filter(by_word | by_text).select("key", by_word.alias("by_word"))
    kind = F.when(F.col("declared") != "", F.col("declared")).otherwise(F.col("evidence"))
    kinds = each.select("key", kind.alias("kind"), (F.col("declared") != "").alias("word")).filter("kind != ''").groupBy("key", "kind", "word").count()
    first = kinds.join(kept, "key").groupBy("key").agg(F.max_by("kind", F.struct((F.col("by_word") & F.col("word")).alias("w"), "count", "kind")).alias("kind"))
    return first


def declared(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, kind, on): what the attribute files above a path say; the deepest file's last matching line wins.

    A path meets the rules of its own directories only, by an equi-join on the directory; few rules are broadcast, so
    that no directory's files have to meet in one task.
    """
    up = F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), n -> substring_index(path, '/', n))")
    near = paths.select("path", F.explode(up).alias("dir")).join(_small(rules), "dir")
    hit = near.filter(F.expr("substring(path, length(dir) + 2) RLIKE regex"))
    return hit.groupBy("path", "kind").agg(F.max_by("on", F.struct("depth", "line")).alias("on"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it was counted and is small, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _conventional(path: str) -> str:
    for rx, kind in _CONVENTIONAL:
        if rx.match(path):
            return kind
    return ""


_CONVENTIONAL = [(re.compile(x), k) for _, x, k, on in parse_attributes(CONVENTIONS) if on]


def classify(contents: DataFrame, files: DataFrame | None = None, own: str = "") -> DataFrame:
    """(path, repo, kind, reason): kind is empty for hand-written files, reason is declared, text, convention or mined.

    Paths of ``files`` without content are judged by path alone. Markdown, YAML and JSON are cases only as lock files,
    by declaration or in a vendored place. Null paths give nothing, empty texts no evidence, repeats one row. The texts
    are read once; what was found in them is kept without the texts.
    """

    @F.pandas_udf("string")
    def conventional(paths: pd.Series) -> pd.Series:
        return paths.map(_conventional)

    text = examine(contents, own)
    if files is not None:
        named = files.filter(F.col("path").isNotNull()).select(F.col("path").alias("_p")).distinct()
        text = text.join(named, F.col("path") == F.col("_p"), "full_outer").select(F.coalesce("path", "_p").alias("path"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), "rules")
    text = cut(text)
    rules = cut(text.filter(F.size("rules") > 0).select("repo", F.inline("rules")))
    declares = rules.select(F.col("repo").alias("_r")).distinct()
    if rules.isEmpty():
        known = text.select("path", "repo", "evidence", "keys", F.lit(False).alias("declares"), F.lit(None).cast("string").alias("yes"), F.lit(False).alias("no"))
    else:
        said = declared(text.select("path"), rules.drop("repo")).groupBy(F.col("path").alias("_d")).agg(F.max(F.when(F.col("on"), F.col("kind"))).alias("yes"), F.bool_or(~F.col("on")).alias("no"))
        known = text.join(said, F.col("path") == F.col("_d"), "left").join(_small(declares), F.col("repo") == F.col("_r"), "left").select("path", "repo", "evidence", "keys", F.col("_r").isNotNull().alias("declares"), "yes", F.coalesce("no", F.lit(False)).alias("no"))
        known = cut(known)
    patterns = cut(mined(known.select("repo", "declares", F.coalesce("yes", F.lit("")).alias("declared"), F.when(F.col("no") & F.col("yes").isNull(), "").otherwise(F.col("evidence")).alias("evidence"), "keys")))
    by_key = known.select("path", F.explode("keys").alias("key")).join(_small(patterns), "key").groupBy(F.col("path").alias("_m")).agg(F.max("kind").alias("mined"))
    prose = F.lower(F.col("path")).rlike(r"\.(json|ya?ml|md|txt|toml)$")
    all_ = known.join(by_key, F.col("path") == F.col("_m"), "left").withColumn("place", conventional("path"))
    mined_kind = F.when(~prose, F.col("mined"))
    kind = F.when(F.col("yes").isNotNull(), F.col("yes")).when(F.col("no"), "").when(F.col("evidence") != "", F.col("evidence")).when(F.col("place") != "", F.col("place")).otherwise(F.coalesce(mined_kind, F.lit("")))
    reason = F.when(F.col("yes").isNotNull() | F.col("no"), "declared").when(F.col("evidence") != "", "text").when(F.col("place") != "", "convention").when(mined_kind.isNotNull(), "mined").otherwise("")
    return all_.select("path", "repo", kind.alias("kind"), reason.alias("reason"))
