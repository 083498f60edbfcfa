"""Column expressions over text: tokens, hashed features, snippets, scans for personal data and secrets, edits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

#: Words left out of the index. Fixed values.
STOP_WORDS = tuple(
    """the a an and or but in on at to for of with by from is it this that are was were be been being have has had do does
            did will would could should may might can not no nor so if then than too very just about also into over after before
            between through during without within along each every both few more most other some such only own same its our your
            their his her what which who whom when where why how all any get got let make much new now old see way well back even
            because these those there here come made find long look many know take people time hand high keep last give great
            found still under never small right think help line first need while next sure big going start said put end another
            above two""".split()
)

#: Shapes of personal data: name, pattern, severity. Fixed values.
PERSONAL = (
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", "high"),
    ("DOB", r"\b(19|20)\d{2}[-/](0[1-9]|1[0-2])[-/](0[1-9]|[12]\d|3[01])\b", "high"),
    ("phone", r"\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b", "medium"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "medium"),
    ("MRN", r"\b(MRN|mrn|Medical Record)[\s#:]{0,3}\d{4,12}\b", "high"),
    ("NPI", r"\b(NPI)[\s#:]{0,3}\d{10}\b", "high"),
    ("person_name", r"\b(Dr\.|Mr\.|Mrs\.|Ms\.|Miss)\s+[A-Z][a-z]+\s+[A-Z][a-z]+", "medium"),
    ("address", r"(?i)\b\d{1,5}\s+[A-Z][a-z]+\s+(Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln)\b", "medium"),
    ("zip_code", r"\b\d{5}(-\d{4})?\b", "low"),
    ("ipv4", r"\b(25[0-5]|2[0-4]\d|[01]?\d\d?)\.(25[0-5]|2[0-4]\d|[01]?\d\d?)\.(25[0-5]|2[0-4]\d|[01]?\d\d?)\.(25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "low"),
)
RANKS = {"high": 1, "medium": 2, "low": 3}

#: Shapes of secrets: name, pattern, severity. Fixed values.
SECRETS = (
    ("cloud-access-key", r"\bAKIA[A-Z0-9]{16}\b", "critical"),
    ("vcs-token", r"\bgh[po]_[A-Za-z0-9]{36}\b", "critical"),
    ("payment-key", r"\bsk_live_[A-Za-z0-9]{20,}\b", "critical"),
    ("signed-token", r"\beyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{10,}", "high"),
    ("private-key", r"-----BEGIN (RSA |EC |OPENSSH |PGP )?PRIVATE KEY", "critical"),
    ("vcs-fine-token", r"\bgithub_pat_[A-Za-z0-9_]{22,}", "critical"),
    ("vcs-app-token", r"\bgh[usr]_[A-Za-z0-9]{36,}\b", "critical"),
    ("forge-token", r"\bglpat-[A-Za-z0-9_\-]{20,}", "critical"),
    ("cloud-session-key", r"\bASIA[A-Z0-9]{16}\b", "critical"),
    ("cloud-secret-assignment", r"(?i)aws.{0,20}secret.{0,20}[\"'][A-Za-z0-9/+=]{40}[\"']", "critical"),
    ("maps-key", r"\bAIza[A-Za-z0-9_\-]{35}", "high"),
    ("oauth-client", r"\bGOCSPX-[A-Za-z0-9_\-]{20,}", "high"),
    ("account-key", r"AccountKey=[A-Za-z0-9+/=]{40,}", "critical"),
    ("chat-token", r"\bxox[abeprs]-[A-Za-z0-9\-]{10,}", "high"),
    ("chat-hook", r"https://hooks\.slack\.com/services/[A-Za-z0-9/]{20,}", "high"),
    ("mail-key", r"\bSG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}", "high"),
    ("mail-service-key", r"\bkey-[0-9a-f]{32}\b", "high"),
    ("payment-restricted-key", r"\brk_live_[A-Za-z0-9]{20,}\b", "critical"),
    ("payment-test-key", r"\bsk_test_[A-Za-z0-9]{16,}\b", "medium"),
    ("payment-access-token", r"\bsq0(atp|csp)-[A-Za-z0-9_\-]{22,}", "critical"),
    ("shop-token", r"\bshp(at|ca|pa|ss)_[A-Fa-f0-9]{32}\b", "critical"),
    ("phone-service-key", r"\bSK[0-9a-f]{32}\b", "high"),
    ("package-token", r"\bnpm_[A-Za-z0-9]{36}\b", "critical"),
    ("index-token", r"\bpypi-[A-Za-z0-9_\-]{40,}", "critical"),
    ("image-token", r"\bdckr_pat_[A-Za-z0-9_\-]{20,}", "critical"),
    ("host-token", r"\bdo[opr]_v1_[a-f0-9]{64}\b", "critical"),
    ("vault-token", r"\bhvs\.[A-Za-z0-9_\-]{24,}", "critical"),
    ("model-hub-token", r"\bhf_[A-Za-z0-9]{34,}\b", "high"),
    ("metrics-key", r"\bNRAK-[A-Z0-9]{27}\b", "high"),
    ("lakehouse-token", r"\bdapi[a-f0-9]{32}\b", "high"),
    ("putty-key", r"PuTTY-User-Key-File-[23]:", "critical"),
    ("file-key", r"\bAGE-SECRET-KEY-1[A-Z0-9]{58}\b", "critical"),
    ("bearer-header", r"(?i)\bauthorization[\"']?\s*[:=]\s*[\"']?bearer\s+[A-Za-z0-9_\-.=]{20,}", "high"),
    ("basic-header", r"(?i)\bauthorization[\"']?\s*[:=]\s*[\"']?basic\s+[A-Za-z0-9+/=]{16,}", "high"),
    ("key-assignment", r"(?i)\b(api|access|secret|private)[_-]?key\w*[\"']?\s*[:=]\s*[\"'][A-Za-z0-9_\-/+=]{20,}[\"']", "medium"),
    ("database-uri", r"\b(postgres|mysql|redis|mongodb(\+srv)?)://[^\s:@/]+:[^\s@/]+@", "high"),
    ("password-assignment", r"(?i)\bpass(word|wd|phrase)\w*[\"']?\s*[:=]\s*[\"'][^\"'\s$*{<]{8,}[\"']", "medium"),
)
CONFIDENCE = {"critical": 0.95, "high": 0.85, "medium": 0.70, "low": 0.50}

#: Language by file extension. Fixed values.
LANGUAGES = {
    "js": "javascript", "ts": "typescript", "jsx": "jsx", "tsx": "tsx", "py": "python", "java": "java", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp",
    "rs": "rust", "go": "go", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "cs": "csharp", "fs": "fsharp", "vb": "visualbasic",
    "xml": "xml", "html": "html", "css": "css", "scss": "scss", "sass": "sass", "less": "less", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "md": "markdown", "sh": "bash", "bash": "bash", "zsh": "zsh", "fish": "fish", "ps1": "powershell", "bat": "batch", "cmd": "batch", "sql": "sql", "graphql": "graphql", "gql": "graphql",
}

DIMENSIONS, NGRAM_WEIGHT = 384, 1.5
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_bounds(pattern: str) -> str:
    """A pattern whose word boundaries know only ASCII letters, as those of other engines do."""
    return pattern.replace(r"\b", _BOUNDARY)


def words(text: Column) -> Column:
    """Lower-case words of three signs or more that are no stop words, in order; other signs than [a-z0-9_] part words."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+")
    return F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def ngrams(tokens: Column, n: int) -> Column:
    """Neighbouring words joined by underscores; too short an array has none."""
    last = F.size(tokens) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, n), "_"))).otherwise(F.array().cast("array<string>"))


def index_terms(table: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, kind, n): words with kind ``word``; bigrams, and trigrams of texts with more than 20 words, with kind ``ngram``."""
    t = table.select(key, words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    grams = F.concat(ngrams(F.col("w"), 2), F.when(F.size("w") > 20, ngrams(F.col("w"), 3)).otherwise(F.array().cast("array<string>")))
    named = lambda terms, kind: F.transform(terms, lambda x: F.struct(x.alias("term"), F.lit(kind).alias("kind")))
    each = t.select(key, F.inline(F.concat(named(F.col("w"), "word"), named(grams, "ngram"))))
    return each.groupBy(key, "term", "kind").agg(F.count(F.lit(1)).alias("n"))


def polynomial_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit polynomial hashes of base 31, powers of 31 by length) of words.

    Words of usual length are hashed sign by sign as columns of a matrix, long ones one by one.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    h = np.zeros(len(words), np.uint32)
    short = np.flatnonzero(lengths <= 64)
    if len(short):
        signs = np.array([words[i] for i in short], dtype=str)
        width = max(signs.dtype.itemsize // 4, 1)
        code = signs.view(np.uint32).reshape(len(signs), width)
        part, size = np.zeros(len(signs), np.uint32), lengths[short]
        for i in range(width):
            part = np.where(i < size, part * np.uint32(31) + code[:, i], part)
        h[short] = part
    for i in np.flatnonzero(lengths > 64):
        code = np.frombuffer(words[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        powers = np.cumprod(np.concatenate([[1], np.full(len(code) - 1, 31)]).astype(np.uint32), dtype=np.uint32)[::-1]
        h[i] = (code * powers).sum(dtype=np.uint32)
    top = int(lengths.max(initial=0)) + 1
    return h, np.cumprod(np.concatenate([[1], np.full(top - 1, 31)]).astype(np.uint32), dtype=np.uint32)[lengths]


def columns_of(hashes: np.ndarray) -> np.ndarray:
    """Columns of hashed terms: the absolute value of the signed hash modulo the width."""
    return np.abs(hashes.astype(np.int32).astype(np.int64)) % DIMENSIONS


@F.pandas_udf(IntegerType())
def bucket(terms: pd.Series) -> pd.Series:
    """Column of a hashed term."""
    return pd.Series(columns_of(polynomial_hashes(terms.tolist())[0]).astype(np.int32)) if len(terms) else pd.Series([], dtype="int32")


class Hashed:
    """The terms of texts given as word lists: unit rows of hashed columns, and the hashes of words and n-grams in place.

    An n-gram's hash follows from those of its words, so no n-gram is ever built. ``texts`` and ``at`` tell of each hash the text
    and the position of its first word; ``size`` is the number of its words.
    """

    def __init__(self, lists: list):
        self.flat = [w for words in lists for w in words]
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        code, vocabulary = pd.factorize(np.array(self.flat, object)) if self.flat else (np.zeros(0, np.int64), [])
        h, power = polynomial_hashes(list(vocabulary))
        one, power = h[code], power[code]
        text = np.repeat(np.arange(len(lists)), count)
        join = lambda a, b: (a * np.uint32(31) + np.uint32(95)) * power[b] + one[b]
        first = np.flatnonzero(text[1:] == text[:-1])
        two = join(one[first], first + 1)
        third = np.flatnonzero((text[2:] == text[:-2]) & (count[text[2:]] > 20)) if len(text) > 2 else np.zeros(0, np.int64)
        three = join(two[np.searchsorted(first, third)], third + 2)
        self.hashes = np.concatenate([one, two, three])
        self.at = np.concatenate([np.arange(len(one)), first, third])
        self.size = np.repeat([1, 2, 3], [len(one), len(two), len(three)])
        self.texts = text[self.at]
        cell = self.texts * DIMENSIONS + columns_of(self.hashes)
        rows = np.bincount(cell, np.where(self.size == 1, 1.0, NGRAM_WEIGHT), len(lists) * DIMENSIONS).reshape(len(lists), DIMENSIONS)
        self.rows = rows / np.maximum(np.sqrt((rows**2).sum(axis=1)), 1e-300)[:, None]

    def term(self, k: int) -> str:
        return "_".join(self.flat[self.at[k] : self.at[k] + self.size[k]])


def hashed_vectors(table: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, weight): the terms of each text hashed into columns, n-grams weighing more, each vector of unit length.

    One row of ``table`` per key. Each text is worked where it lies; nothing is shuffled.
    """
    kind = table.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k : k + 500]
                rows = Hashed(list(part["w"])).rows
                doc, col = np.nonzero(rows)
                yield pd.DataFrame({key: part[key].to_numpy()[doc], "bucket": col.astype(np.int32), "weight": rows[doc, col]})

    t = table.select(key, words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    return t.mapInPandas(run, f"{key} {kind}, bucket int, weight double")


def snippet(text: Column, terms: list[str], before: int = 50, after: int = 150, most: int = 200) -> Column:
    """The surroundings of the first query term that occurs, in the order of the terms, else the head of the text."""
    low = F.lower(text)
    at = reduce(lambda rest, t: F.when(F.instr(low, t.lower()) > 0, F.instr(low, t.lower())).otherwise(rest), reversed(terms), F.lit(0))
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at - 1 + after, F.length(text))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substr(text, start, end - start + 1), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.concat(F.substring(text, 1, most), F.when(F.length(text) > most, "...").otherwise("")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


#: Texts, in lower case, of which a line holds one wherever the pattern of that name hits; the pattern is tried nowhere else.
SECRET_HINTS = {
    "cloud-access-key": ("akia",), "vcs-token": ("ghp_", "gho_"), "payment-key": ("sk_live_",), "signed-token": ("eyj",), "private-key": ("private key",),
    "vcs-fine-token": ("github_pat_",), "vcs-app-token": ("ghu_", "ghs_", "ghr_"), "forge-token": ("glpat-",), "cloud-session-key": ("asia",), "cloud-secret-assignment": ("aws",),
    "maps-key": ("aiza",), "oauth-client": ("gocspx-",), "account-key": ("accountkey=",), "chat-token": ("xox",), "chat-hook": ("hooks.slack.com",), "mail-key": ("sg.",),
    "mail-service-key": ("key-",), "payment-restricted-key": ("rk_live_",), "payment-test-key": ("sk_test_",), "payment-access-token": ("sq0",), "shop-token": ("shpat_", "shpca_", "shppa_", "shpss_"),
    "phone-service-key": ("sk",), "package-token": ("npm_",), "index-token": ("pypi-",), "image-token": ("dckr_pat_",), "host-token": ("_v1_",), "vault-token": ("hvs.",),
    "model-hub-token": ("hf_",), "metrics-key": ("nrak-",), "lakehouse-token": ("dapi",), "putty-key": ("putty-user-key",), "file-key": ("age-secret-key-",), "bearer-header": ("bearer",), "basic-header": ("basic",),
    "key-assignment": ("key",), "database-uri": ("://",), "password-assignment": ("pass",),
}


def scan_lines(table: DataFrame, key: str, text: str, patterns: tuple, split: str = "\n") -> DataFrame:
    """(key, line_no, name, severity, n): matches per line and pattern, for patterns as (name, pattern, severity)."""
    lines = table.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, split)).alias("i", "line")).withColumn("low", F.lower("line"))

    def times(name: str, p: str) -> Column:
        n = F.regexp_count("line", F.lit(ascii_bounds(p))).cast("long")
        hints = SECRET_HINTS.get(name)
        return F.when(reduce(Column.__or__, [F.contains("low", F.lit(h)) for h in hints]), n).otherwise(F.lit(0).cast("long")) if hints else n

    counts = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), times(n, p).alias("n")) for n, p, s in patterns])
    hits = lines.select(key, (F.col("i") + 1).cast("long").alias("line_no"), F.explode(F.filter(counts, lambda c: c["n"] > 0)).alias("c"))
    return hits.select(key, "line_no", "c.name", "c.severity", "c.n")


def personal_data(table: DataFrame, key: str, text: str, level: str) -> DataFrame:
    """Lines with personal data at ``level``: ``high`` looks for the gravest shapes alone, ``low`` for all."""
    return scan_lines(table, key, text, tuple(p for p in PERSONAL if RANKS[p[2]] <= RANKS[level]))


def masked(value: Column) -> Column:
    """The first and last four signs of a value and its length."""
    return F.concat(F.substring(value, 1, 4), F.lit("***"), F.right(value, F.lit(4)), F.lit("<len:"), F.length(value).cast("string"), F.lit(">"))


def entropy(value: Column) -> Column:
    """Bits per sign of a text."""
    signs = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(signs)
    each = F.transform(F.array_distinct(signs), lambda c: F.size(F.filter(signs, lambda x: x == c)) / n)
    return F.aggregate(each, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def high_entropy(table: DataFrame, key: str, text: str, bits: float = 4.5) -> DataFrame:
    """Tokens of 20 to 200 signs of high entropy that are no hash, identifier or checksum."""
    tokens = table.filter(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.expr(f"regexp_extract_all({text}, '[A-Za-z0-9+/_=-]{{20,200}}', 0)"))).alias("token"))
    kept = tokens.filter(~F.col("token").rlike("^[0-9a-fA-F]+$|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-|^sha(256|384|512)-"))
    return kept.withColumn("bits", F.round(entropy(F.col("token")), 6)).filter(F.col("bits") >= bits)


def line_complexity(text: Column, keywords: list[str]) -> Column:
    """One more than the lines that hold a branching keyword."""
    pattern = ascii_bounds(r"\b(" + "|".join(keywords) + r")\b")
    return (F.size(F.filter(F.split(text, "\n"), lambda x: F.regexp_count(x, F.lit(pattern)) > 0)) + 1).cast("long")


def occurrences(text: Column, part: str) -> Column:
    """Times a part occurs in a text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def apply_edits(text: Column, edits: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(edited text, replacements made): literal edits in order, each over the result of those before it."""
    done, count = text, F.lit(0).cast("long")
    for old, new in edits:
        count = count + occurrences(done, old)
        done = F.replace(done, F.lit(old), F.lit(new))
    return done, count


def edit_risk(path: Column, text: Column, edits: list[tuple[str, str]]) -> Column:
    """low, medium or high, by the warnings of a list of edits: ticks put into script files that have some, shifted braces."""
    script = extension(path).isin("js", "ts", "jsx", "tsx", "mjs", "cjs")
    warnings = F.lit(0)
    for old, new in edits:
        if "`" in new:
            warnings = warnings + F.when(script & (occurrences(text, "`") > 0), 1).otherwise(0)
        if old.count("{") - old.count("}") != new.count("{") - new.count("}"):
            warnings = warnings + 1
    return F.when(warnings >= 3, "high").when(warnings > 0, "medium").otherwise("low")


def edit_damage(path: Column, before: Column, after: Column) -> Column:
    """What an edit broke, the first that holds: json, ticks, braces, brackets or parentheses; null if nothing."""
    def balance(t: Column, a: str, b: str) -> Column:
        return occurrences(t, a) - occurrences(t, b)

    ext = extension(path)
    found = F.when((ext == "json") & F.try_parse_json(after).isNull(), "json").when(ext.isin("js", "ts", "jsx", "tsx") & (occurrences(after, "`") % 2 != occurrences(before, "`") % 2), "ticks")
    for name, a, b in (("braces", "{", "}"), ("brackets", "[", "]"), ("parentheses", "(", ")")):
        found = found.when(balance(before, a, b) != balance(after, a, b), name)
    return found


def tagged(rules: list[tuple[Column, str]]) -> Column:
    """The tags whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))


def first_label(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first condition that holds."""
    out = F.lit(otherwise)
    for c, label in reversed(rules):
        out = F.when(c, F.lit(label)).otherwise(out)
    return out


