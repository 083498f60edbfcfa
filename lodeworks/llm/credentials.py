"""Credentials in source and configuration text: found, located by byte and blanked out in place (problem 6).

A text is parsed into *settings*: key path, value and the value's byte range. JSON, YAML, TOML, env, ini and XML texts
are read into key paths (``settings``), of which any name may be sensitive; assignments and keyword arguments of the usual languages, headers and bare addresses all give settings. A setting
counts as a credential by the shape of its value (prefix of a known issuer, PEM head, signed token, address with
a password) or by a sensitive key name joined with a value that could be used as it stands.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm import settings as S

class Finding(NamedTuple):
    line: int
    key: str
    kind: str
    start: int
    end: int


#: Value shapes of known issuers: kind, texts of which a hit holds one (in lower case), pattern.
SHAPES = (
    ("cloud_access_key", ("akia", "asia"), r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("vcs_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-"), r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,})"),
    ("payment_key", ("k_live_", "k_test_"), r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("chat_token", ("xox",), r"(?<![A-Za-z0-9])xox[abeprs]-[A-Za-z0-9\-]{10,}"),
    ("mail_key", ("sg.",), r"(?<![A-Za-z0-9])SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}"),
    ("registry_token", ("npm_", "pypi-"), r"(?<![A-Za-z0-9])(?:npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_\-]{40,})"),
    ("api_key", ("aiza",), r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_\-]{35}"),
    ("signed_token", ("eyj",), r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{16,}"),
    ("private_key", ("private key",), r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----"),
    ("address_password", ("://",), r"[a-z][a-z0-9+.\-]*://[^\s/:@\"'`<>]*:(?P<v>[^\s/@\"'`<>]+)@"),
    ("address_key", ("://",), r"(?i:https?)://[^\s\"'`<>?]*\?(?:[^\s\"'`<>]*&)?(?i:access|access_token|key|api[_\-]?key|sig|signature|token|auth|secret|password|pwd)=(?P<v>[^&\s\"'`<>#]+)"),
    ("header", ("bearer ", "basic "), r"(?i:bearer|basic)[ \t]+(?P<v>[A-Za-z0-9_\-+/.~]{8,}={0,2})"),
    ("command_login", ("-u ", "--user"), r"(?<![\w-])(?:-u|--user)[ =]+[^\s:\"']+:(?P<v>[^\s\"'`]+)"),
    ("login_call", ("login", "signin", "sign_in", "authenticate", "connect"), r"(?i:\b\w*(?:login|sign_?in|authenticate|connect))[ \t]*\([ \t]*(?:[\"'][^\"'\n]*[\"'][ \t]*,[ \t]*){1,3}[\"'](?P<v>[^\"'\n]{6,})[\"'][ \t]*\)"),
    ("login_remark", ("login", "log-in", "credential", "creds", "account"), r"(?i:\b(?:login|log-in|credentials?|creds|account)\b)[^\n:=]{0,60}[:=][ \t]*[\w.@\-]+[ \t]*/[ \t]*(?P<v>[^\s\"'`,;]{6,})"),
    ("command_password", ("-pass", "-token", "-secret", "-api-key"), r"(?<![\w-])--?(?:password|passwd|pass|token|secret|api-key)[ =]+(?P<v>[^\s\"'`]+)"),
)
_SHAPES = [(kind, parts, re.compile(p)) for kind, parts, p in SHAPES]

#: One setting: key, separator, value in quotes or bare. The value may go on as joined literals.
_SETTING = re.compile(
    r"""(?P<key>[A-Za-z_][\w.\-]*)["'`]?[ \t]*(?::[ \t]*[A-Za-z_][\w.<>\[\]|? ]*?[ \t]*=(?![=>])|:=|=>|=(?![=>])|:(?![:=/]))[ \t]*"""
    r"""(?:(?P<quote>\"{3}|'{3}|["'`])(?P<text>(?:\\.|(?!(?P=quote)).)*?)(?P=quote)(?P<more>(?:\s*\+?\s*["'`](?:\\.|[^"'`\\])*["'`])*)"""
    r"""|(?P<bare>[^\s"'`,;(){}\[\]<>]+)(?=[ \t]*(?:[,;`"'})\]]|$|\#|//)))""",
    re.M,
)
_PROSE = re.compile(r"(?i)\b(?P<key>pass(?:word|phrase|wd|code)?|pwd|secret|token|credentials?|(?:api|access|private|secret)[ _\-]?key)\b(?:[ \t]+(?:for|of|on|at|to)[ \t]+[\w.\-]+(?:[ \t]+[\w.\-]+)?)?[ \t]*(?:is|was|=|:|->|→)[ \t]*(?P<v>[^\s\"'`,;()]{6,})")
#: A sensitive word with the value right behind it, as remarks have it.
_ADJACENT = re.compile(r"(?i)\b(?P<key>pass(?:word|phrase|wd|code)?|pwd|secret|token|credentials?|(?:api|access|private|secret)[ _\-]?key)[ \t]+(?P<v>(?=[^\s\"'`,;()]*\d)[^\s\"'`,;()]{8,})")
#: Words that make a name sensitive; the second set only beside a value that is random.
_STRONG = {"password", "passwd", "pwd", "pw", "pass", "passphrase", "passcode", "secret", "apikey", "credential", "credentials"}
_WEAK = {"token", "key", "auth", "authorization", "access", "signing", "jwt", "bearer", "pat", "webhook", "hook", "salt", "cookie", "private", "session"}
_NAMES_ONLY = {"field", "name", "count", "ref", "url", "uri", "path", "id", "hash", "checksum", "integrity", "public", "masked", "label", "column", "header", "length", "len", "policy", "hint", "prompt", "placeholder", "pattern", "regex", "type", "index", "env", "var", "file", "dir", "param", "rule", "min", "max", "expiry", "ttl", "limit", "commit", "digest", "sum", "etag", "trace", "build", "revision", "fingerprint"}
_HOLDS = {"accesskeyid", "keyid", "accessid"}
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_FAKE = re.compile(
    r"(?i)^(?:[x*.#•\-_?0]+|.*(?:\*{3,}|x{6,}|\.{3,}).*|<.*>|\[.*\]|\{.*\}|\$\{?.*|%.*%|.*\$\{.*|.*\{\{.*|.*[{<][a-z_. ]+[}>].*|your[_\-]?.*|my[_\-][a-z_\-]*|(?:.*[^a-z0-9])?(?:example|placeholder|changeme|change[_\-]me|redacted|replace|dummy|sample|todo|insert|not[_\-]?set|foobar)(?:[^a-z0-9].*)?|null|none|nil|undefined|true|false|test|password|secret|token|admin|string|required|optional|default|empty|unset|hidden|n/?a|tbd)$"
)
_STORE = re.compile(r"(?i)^(?:vault|env|secretsmanager|ssm|kms|arn|keyring|secret|file|op|gcp|azure|k8s|ref|sops|config|process|os|data|sha\d+|md5)[:.#/]|^(?:https?|s3|gs)://|^sha(?:1|256|384|512)-|^data:|^(?:process\.env|os\.environ|import\.meta)")
_HEXID = re.compile(r"^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$", re.I)
_CALL = re.compile(r"^[A-Za-z_][\w.]*\s*[(\[]|^[a-z_]\w*(?:\.\w+)+$|^@\w")
#: A setting's key holds one of these.
_HINT = re.compile(r"pass|pw|secret|token|key|auth|cred|bearer|access|private|signing|jwt|hook|salt|cookie|session|pat(?![a-z])")
_VERB = re.compile(r"(?i)\b(?:use|using|try|enter|type|set)[ \t]+(?:the[ \t]+)?$")
#: A tag that names something sensitive.
_TAGGED = re.compile(rf"<(?=[a-z_])[^<>]*(?:{_HINT.pattern})[^<>]*>")
#: A name that says what its value is, so that a sensitive name further out says nothing of it.
_DESCRIBES = {"user", "username", "login", "email", "mail", "owner", "account", "host", "hostname", "server", "endpoint", "domain", "port", "region", "zone", "database", "db", "schema", "version", "mode", "algorithm", "alg", "kind", "created", "updated", "rotated", "issued", "expires", "date", "time", "timestamp", "provider", "issuer", "audience", "scope", "namespace", "title", "description", "note", "comment", "status", "state", "size", "level"}
#: A sensitive name that opens a mapping, a list, a section or a block, or names the value beside it.
_OUTER = re.compile(rf"(?:{_HINT.pattern})[\w.\- ]*[\"']?\s*[:=]\s*(?:$|[\[{{|>&!#/])|^[ \t]*\[[^\]\n]*(?:{_HINT.pattern})[^\n]*\]|\b(?:name|key|var|variable)[\"']?\s*:\s*[\"']?[\w.\-]*(?:{_HINT.pattern})", re.M)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def usable(value: str) -> bool:
    """Whether a value could be used as it stands: no placeholder, mask, reference to a store, call or identifier."""
    v = value.strip()
    return bool(v) and not (_FAKE.match(v) or _STORE.match(v) or _HEXID.match(v) or _CALL.match(v))


def _random(v: str) -> bool:
    """Letters mixed with digits, or long and varied, as made by a machine or by password rules."""
    if len(v) < 12 or " " in v or "/" in v and v.count("/") > 2 and not re.search(r"\d", v):
        return False
    kinds = sum(bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    return (kinds >= 3 or bool(re.fullmatch(r"[0-9a-f]{20,}", v))) and _entropy(v) >= 3.0


def _password_like(v: str) -> bool:
    """Any value of a password that is not a plain word or path made of words."""
    if len(v) < 6 or " " in v:
        return False
    letters = re.fullmatch(r"[A-Za-z]+(?:[_\-./ :][A-Za-z]+)*", v)
    return not letters and not re.fullmatch(r"\d{1,7}", v)


def _key_says(key: str) -> str:
    """strong, weak or nothing, by the words of a key name; a trailing tag of three signs may follow the name."""
    words = [w.lower() for w in _WORD.findall(key)]
    joined = re.sub(r"[^a-z0-9]", "", key.lower())
    rest = words
    if not words or set(words) & _NAMES_ONLY and not any(h in joined for h in _HOLDS):
        return ""
    if set(rest) & _STRONG or "apikey" in joined or re.search(r"passw(?:or)?d|passphrase|secret", joined):
        return "strong"
    return "weak" if set(rest) & _WEAK else ""


def _path_says(path: tuple[str, ...]) -> tuple[str, bool]:
    """(strong, weak or nothing; whether an outer name says so) of a key path: the innermost name that says anything counts."""
    names = [p for p in path if not p.isdigit()]
    for k, name in enumerate(reversed(names)):
        words = {w.lower() for w in _WORD.findall(name)}
        says = _key_says(name) or _key_says(re.sub(r"(?<=[a-z])s(?![a-z])", "", name))
        if says:
            # the elements of a list, and a value beside its name, belong to the name itself
            return says, k > 0 and not (k == 1 and names[-1].lower() in S._VALUES)
        if not k and words & (_NAMES_ONLY | _DESCRIBES):
            return "", False
    return "", False


def _decoded(value: str) -> str:
    try:
        return base64.b64decode(value, validate=True).decode("utf-8")
    except ValueError:
        return ""


def scan(text: str) -> list[Finding]:
    """The credentials of a text in order, with line from 1 and byte range of the value; empty text gives none.

    A range never crosses another; a private key runs to its END line, or to the end of what is there.
    """
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits: dict[tuple[int, int], tuple[str, str]] = {}
    for kind, parts, pattern in _SHAPES:
        if not any(p in low for p in parts):
            continue
        for m in pattern.finditer(text):
            start, end = m.span("v") if "v" in pattern.groupindex else m.span()
            value = text[start:end]
            if kind == "private_key":
                stop = re.compile(r"-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----").search(text, end)
                end = stop.end() if stop else _pem_end(text, end)
            elif _FAKE.match(value) or "v" in pattern.groupindex and not usable(value):
                continue
            elif kind == "header" and not (_random(value) or ":" in _decoded(value)):
                continue
            elif kind in ("command_password", "login_call", "login_remark") and not (_password_like(value) and re.search(r"\d", value)):
                continue
            elif kind == "address_key" and not (_random(value) or len(value) >= 16 and re.search(r"\d", value)):
                continue
            hits[start, end] = (kind, "")
    tried = -1
    for h in _HINT.finditer(low):
        start = h.start()
        if start < tried:
            continue
        while start and (text[start - 1].isalnum() and text[start - 1].isascii() or text[start - 1] in "_.-"):
            start -= 1
        while start < h.start() and not (text[start].isalpha() or text[start] == "_"):
            start += 1
        m = _SETTING.match(text, start)
        if not m:
            continue
        tried = m.end("key")
        says = _key_says(m["key"])
        if not says:
            continue
        start, end = m.span("bare") if m["bare"] else m.span("text")
        value = text[start:end]
        if m["more"] and "+" in m["more"]:
            value += "".join(re.findall(r"[\"'`]((?:\\.|[^\"'`\\])*)[\"'`]", m["more"]))
            end = m.end("more") - 1
        if not usable(value) or not (_random(value) or says == "strong" and _password_like(value)):
            continue
        if m["bare"] and says == "weak" and not re.search(r"\d", value):
            continue
        if not any(a < end and start < b for a, b in hits):
            hits[start, end] = ("setting", m["key"])
    told: list[S.Setting] = []
    if _OUTER.search(low) or any(kind == "setting" for kind, _ in hits.values()):
        told = S.settings(text)
    elif ("</" in low or "/>" in low) and _TAGGED.search(low):
        told = S.markup(text)
    if told:
        for path, start, end in told:
            name = ".".join(path)
            if (start, end) in hits:
                if hits[start, end][0] == "setting":
                    hits[start, end] = ("setting", name)
                continue
            says, outer = _path_says(path)
            value = re.sub(r"\s*\n\s*", "", text[start:end])
            if not says or not usable(value):
                continue
            digit = re.search(r"\d", value)
            if not (_random(value) and (digit or says == "strong") or says == "strong" and _password_like(value) and (digit or not outer)):
                continue
            if not any(a < end and start < b for a, b in hits):
                hits[start, end] = ("setting", name)
    near = any(w in low for w in ("pass", "pwd", "secret", "token", "key", "credential"))
    for m in _ADJACENT.finditer(text) if near else ():
        value, start = m["v"].rstrip("."), m.start("v")
        mixed = _random(value) and re.search("[a-z]", value) and re.search("[A-Z]", value)
        if usable(value) and (mixed or _password_like(value) and re.search(r"\d\d", value) and _VERB.search(text, max(0, m.start() - 20), m.start())) and not any(a < start + len(value) and start < b for a, b in hits):
            hits[start, start + len(value)] = ("remark", m["key"])
    prose = _PROSE.finditer(text) if near else ()
    for m in prose:
        value = m["v"].rstrip(".")
        start = m.start("v")
        if usable(value) and (_random(value) or _password_like(value) and re.search(r"\d", value)) and not any(a < start + len(value) and start < b for a, b in hits):
            hits[start, start + len(value)] = ("remark", m["key"])
    out, at, byte, line = [], 0, 0, 1
    for (start, end), (kind, key) in sorted(hits.items()):
        if start < at:
            continue
        gap, body = text[at:start], text[start:end]
        byte += len(gap.encode("utf-8", "surrogatepass"))
        line += gap.count("\n")
        size = len(body.encode("utf-8", "surrogatepass"))
        out.append(Finding(line, key, kind, byte, byte + size))
        byte, line, at = byte + size, line + body.count("\n"), end
    return out


def _pem_end(text: str, at: int) -> int:
    m = re.compile(r"(?:\s*[A-Za-z0-9+/=]{16,})*").match(text, at)
    return m.end() if m else at


def redact(text: str, found: list[Finding] | None = None, mark: str = "REDACTED") -> str:
    """``text`` with each finding's bytes replaced by ``mark``; every other byte stays as it was.

    Line breaks inside a replaced value are kept, so that lines keep their numbers.
    """
    if text is None:
        return None
    found = scan(text) if found is None else found
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for f in found:
        out += [raw[at : f.start], mark.encode(), b"".join(re.findall(rb"\r?\n", raw[f.start : f.end]))]
        at = f.end
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


FINDINGS = "record_key string, line_no int, key string, kind string, start_byte int, end_byte int"


def find(table: DataFrame, key: str, text: str) -> DataFrame:
    """One row per credential and distinct record of ``table``: record_key, line_no, key, kind, byte range.

    Null texts and null keys give nothing; repeated rows count once, a key with several texts has the findings of
    all. Only the findings are shuffled, never the texts. Extra columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *f) for k, t in zip(b["k"], b["t"]) for f in scan(t)]
            yield pd.DataFrame(rows, columns=["record_key", "line_no", "key", "kind", "start_byte", "end_byte"])

    rows = table.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("k").isNotNull() & F.col("t").isNotNull())
    return rows.mapInPandas(run, FINDINGS).distinct()


def redacted(table: DataFrame, text: str, out: str = "redacted") -> DataFrame:
    """``table`` with ``out``: the text with its credentials blanked out. Null stays null."""

    @F.pandas_udf("string")
    def blank(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t) if isinstance(t, str) else None)

    return table.withColumn(out, blank(F.col(text)))
