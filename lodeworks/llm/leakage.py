"""Evaluation passages that leak into a corpus (problem 9).

Words are canonicalised into templates: numbers, units and names become typed placeholders, whatever their value.
Hashes of template windows of documents and items meet in a hash join. A pair goes on only if it shares as many windows
as a passage of the wanted length must leave whole, whatever the differences allowed; that rule loses nothing. The two
texts of such a pair are aligned, and the slots decide: where the words themselves agree the item is leaked, where
only the template does and every slot value of the item stands for one value throughout, it is re-parameterised.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.plans.lineage import cut

#: Template words of one window; ten per cent of noise leaves such a run in every twenty words.
WINDOW = 5
MIN_WORDS = 20
#: Rows up to which the windows of the items, and the pairs to compare, are broadcast; beyond that both sides are shuffled.
BROADCAST_ROWS = 1_000_000
_WORD = re.compile(r"\d+(?:\.\d+)?(?![^\W\d_])|[^\W_]+")
_MARKUP = re.compile(r"""</?[A-Za-z][\w:\-]*+(?:\s++[\w:@.\-]++(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>]++))?)*+\s*+/?>|<!--.*?-->""", re.S)
_NAME = re.compile(r"(?<![A-Za-z])(?:[a-z]+[A-Z]\w*|[A-Z]+\d\w*|[A-Za-z]+(?:[_\-]\w+)+)|(?<=[\w,;:] )[A-Z][a-z]+")
UNITS = frozenset("mg ml mm cm kg g l percent units unit doses dose seconds second minutes minute hours hour days day weeks week months month years year times rows entries edges keys retries".split())
NUMBER, UNIT, NAME = 1, 2, 3


def _bare(text: str) -> str:
    """A text without markup and entities."""
    return html.unescape(_MARKUP.sub(" ", text)) if "<" in text or "&" in text else text


def words(text: str) -> list[str]:
    """The words of a text in lower case, without markup, entities, marks and punctuation. A number with a point is one word."""
    return _WORD.findall(_bare(text).lower())


def names(text: str) -> set[str]:
    """The words, in lower case, of what is written like a name in a text without markup: joined, mixed case, or a capital within a sentence."""
    return {w for m in _NAME.finditer(text) for w in _WORD.findall(m[0].lower())}


_codes: dict[str, int] = {}


def _code(word: str) -> int:
    """The template code of a word: the same number for all numbers, the same for all units, else one of its own."""
    c = _codes.get(word)
    if c is None:
        if len(_codes) > 500_000:
            _codes.clear()
        c = _codes[word] = NUMBER if word[0].isdigit() else UNIT if word in UNITS else zlib.crc32(word.encode()) + 4
    return c


def canonical(listed: list[str]) -> np.ndarray:
    """Template codes of words."""
    return np.fromiter(map(_code, listed), np.int64, len(listed))


def window_hashes(canon: np.ndarray) -> np.ndarray:
    """One 64-bit hash per window of template codes."""
    n = len(canon) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = (h ^ canon[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.astype(np.int64)


def templates(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, their offsets) of a text's windows: once with its names as they are, once more with names as placeholders."""
    bare = _bare(text)
    listed = _WORD.findall(bare.lower())
    canon = canonical(listed)
    h = window_hashes(canon)
    at = np.arange(len(h))
    found = names(bare)
    if not found or not len(h):
        return h, at
    named = np.fromiter((w in found for w in listed), bool, len(listed)) & (canon > UNIT)
    second = window_hashes(np.where(named, NAME, canon))
    differ = second != h
    return np.concatenate([h, second[differ]]), np.concatenate([at, at[differ]])


def least_windows(n: int, least: int = MIN_WORDS) -> int:
    """Windows that any passage worth finding shares with an item of ``n`` words: a differing word spoils at most WINDOW of them."""
    spared = [m - (WINDOW - 1) - WINDOW * (m // 10) for m in (range(least, n + 1) if n >= least else (n,))]
    return max(1, min(spared))


def agreed(match: np.ndarray, least: int = MIN_WORDS) -> int:
    """Words of the longest passage, from a matching word to a matching word, in which at most one in ten differs.

    0 where no such passage has ``least`` words; a passage that is the whole item counts at any length.
    """
    n = len(match)
    if n == 0:
        return 0
    miss = np.concatenate([[0], np.cumsum(~match)])
    if miss[n] * 10 <= n:
        return n
    starts = np.flatnonzero(match)
    if n < least or len(starts) * 10 < 9 * least:
        return 0
    g = 10 * miss - np.arange(n + 1)
    ends, best = starts + 1, 0
    for at in range(0, len(starts), 512):  # a block of beginnings against all ends
        some = starts[at : at + 512, None]
        long = ends - some
        best = max(best, int(np.where((long >= least) & (g[ends] <= g[some]), long, 0).max(initial=0)))
    return best


def slack_of(n: int) -> int:
    """Diagonals that a passage of an item of ``n`` words may wander: a word put in or left out for each ten, four at least."""
    return max(4, n // 10 + 1)


def aligned(doc: np.ndarray, item: np.ndarray, at: int, slack: int) -> np.ndarray:
    """For each word of the item the position of its partner in the document, or -1: longest common subsequence near an alignment."""
    n = len(item)
    lo = max(0, at - slack)
    part = doc[lo : max(lo, at + n + slack)]
    m = len(part)
    eq = item[:, None] == part[None, :]
    score = np.zeros((n + 1, m + 1), np.int32)
    for i in range(1, n + 1):
        score[i, 1:] = np.maximum.accumulate(np.maximum(score[i - 1, :-1] + eq[i - 1], score[i - 1, 1:]))
    out, i, j = np.full(n, -1), n, m
    while i and j:
        if eq[i - 1, j - 1] and score[i, j] == score[i - 1, j - 1] + 1:
            out[i - 1] = lo + j - 1
            i, j = i - 1, j - 1
        elif score[i - 1, j] >= score[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def near(doc: np.ndarray, item: np.ndarray, at: int, slack: int) -> np.ndarray:
    """Which words of the item match on any alignment within ``slack`` of one: no way through them matches more."""
    n = len(item)
    part = np.full(n + 2 * slack, -1, np.int64)
    lo, hi = max(0, at - slack), min(len(doc), at + n + slack)
    if lo < hi:
        part[lo - at + slack : hi - at + slack] = doc[lo:hi]
    return (np.lib.stride_tricks.sliding_window_view(part, n) == item).any(axis=0)


def straight(doc: np.ndarray, item: np.ndarray, at: int) -> np.ndarray:
    """For each word of the item its partner on one alignment, or -1."""
    lo, hi = max(0, -at), max(0, -at, min(len(item), len(doc) - at))
    out = np.full(len(item), -1)
    same = item[lo:hi] == doc[at + lo : at + hi]
    out[lo:hi][same] = np.flatnonzero(same) + at + lo
    return out


def passage(doc: np.ndarray, item: np.ndarray, groups: np.ndarray, at: int, slack: int, least: int) -> tuple[int, np.ndarray]:
    """(words, partners) of the best passage near an alignment: on it, or with words put in or left out where that can give more."""
    partner = straight(doc, item, at)
    got = agreed(np.logical_and.reduceat(partner >= 0, groups), least)
    if got < len(groups) and agreed(np.logical_and.reduceat(near(doc, item, at, slack), groups), least) > got:
        other = aligned(doc, item, at, slack)
        more = agreed(np.logical_and.reduceat(other >= 0, groups), least)
        if more > got:
            return more, other
    return got, partner


def bound(item: list[str], doc: list[str], partner: np.ndarray) -> bool:
    """Whether slots are filled consistently: each value of the item stands for one value of the document throughout."""
    values: dict[str, str] = {}
    return all(values.setdefault(w, doc[k]) == doc[k] for w, k in zip(item, partner) if k >= 0)


class Text:
    """A text read once: its words, raw and template codes and names; of an item also where its whitespace words begin."""

    def __init__(self, text: str, grouped: bool = False):
        bare = _bare(text)
        if grouped:
            parts = [p for p in map(words, text.split()) if p]
            self.words = [w for p in parts for w in p]
            self.groups = np.cumsum([0, *map(len, parts)])[:-1]
        else:
            self.words = _WORD.findall(bare.lower())
        self.raw = np.array([zlib.crc32(w.encode()) for w in self.words], np.int64)
        found = names(bare)
        canon = canonical(self.words)
        self.template = np.where(np.array([w in found for w in self.words], bool) & (canon > UNIT), NAME, canon) if found else canon
        hashes, at = templates(text)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at = hashes[order], at[order]


def compare(doc: Text, item: Text, least: int = MIN_WORDS) -> tuple[int, str]:
    """(words, kind) of the best passage of ``item`` in ``doc``: kind is leaked, re-parameterised or empty."""
    n, count = len(item.raw), len(item.groups)
    if not n:
        return 0, ""
    lo, hi = np.searchsorted(doc.hashes, item.hashes, "left"), np.searchsorted(doc.hashes, item.hashes, "right")
    diagonals = {int(d) for k in np.flatnonzero(hi > lo) for d in doc.at[lo[k] : hi[k]] - item.at[k]}
    slack, best, altered, seen = slack_of(n), 0, 0, -(1 << 60)
    for at in sorted(diagonals):
        if at <= seen:
            continue
        best = max(best, passage(doc.raw, item.raw, item.groups, at, 2 * slack, least)[0])
        if best == count:
            break
        if not best:
            got, partner = passage(doc.template, item.template, item.groups, at, 2 * slack, least)
            if got > altered and bound(item.words, doc.words, partner):
                altered = got
        seen = at + slack if at - slack >= 0 else at  # what lies within the slack was aligned along with it
    return (best, "leaked") if best else (altered, "re-parameterised" if altered else "")


LEAKS = "doc_id long, item_id long, words int, kind string"


def _windows(rows: DataFrame, key: str, of_items: bool) -> DataFrame:
    """(k, h, at) of every template window of each text; of items also the windows a passage must share and its slack."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if of_items:
                for k, t in zip(b["k"], b["text"]):
                    (h, at), n = templates(t), sum(1 for p in t.split() if words(p))
                    yield pd.DataFrame({"k": k, "h": h, "at": at.astype(np.int32), "need": np.int32(least_windows(n)), "slack": np.int32(slack_of(n))})
            else:
                parts = [templates(t) for t in b["text"]]
                yield pd.DataFrame({"k": b["k"], "h": [h for h, _ in parts], "at": [at.astype(np.int32) for _, at in parts]})

    schema = "k long, h long, at int, need int, slack int" if of_items else "k long, h array<long>, at array<int>"
    out = rows.select(F.col(key).cast("long").alias("k"), "text").mapInPandas(run, schema)
    return out.distinct() if of_items else out.select("k", F.inline(F.arrays_zip("h", "at")))


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it was counted and is small, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, item): pairs that share as many template windows as a passage must leave whole, close to one alignment.

    The windows of a passage wander over no more alignments than its slack; bands of twice that width, laid over each
    other by half, have one that holds them all.
    """
    asked = cut(_windows(items, "item_id", True).withColumnsRenamed({"k": "item", "at": "offset"}))
    hits = _windows(docs, "doc_id", False).withColumnsRenamed({"k": "doc"}).join(_small(asked), "h")
    line = F.col("at") - F.col("offset")
    bands = F.array(F.floor(line / (2 * F.col("slack"))) * 2, F.floor((line + F.col("slack")) / (2 * F.col("slack"))) * 2 + 1)
    banded = hits.select("doc", "item", "need", F.explode(bands).alias("band"))
    shared = banded.groupBy("doc", "item", "band").agg(F.count(F.lit(1)).alias("hits"), F.min("need").alias("need")).filter("hits >= need")
    return shared.select("doc", "item").distinct()


def leaks(docs: DataFrame, items: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, words, kind): the documents (doc_id, text) that hold an item (item_id, text) whole or ``least`` of its words in a row.

    ``kind`` is ``leaked`` where the words agree but for one in ten, ``re-parameterised`` where they do so only with
    numbers, units and names taken for placeholders that are filled consistently. Neither documents nor items reach the
    driver. Only pairs that share enough windows bring their texts together. Null ids and null or empty texts give
    nothing; repeated documents and items count once; items with one text leak together; an item of fewer than
    ``WINDOW`` words has no window and is never found. Extra columns are not read.
    """
    source = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    asked = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    pairs = cut(candidates(source, asked))
    told = asked.select(F.col("item_id").alias("item"), F.col("text").alias("item_text")).distinct()
    joined = source.join(_small(pairs), F.col("doc_id") == F.col("doc")).join(told, "item")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: dict[str, Text] = {}
        recent: dict[str, Text] = {}
        for b in batches:
            rows = []
            for d, i, text, item in zip(b["doc_id"], b["item"], b["text"], b["item_text"]):
                if item not in read:
                    if len(read) > 20_000:
                        read.clear()
                    read[item] = Text(item, True)
                if text not in recent:
                    if len(recent) >= 64:
                        recent.clear()
                    recent[text] = Text(text)
                n, kind = compare(recent[text], read[item], least)
                if n:
                    rows.append((d, i, n, kind))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "kind"])

    found = joined.select("doc_id", "item", "text", "item_text").mapInPandas(run, LEAKS)
    best = F.max(F.struct((F.col("kind") == "leaked").alias("sure"), "words", "kind")).alias("v")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "v.words", "v.kind")
