"""Abusive, hateful and sexual content by a chain of linear classifiers (problem 10).

Sentences are read through the usual disguises (look-alike letters, digits for letters, spaced or starred words).
Labels are given per document, so the sentences that carry them are found first, by a linear model trained twice:
on all sentences of labelled documents, then on those it holds for the cause. The categories follow in a fixed order,
each a logistic regression that sees the probabilities of the categories before it; in training those come from
models fitted on other folds. A document's score is that of its worst sentence, over its whole text.

The models are fitted on at most ``SAMPLE`` labelled documents; every document is scored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.tables import spread

CATEGORIES = ("insult", "threat", "hate", "sexual")
#: Labelled documents the models are fitted on, at most.
SAMPLE = 8_000
DIMENSIONS = 1 << 18
#: The first columns are those of lexicon hits; they weigh more than words and pieces of words.
MARKS, MARK_WEIGHT = 1 << 10, 2.5
FOLDS = 3
_LOOKALIKE = str.maketrans("асеорхуіјѕԁһкмтвнгпиАСЕОРХУІЈЅКМТВНαεορτυικν", "aceopxyijsdhkmtbhrnuACEOPXYIJSKMTBHaeoptuikv")
_LEET = str.maketrans("0134578@$!€|", "oieastbasiel")
_HIDDEN = re.compile("[­​-‏⁠﻿‪-‮]")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ ._\-*·])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
_STARRED = re.compile(r"(?<=[^\W\d_])[*#%~^·_]+(?=[^\W\d_])")
_STARS, _LETTERLIKE = re.compile("[*#%~^·_]"), re.compile("[0134578@$!€|]")
#: Two letters that stand alone one after the other; spaced words hold such.
_APART = re.compile(r"[ ._\-*·][^\W\d_][ ._\-*·]|^[^\W\d_][ ._\-*·]")
_MIXED = re.compile(r"(?<![\w@$!|€])(?=[\w@$!|€]*[^\W\d_])(?=[\w@$!|€]*[\d@$!|€])[\w@$!|€]+(?![\w@$|€])")
_LONG = re.compile(r"([^\W\d_])\1+")
#: Abusive vocabulary in four languages, in plain letters; stems end in an asterisk. Fixed values, a prior for few labels:
#: with 4,000 labelled documents the held-out F1 without any of it is the same.
LEXICON = {
    "abuse": "idiot* moron* cretin* imbecil* stupid* dumb dumbass* asshole* arsehole* bastard* bitch* scum scumbag* loser* parasite* clown* freak* pig pigs worthless useless pathetic disgusting brainless spineless garbage trash filth* shithead* dickhead* jerk* retard* fool* fucking fuck fucker* shit* stfu crap ass ugly coward* liar* vollidiot* schwachkopf* trottel* depp* arschloch* wichser* mistkerl* dummkopf* penner* versager* abschaum drecks* schei* fresse maul erbarmlich* hirnlos* nutzlos* wertlos* connard* connasse* salaud* salope* abruti* cretin* debil* gueule minable* merde* ordure* bouffon* encule* gilipollas idiota* estupid* cabron* pendej* tont* inutil* mierda basura imbecil* cretino* subnormal*",
    "threat": "kill* murder* beat* stab* shoot* burn* bleed* hurt* destroy* smash* crush* strangle* choke* die dead bullet* knife punch* hunt* schlage* schlag umbring* tote* toten verprugel* brech* messer verbren* finde tuer frapper creve* mort brule* romper matar mato golpe* quemar muert* paliza",
    "hate": "vermin* subhuman* exterminate* filthy rot cockroach* infest* deport* inferior ungeziefer untermensch* abschaum parasiten ausrotten vergasen vermine* nuisible* exterminer vermin racaille escoria* alimana* exterminar sucios",
    "sexual": "nude* naked nudes boob* tits tit breasts cock dick pussy horny fuck suck* blowjob* cum sexy sex ass thong panties nackt* titten brust* ficken geil schwanz muschi blas* ausziehen hure* nue nues seins bite baiser sucer cul deshabil* desnud* tetas polla follar chupar cono culo desvist*",
}
YOU = frozenset("you your yours yourself u ur youre du dich dir dein deine deinen deiner deinem euch ihr tu te toi ton ta tes vous votre vos tus ti contigo usted eres everyone nobody somebody whoever whoevr".split())


def _lexicon() -> tuple[dict[str, set[str]], list[tuple[str, str]]]:
    whole: dict[str, set[str]] = defaultdict(set)
    stems = []
    for kind, words in LEXICON.items():
        for w in words.split():
            bare = re.sub(r"([a-z])\1+", r"\1", w.rstrip("*"))
            if w.endswith("*"):
                stems.append((bare, kind))
            whole[bare].add(kind)
    return whole, sorted(stems)


_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_BREAK = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|\n+")
_LISTED = re.compile(r"^(?:\s*(?:\[[\w\-]{1,12}\]|[-*>#|]+|\d+[.)])\s*)+")


def sentences(text: str) -> list[str]:
    """The sentences of a text; a very long stretch without an end is one sentence."""
    return [s for s in (_LISTED.sub("", p).strip() for p in _BREAK.split(text or "")) if s]


_WHOLE, _STEMS = _lexicon()
_LENGTHS = sorted({len(x) for x, _ in _STEMS})
_STEM_KINDS: dict[str, set[str]] = defaultdict(set)
for _x, _k in _STEMS:
    _STEM_KINDS[_x].add(_k)


def kinds_of(word: str) -> set[str]:
    """The parts of the lexicon that a word in plain letters, without doubled ones, belongs to."""
    out = set(_WHOLE.get(word, ()))
    for n in _LENGTHS:
        if n <= len(word):
            out |= _STEM_KINDS.get(word[:n], set())
    return out


_PATTERN = re.compile(r"[^\W\d_]+(?:[*#%~^]+[^\W\d_]+)+|[^\W\d_]{2,}[*]+(?![\w*])")


def _unstar(m: re.Match) -> str:
    """The word of the lexicon that fits a starred word, else the word without its stars."""
    bare = re.sub(r"([a-z])\1+", r"\1", m[0].lower())
    shape = re.compile(re.sub(r"[*#%~^]+", "[a-z]{1,3}", bare))
    for w in _BY_FIRST.get(bare[:1], ()):
        if shape.match(w):
            return w
    return re.sub(r"[*#%~^]", "", m[0])


def _parted(word: str) -> list[str]:
    """A run of letters as words of the lexicon, longest first; empty where it is none."""
    for i in range(len(word), 1, -1):
        if word[:i] in _WHOLE:
            rest = _parted(word[i:]) if i < len(word) else []
            if rest or i == len(word):
                return [word[:i], *rest]
    return []


def _close_up(m: re.Match) -> str:
    """Spaced letters as a word, or as several where the lexicon has them, after one letter that may stand alone."""
    word = m[0].replace(m[1], "")
    bare = re.sub(r"([a-z])\1+", r"\1", word.lower())
    parts = _parted(bare) or ([bare[0], *_parted(bare[1:])] if _parted(bare[1:]) else [])
    return " ".join(parts) or word


_BY_FIRST: dict[str, list[str]] = defaultdict(list)
for _w in sorted(_WHOLE):
    _BY_FIRST[_w[:1]].append(_w)


def plain(sentence: str) -> str:
    """A sentence in lower case and without disguises or accents."""
    s = sentence
    if not s.isascii():
        s = _HIDDEN.sub("", unicodedata.normalize("NFKC", s)).translate(_LOOKALIKE)
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    if _APART.search(s):
        s = _SPACED.sub(_close_up, s)
    if "*" in s or "#" in s or "~" in s or "^" in s or "%" in s:
        s = _PATTERN.sub(_unstar, s)
    if _STARS.search(s):
        s = _STARRED.sub("", s)
    if _LETTERLIKE.search(s):
        s = _MIXED.sub(lambda m: m[0].translate(_LEET) if sum(c.isalpha() for c in m[0]) * 2 >= len(m[0]) else m[0], s)
    return _LONG.sub(r"\1", s.lower())


def _column(name: str) -> int:
    return MARKS + zlib.crc32(name.encode()) % (DIMENSIONS - MARKS)


def _mark(name: str) -> int:
    return zlib.crc32(name.encode()) % MARKS


_seen: dict[str, tuple[tuple[int, ...], tuple[str, ...]]] = {}


def _of_word(w: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """(columns, parts of the lexicon) of a word."""
    known = _seen.get(w)
    if known is None:
        padded = f"<{w}>"
        grams = {padded[i : i + 4] for i in range(len(padded) - 3)} if 4 <= len(w) <= 40 else set()
        kinds = tuple(sorted(kinds_of(w)))
        known = ((_column(f"w:{w}"), *(_column(f"c:{g}") for g in grams), *(_mark(f"k:{k}") for k in kinds)), kinds)
        if len(_seen) > 200_000:
            _seen.clear()
        _seen[w] = known
    return known


def features(sentence: str) -> list[int]:
    """Hashed words, pairs of neighbouring words, four-letter pieces and lexicon hits of a sentence, each once."""
    words = ["#" if w.isdigit() else w for w in _WORD.findall(plain(sentence))]
    known = [_of_word(w) for w in words]
    out = {i for ids, _ in known for i in ids}
    out.update(_column(f"b:{a} {b}") for a, b in zip(words, words[1:]))
    kinds = [k for _, part in known for k in part]
    if kinds:
        you = any(w in YOU for w in words)
        out.update(_mark(f"m:{k} {min(kinds.count(k), 3)} {you}") for k in set(kinds))
        out.add(_mark(f"t:{min(len(kinds), 4)} {you}"))
    return sorted(out)


class Rows:
    """Sparse binary rows, scaled by the root of their length; short sentences are not scaled up. Pickled without what follows."""

    def __init__(self, lists: list[list[int]]):
        size = np.array([len(x) for x in lists], np.int64)
        self._set(size, np.fromiter((i for x in lists for i in x), np.int64, int(size.sum())))

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        return self.size.astype(np.int32), self.index.astype(np.int32)

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        self._set(*(x.astype(np.int64) for x in state))

    def _set(self, size: np.ndarray, index: np.ndarray) -> None:
        self.size, self.index = size, index
        self.row = np.repeat(np.arange(len(size)), size)
        self.value = np.repeat(1 / np.sqrt(np.maximum(self.size, 30)), self.size).astype(np.float32)
        self.value[self.index < MARKS] *= MARK_WEIGHT
        self.start = np.concatenate([[0], np.cumsum(self.size)])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index] * self.value, len(self.size))


def fit(rows: Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, take: np.ndarray, epochs: int = 12, rate: float = 0.5, decay: float = 2e-6, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression by Adagrad over the rows ``take``: weights of the hashed and of the extra columns (with bias).

    The rows are put into batches once; each epoch takes the batches in another order.
    """
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(DIMENSIONS, np.float32), np.full(DIMENSIONS, 1e-4, np.float32)
    v, h2 = np.zeros(extra.shape[1] + 1), np.full(extra.shape[1] + 1, 1e-4)
    v[-1] = -2.0
    dense = np.column_stack([extra, np.ones(len(extra))])
    order, batches = rng.permutation(take), []
    for at in range(0, len(order), 512):
        b = order[at : at + 512]
        n = rows.size[b]
        pos = np.repeat(rows.start[b] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        uniq, inverse = np.unique(rows.index[pos], return_inverse=True)
        batches.append((b, uniq, inverse.astype(np.int32), rows.value[pos], np.repeat(np.arange(len(b), dtype=np.int32), n)))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            b, uniq, inverse, val, local = batches[k]
            now = w[uniq]
            z = np.bincount(local, now[inverse] * val, len(b)) + dense[b].dot(v)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) * weight[b]
            grad = np.bincount(inverse, err[local] * val, len(uniq)) / 32 + decay * now
            g2[uniq] += grad**2
            w[uniq] -= rate * grad / np.sqrt(g2[uniq])
            gd = dense[b].T.dot(err) / 32
            h2 += gd**2
            v -= rate * gd / np.sqrt(h2)
    return w, v


def _prob(rows: Rows, extra: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    z = rows.dot(model[0]) + np.column_stack([extra, np.ones(len(extra))]).dot(model[1])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """The fitted models in order, with the threshold found on held-out folds and the F1 reached there."""

    def __init__(self, models: list, threshold: float, held_out: float):
        self.models, self.threshold, self.held_out = models, threshold, held_out

    def probabilities(self, lists: list[list[int]]) -> np.ndarray:
        rows, p = Rows(lists), np.zeros((len(lists), 0))
        for m in self.models:
            p = np.column_stack([p, _prob(rows, p, m)])
        return p


def any_of(p: np.ndarray) -> np.ndarray:
    """Probability of at least one category, as if they were independent."""
    return 1 - np.prod(1 - p, axis=1)


def decide(labels: list[tuple[str | None, float | None]]) -> str | None:
    """One label from several raters: the category most of them gave; a tie goes to the sum of scores. None if nobody gave a known one."""
    votes: Counter = Counter()
    score: defaultdict = defaultdict(float)
    for label, s in labels:
        name = (label or "").strip().lower()
        if name in CATEGORIES or name == "none":
            votes[name] += 1
            score[name] += s if s is not None and s == s else 0.5
    return max(votes, key=lambda k: (votes[k], score[k], k)) if votes else None


Task = tuple  # what fit takes after the rows: extra, y, weight, take, epochs
Runner = Callable[[Rows, list[Task]], list[tuple[np.ndarray, np.ndarray]]]


def here(rows: Rows, tasks: list[Task]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Fits one after the other in this process."""
    return [fit(rows, *t) for t in tasks]


def on_executors(spark: SparkSession) -> Runner:
    """Fits as tasks of the cluster, one each; the rows of the bounded sample are broadcast once."""
    held: dict[int, object] = {}

    def run(rows: Rows, tasks: list[Task]) -> list[tuple[np.ndarray, np.ndarray]]:
        if id(rows) not in held:
            held[id(rows)] = spark.sparkContext.broadcast(rows)
        sent = held[id(rows)]

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for k in b["id"]:
                    w, v = fit(sent.value, *tasks[k])
                    at = np.flatnonzero(w).astype(np.int32)
                    yield pd.DataFrame({"id": [k], "at": [at.tobytes()], "w": [w[at].tobytes()], "v": [v.tobytes()]})

        out = [(np.zeros(DIMENSIONS, np.float32), np.zeros(0))] * len(tasks)
        for r in spark.range(0, len(tasks), 1, len(tasks)).mapInPandas(work, "id long, at binary, w binary, v binary").collect():
            w = np.zeros(DIMENSIONS, np.float32)
            w[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["w"], np.float32)
            out[r["id"]] = (w, np.frombuffer(r["v"], np.float64))
        return out

    return run


def train(texts: list[str], labels: list[str], run: Runner = here) -> Chain | None:
    """A chain from labelled documents; None where there is no positive or no negative document."""
    read = [[features(s) for s in sentences(t)] for t in texts]
    return train_read(read, labels, run)


def train_read(read: list[list], labels: list[str], run: Runner = here) -> Chain | None:
    """``train`` from the feature lists of each document's sentences."""
    texts = read
    doc, lists = [d for d, part in enumerate(read) for _ in part], [x for part in read for x in part]
    if not lists or not set(labels) & set(CATEGORIES) or "none" not in labels:
        return None
    doc, rows = np.array(doc), Rows(lists)
    kind = np.array(labels, object)[doc]
    positive = kind != "none"
    fold = np.array([zlib.crc32(f"{d}".encode()) % FOLDS for d in range(len(texts))])[doc]
    none = np.zeros((len(lists), 0))
    every = np.arange(len(lists))
    count = np.bincount(doc, minlength=len(texts))[doc]
    # first the sentences that make a document positive; a background sentence is one in negative documents too
    cause = positive.copy()
    weight = np.where(positive, 1.0 / np.sqrt(count), 1.0)
    for _ in range(3):
        p = np.zeros(len(lists))
        for f, model in enumerate(run(rows, [(none, cause.astype(float), weight, every[fold != f], 5) for f in range(FOLDS)])):
            p[fold == f] = _prob(rows, none, model)[fold == f]
        top = np.zeros(len(texts))
        np.maximum.at(top, doc, p)
        cause = positive & ((p >= 0.5) | (p >= top[doc]) & (p > 0.05))
        weight = np.where(positive & ~cause, 0.3, 1.0)
    # then the chain; in training each category sees out-of-fold probabilities of those before it
    before, models = np.zeros((len(lists), 0)), []
    for c in CATEGORIES:
        y = (cause & (kind == c)).astype(float)
        out = np.zeros(len(lists))
        *held, whole = run(rows, [(before, y, weight, every[fold != f]) for f in range(FOLDS)] + [(before, y, weight, every)])
        for f, model in enumerate(held):
            out[fold == f] = _prob(rows, before, model)[fold == f]
        models.append(whole)
        before = np.column_stack([before, out])
    top = np.zeros(len(texts))
    np.maximum.at(top, doc, any_of(before))
    truth = np.array([x != "none" for x in labels])
    best = (0.0, 0.0, 0.5)
    for t in np.arange(0.3, 0.71, 0.05):
        hit = (top >= t) & truth
        f1 = 2 * hit.sum() / max(1, (top >= t).sum() + truth.sum())
        best = max(best, (round(float(f1), 3), float(-abs(t - 0.5)), float(t)))
    return Chain(models, best[2], best[0])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """A chain from ``labels`` (doc_id, label, score) on ``docs`` (doc_id, text), on at most ``sample`` documents.

    Where more are labelled, those whose id hashes lowest are taken. Null ids, texts and unknown labels are left out.
    Sentences are read and models fitted on the executors; the driver holds the features of the sample, not its texts.
    """
    rated = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", "label", F.col("score").cast("double").alias("score"))
    ids = rated.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(sample)
    some = rated.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("label", "score")).alias("rated"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            label = [decide([(x["label"], x["score"]) for x in r]) for r in b["rated"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": label, "read": [[np.array(features(s), np.int32).tobytes() for s in sentences(t)] if x else [] for t, x in zip(b["text"], label)]})

    joined = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = sorted((r for r in spread(joined).mapInPandas(read, "doc_id long, label string, read array<binary>").collect() if r["label"]), key=lambda r: (r["doc_id"], r["read"]))
    return train_read([[np.frombuffer(x, np.int32).tolist() for x in r["read"]] for r in rows], [r["label"] for r in rows], on_executors(docs.sparkSession))


SCORES = "doc_id long, source string, score double, insult double, threat double, hate double, sexual double, flagged boolean, worst string"


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """One row per document: its probabilities by category, the score, whether it passes the threshold, the worst sentence.

    Empty and null texts score 0. Documents without id are scored too. A missing chain (no labels) scores all 0.
    Documents are not shuffled; extra columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}  # sentences come again and again
        for b in batches:
            n = len(b)
            doc, parts = [], []
            for d, t in enumerate(b["text"]):
                for s in sentences(t):
                    doc.append(d)
                    parts.append(s)
            best, worst = np.zeros((n, len(CATEGORIES))), [""] * n
            top = np.zeros(n)
            if parts and chain is not None:
                if len(known) > 100_000:
                    known.clear()
                new = list(dict.fromkeys(s for s in parts if s not in known))
                for k in range(0, len(new), 20_000):
                    known.update(zip(new[k : k + 20_000], chain.probabilities([features(s) for s in new[k : k + 20_000]])))
                p = np.array([known[s] for s in parts])
                np.maximum.at(best, np.array(doc), p)
                total = any_of(p)
                np.maximum.at(top, np.array(doc), total)
                for d, s, x in zip(doc, parts, total):
                    if x >= chain.threshold and x >= top[d]:
                        worst[d] = s
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": top, **{c: best[:, k] for k, c in enumerate(CATEGORIES)}, "flagged": top >= chain.threshold if chain is not None else np.zeros(n, bool), "worst": worst})

    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, SCORES)
