"""Lexical, dense and hybrid retrieval over an indexed corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.functions import text as T
from lodeworks.operators.history import numbered

RRF = 60
#: Query vectors that one pass broadcasts, about.
QUERY_BLOCK = 10_000


def dot(a: Column, b: Column) -> Column:
    """Product of two vectors in double precision; 0 where their lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def rank(scored: DataFrame, by: str, tie: str, name: str, within: list[str], most: int | None = None) -> DataFrame:
    """1-based ranks per ``within`` by ``by`` descending, ties by ``tie``.

    ``most`` cuts each ranking, before the shuffle where it can. Without it a ranking may be as long as the corpus
    and is numbered in pieces.
    """
    if most is None:
        return numbered(scored.withColumn("_by", -F.col(by)), within, "_by", [tie], name).drop("_by")
    w = Window.partitionBy(*within).orderBy(F.desc(by), tie)
    return scored.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= most)


def lexical(docs: DataFrame, queries: DataFrame, key: str, qkey: str, text: str = "text", block: int = QUERY_BLOCK) -> DataFrame:
    """(qkey, key, score) of every document that shares a column with a query; one row per key in both tables.

    The score is the cosine of the hashed vectors, plus a fifth of the share of query n-grams and a tenth of the share of
    query words that the document has, at most 1. The queries are a stated set, counted and taken in as many passes as
    keep what travels with the tasks under ``block``; a pass reads each document once, where it lies.
    """
    asked = queries.select(F.col(qkey).alias("_q"), T.words(F.col(text)).alias("_w"))
    passes = max(1, -(-asked.count() // block))
    kinds = f"{qkey} {queries.schema[qkey].dataType.simpleString()}, {key} {docs.schema[key].dataType.simpleString()}, score double"
    rows = docs.select(key, T.words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    out = []
    for n in range(passes):
        part = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("_q"), F.lit(passes)) == n)
        held = part.collect()
        names, lists = np.array([r["_q"] for r in held], object), [r["_w"] for r in held]

        def run(batches: Iterator[pd.DataFrame], names=names, lists=lists) -> Iterator[pd.DataFrame]:
            q = T.Hashed(lists)
            wanted: dict[tuple[str, bool], set[int]] = {}
            for k, t in enumerate(q.texts):
                wanted.setdefault((q.term(k), q.size[k] == 1), set()).add(int(t))
            sizes = [np.maximum(1, np.bincount([t for (_, w), ts in wanted.items() if w == word for t in ts], minlength=len(names))) for word in (True, False)]
            sought = np.unique(q.hashes)
            for b in batches:
                for k in range(0, len(b), 500):
                    d = b.iloc[k : k + 500]
                    h = T.Hashed(list(d["w"]))
                    score = h.rows.dot(q.rows.T)
                    meets = score > 0
                    found = {(int(h.texts[i]), h.term(i), bool(h.size[i] == 1)) for i in np.flatnonzero(np.isin(h.hashes, sought))}
                    for doc, term, word in found:
                        for t in wanted.get((term, word), ()):
                            score[doc, t] += (0.1 if word else 0.2) / sizes[0 if word else 1][t]
                    doc, t = np.nonzero(meets)
                    yield pd.DataFrame({qkey: names[t], key: d[key].to_numpy()[doc], "score": np.minimum(1.0, score[doc, t])})

        out.append(rows.mapInPandas(run, kinds))
    return reduce(DataFrame.unionByName, out)


def dense(vectors: DataFrame, queries: DataFrame, key: str, qkey: str, vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(qkey, key, similarity) of a stated set of query vectors against all rows.

    The queries are counted, and taken in as many passes as keep what is broadcast under ``block`` vectors.
    """
    q = queries.select(F.col(qkey), F.col(vector).alias("_q"))
    passes = max(1, -(-q.count() // block))
    parts = [q if passes == 1 else q.filter(F.pmod(F.xxhash64(qkey), F.lit(passes)) == n) for n in range(passes)]
    scored = [vectors.crossJoin(F.broadcast(p)).select(qkey, key, dot(F.col(vector), F.col("_q")).alias("similarity")) for p in parts]
    return reduce(DataFrame.unionByName, scored)


def dense_top(vectors: DataFrame, queries: DataFrame, key: str, qkey: str, most: int, vector: str = "embedding", digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """(qkey, key, similarity, place): the ``most`` best of each stated query by rounded product, ties by key.

    A batch of vectors meets a block of queries in one matrix product and keeps its own best; only those are ranked
    again. Vectors of another length than a query's have product 0.
    """
    q = queries.select(F.col(qkey).alias("_q"), F.col(vector).alias("_v")).filter("_v IS NOT NULL")
    passes = max(1, -(-q.count() // block))
    kinds = f"{qkey} {queries.schema[qkey].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, similarity double"
    rows = vectors.select(key, F.col(vector).alias("v")).filter("v IS NOT NULL")
    out = []
    for n in range(passes):
        held = (q if passes == 1 else q.filter(F.pmod(F.xxhash64("_q"), F.lit(passes)) == n)).collect()
        names, asked = [r["_q"] for r in held], [np.array(r["_v"], np.float64) for r in held]

        def run(batches: Iterator[pd.DataFrame], names=names, asked=asked) -> Iterator[pd.DataFrame]:
            for b in batches:
                lists, keys = [np.asarray(v, np.float64) for v in b["v"]], b[key].to_numpy()
                by_key = np.argsort(keys, kind="stable")
                score = np.zeros((len(names), len(lists)))
                for size in {len(v) for v in asked}:
                    i = [k for k, v in enumerate(asked) if len(v) == size]
                    j = [k for k, v in enumerate(lists) if len(v) == size]
                    if i and j:
                        score[np.ix_(i, j)] = np.stack([asked[k] for k in i]) @ np.stack([lists[k] for k in j]).T
                score = np.round(score, digits)[:, by_key]
                best = np.argsort(-score, axis=1, kind="stable")[:, :most]
                row = np.repeat(np.arange(len(names)), best.shape[1])
                col = best.ravel()
                yield pd.DataFrame({qkey: np.array(names, object)[row], key: keys[by_key][col], "similarity": score[row, col]})

        out.append(rows.mapInPandas(run, kinds))
    return rank(reduce(DataFrame.unionByName, out), "similarity", key, "place", [qkey], most)


def fused(a: DataFrame, b: DataFrame, qkey: str, key: str, a_rank: str, b_rank: str, k: int = RRF) -> DataFrame:
    """(qkey, key, score): reciprocal-rank fusion of two rankings by a full outer join."""
    left = a.select(F.col(qkey).alias("_qa"), F.col(key).alias("_a"), F.col(a_rank).alias("_ra"))
    right = b.select(F.col(qkey).alias("_qb"), F.col(key).alias("_b"), F.col(b_rank).alias("_rb"))
    both = left.join(right, (F.col("_qa") == F.col("_qb")) & (F.col("_a") == F.col("_b")), "full_outer")
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return both.select(F.coalesce("_qa", "_qb").alias(qkey), F.coalesce("_a", "_b").alias(key), (part("_ra") + part("_rb")).alias("score"))
