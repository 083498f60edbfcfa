"""Queries over similar vectors (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import neighbours as N
from lodeworks.plans.lineage import cut
from lodeworks.tables import load


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "handling_vectors").select("path", "qwen3_vector", "qwen3_dim", "qwen3_version")
    return t.filter(N.sound(F.col("qwen3_vector"), 64) & (F.col("qwen3_dim") == 64) & F.col("qwen3_version").isNotNull())


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "handling_vectors").select("path", "tfidf_vector")
    return t.filter(N.sound(F.col("tfidf_vector"), 384))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of paths with at least 0.95 cosine.

    Exact copies are searched once. A class of up to 11 copies comes as all its pairs, and each member stands in the
    pairs of the class; a larger one comes as pairs with its representative (``p2_copies`` has the membership).
    """
    rows = _dense(spark, sf_dir)
    version = F.col("qwen3_version")
    vectors = cut(N.distinct_vectors(rows, "path", "qwen3_vector", version).withColumn("id", F.monotonically_increasing_id()))
    near = N.pairs_within(spark, vectors, 0.95).select(F.col("rep").alias("a"), F.col("other").alias("b"))
    # a class of copies pairs all its members while it is small, else each with its representative
    copied = vectors.filter("copies > 1")
    sizes = copied.select(F.col("rep").alias("_rep"), "copies")
    inside = N.members(rows, "path", "qwen3_vector", version, copied).join(sizes, F.col("rep") == F.col("_rep")).select("rep", "key", "copies")
    x, y = inside.alias("x"), inside.select(F.col("rep").alias("r2"), F.col("key").alias("k2")).alias("y")
    small = x.filter("copies <= 11").join(y, (F.col("rep") == F.col("r2")) & (F.col("key") < F.col("k2"))).select(F.col("key").alias("p"), F.col("k2").alias("q"))
    star = inside.filter("copies > 11 AND key != rep").select(F.col("rep").alias("p"), F.col("key").alias("q"))
    # copies of either end stand in the pairs of their representatives
    few = inside.filter("copies <= 11")
    left = near.join(few.select(F.col("rep").alias("ra"), F.col("key").alias("ka")), F.col("a") == F.col("ra"), "left").select(F.coalesce("ka", "a").alias("p"), "b")
    both = left.join(few.select(F.col("rep").alias("rb"), F.col("key").alias("kb")), F.col("b") == F.col("rb"), "left").select("p", F.coalesce("kb", "b").alias("q"))
    every = both.unionByName(small).unionByName(star)
    return every.select(F.least("p", "q").alias("path_a"), F.greatest("p", "q").alias("path_b")).distinct()


def _searched(spark: SparkSession, rows: DataFrame, vector: str, group, k: int = 10) -> DataFrame:
    vectors = cut(N.distinct_vectors(rows, "path", vector, group))
    queries = vectors.filter(F.pmod(F.xxhash64("rep"), F.lit(100)) == 0)
    return N.nearest(spark, vectors, queries, k)


def p2_nearest_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar dense vectors of each path whose hash is divisible by 100, against all."""
    return _searched(spark, _dense(spark, sf_dir), "qwen3_vector", F.col("qwen3_version"))


def p2_nearest_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the lexical vectors, which have no version."""
    return _searched(spark, _lexical(spark, sf_dir), "tfidf_vector", F.lit("all"))


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of exact copies: every path with the representative of its vector."""
    rows = _dense(spark, sf_dir)
    vectors = N.distinct_vectors(rows, "path", "qwen3_vector", F.col("qwen3_version"))
    return N.members(rows, "path", "qwen3_vector", F.col("qwen3_version"), vectors.filter("copies > 1"))


QUERIES = {"p2_found": p2_found, "p2_nearest_dense": p2_nearest_dense, "p2_nearest_lexical": p2_nearest_lexical, "p2_copies": p2_copies}
_DENSE = """
WITH v AS (SELECT DISTINCT path, qwen3_version AS ver, qwen3_vector::DOUBLE[] AS x FROM handling_vectors
  WHERE len(qwen3_vector) = 64 AND qwen3_dim = 64 AND qwen3_version IS NOT NULL
    AND len(list_filter(qwen3_vector, lambda e: e IS NOT NULL AND isfinite(e))) = 64 AND len(list_filter(qwen3_vector, lambda e: e <> 0)) > 0)
"""
ORACLES = {
    "p2_found": _DENSE + "SELECT a.path AS path_a, b.path AS path_b FROM v a JOIN v b ON a.ver = b.ver AND a.path < b.path WHERE list_cosine_similarity(a.x, b.x) >= 0.95",
    "p2_copies": _DENSE + ", c AS (SELECT ver, x, min(path) AS rep FROM v GROUP BY ver, x HAVING count(*) > 1) SELECT v.path AS key, c.rep FROM v JOIN c ON c.ver = v.ver AND c.x = v.x",
}
