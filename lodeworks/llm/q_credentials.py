"""Queries over credentials in source text (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import credentials as C
from lodeworks.tables import load, spread


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("versions", "id", "content"), ("handling_vectors", "path", "content_snippet")]
    v, h = (C.find(spread(load(spark, sf_dir, t).select(k, x)), k, x).withColumn("record_table", F.lit(t)) for t, k, x in parts)
    return v.unionByName(h)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("record_table", "record_key", "line_no").distinct()


def p6_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).groupBy("record_table", "kind").agg(F.count(F.lit(1)).alias("found"), F.countDistinct("record_key").alias("records"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text changes when its credentials are blanked out, with the new text; repeated rows once."""
    parts = []
    for table, key, text in (("versions", "id", "content"), ("handling_vectors", "path", "content_snippet")):
        rows = spread(load(spark, sf_dir, table).filter(F.col(text).isNotNull()).select(F.col(key).alias("record_key"), F.col(text).alias("text")))
        out = C.redacted(rows, "text").filter(F.col("redacted") != F.col("text"))
        parts.append(out.select(F.lit(table).alias("record_table"), "record_key", "redacted"))
    return parts[0].unionByName(parts[1]).distinct()


QUERIES = {"p6_found": p6_found, "p6_by_kind": p6_by_kind, "p6_redacted": p6_redacted}
ORACLES: dict = {}
