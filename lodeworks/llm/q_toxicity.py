"""Queries over abusive content (problem 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import toxicity as X
from lodeworks.tables import load, spread


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return X.score(docs, X.learn(docs, load(spark, sf_dir, "doc_labels")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).filter("flagged").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, flagged documents and their share by source."""
    s = p10_scores(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("flagged").cast("long")).alias("flagged"))
    return s.withColumn("rate", F.col("flagged") / F.col("documents"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
ORACLES: dict = {}
