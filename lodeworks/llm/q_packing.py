"""Queries over packed documents (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import packing as P
from lodeworks.tables import load, spread


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pack_documents(spread(load(spark, sf_dir, "documents")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, unused tokens and the least number of containers that could hold them."""
    per = p8_packed(spark, sf_dir).filter("container IS NOT NULL").groupBy("container").agg(F.sum("size").alias("used"))
    t = per.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return t.select("containers", "tokens", "fullest", (F.col("containers") * P.CAPACITY - F.col("tokens")).alias("unused"), F.ceil(F.col("tokens") / P.CAPACITY).alias("at_least"))


QUERIES = {"p8_packed": p8_packed, "p8_fill": p8_fill}
ORACLES: dict = {}
