"""Queries over evaluation passages in the corpus (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import leakage as L
from lodeworks.tables import load, spread


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.leaks(spread(load(spark, sf_dir, "documents")), load(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).filter("kind = 'leaked'").select("doc_id", "item_id")


def p9_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite and item the number of documents that leak it or hold it with other numbers, units and names."""
    items = load(spark, sf_dir, "eval_items").select(F.col("item_id").alias("_i"), "suite")
    found = p9_leaks(spark, sf_dir)
    return found.join(items, F.col("item_id") == F.col("_i")).groupBy("suite", "item_id").agg(F.sum((F.col("kind") == "leaked").cast("long")).alias("documents"), F.sum((F.col("kind") != "leaked").cast("long")).alias("altered"), F.max("words").alias("most_words"))


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks, "p9_leaked_items": p9_leaked_items}
ORACLES: dict = {}
