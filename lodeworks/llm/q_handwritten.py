"""Queries over generated, minified, vendored and data files (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import handwritten as H
from lodeworks.tables import load, spread


#: Notices of the workspaces' own project.
OWN = r"copyright [\w\- ]*workspace contributors"


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.classify(spread(load(spark, sf_dir, "file_contents")), load(spark, sf_dir, "files"), OWN)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_kinds(spark, sf_dir).filter(F.col("kind") != "").select("path")


def p3_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that remain, with the language and complexity of their latest scan."""
    latest = load(spark, sf_dir, "files").filter(F.col("path").isNotNull()).groupBy(F.col("path").alias("_p")).agg(F.max_by(F.struct("language", "complexity"), F.struct("modified", "size", "language", "complexity")).alias("f"))
    kept = p3_kinds(spark, sf_dir).filter(F.col("kind") == "")
    return kept.join(latest, F.col("path") == F.col("_p"), "left").select("path", "repo", "f.language", "f.complexity")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per repository and kind."""
    return p3_kinds(spark, sf_dir).groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("files"))


QUERIES = {"p3_found": p3_found, "p3_kinds": p3_kinds, "p3_handwritten": p3_handwritten, "p3_rates": p3_rates}
ORACLES: dict = {}
