"""Queries over functions and their documentation (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import docpairs as D
from lodeworks.tables import load


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.pairs(load(spark, sf_dir, "extracted_units"), load(spark, sf_dir, "file_contents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_pairs(spark, sf_dir).select("file_path", "start_line")


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documented functions per extension."""
    ext = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)).alias("extension")
    units = load(spark, sf_dir, "extracted_units").select("file_path", "start_line").distinct().groupBy(ext).agg(F.count(F.lit(1)).alias("functions"))
    found = p7_found(spark, sf_dir).groupBy(ext).agg(F.count(F.lit(1)).alias("documented"))
    return units.join(found, "extension", "left").select("extension", "functions", F.coalesce("documented", F.lit(0)).cast("long").alias("documented"))


QUERIES = {"p7_found": p7_found, "p7_pairs": p7_pairs, "p7_coverage": p7_coverage}
ORACLES: dict = {}
