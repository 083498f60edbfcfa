"""Queries over the change history of files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import history as H
from lodeworks.tables import load


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.version_changes(load(spark, sf_dir, "versions")).select("id")


def p4_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = H.version_history(load(spark, sf_dir, "versions"))
    return h.select("id", "file", "hash", "op", "period", "valid_from", "valid_to")


def p4_open_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = H.version_history(load(spark, sf_dir, "versions"))
    return h.groupBy("file").agg(F.count(F.lit(1)).alias("periods"), F.sum(F.col("valid_to").isNull().cast("long")).alias("open"))


_STATES = r"""
WITH once AS (SELECT id, min(seq) AS seq, any_value(timestamp) AS timestamp,
    any_value(regexp_replace(regexp_replace(replace(file_path, '\', '/'), '/+', '/', 'g'), '^\.(/|$)', '\1')) AS file,
    any_value(lower(CASE WHEN coalesce(trim(hash), '') <> '' THEN trim(hash) ELSE sha256(content) END)) AS hash
  FROM versions WHERE id IS NOT NULL GROUP BY id),
stand AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY file, timestamp ORDER BY seq DESC, id DESC) = 1),
lagged AS (SELECT *, row_number() OVER w AS n, lag(hash) OVER w AS was FROM stand WINDOW w AS (PARTITION BY file ORDER BY timestamp)),
opened AS (SELECT *, CASE WHEN n = 1 THEN 'insert' ELSE 'update' END AS op FROM lagged WHERE n = 1 OR hash IS DISTINCT FROM was),
periods AS (SELECT id, file, hash, op, row_number() OVER w AS period, timestamp AS valid_from, lead(timestamp) OVER w AS valid_to
  FROM opened WINDOW w AS (PARTITION BY file ORDER BY timestamp))
"""

QUERIES = {"p4_found": p4_found, "p4_history": p4_history, "p4_open_per_file": p4_open_per_file}
ORACLES = {
    "p4_found": _STATES + "SELECT id FROM opened",
    "p4_history": _STATES + "SELECT * FROM periods",
    "p4_open_per_file": _STATES + "SELECT file, count(*) AS periods, CAST(sum(CASE WHEN valid_to IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS open FROM periods GROUP BY file",
}
