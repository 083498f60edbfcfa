"""Queries over file sources and streams, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeworks.sources import files
from lodeworks.streaming import audit_stream


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Parquet files of the data folder."""
    return files.listing(spark, sf_dir, "*.parquet").select("name", "size")


def stream_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with more than three accesses to protected records on a day, from the event table read as a stream."""
    return audit_stream.run_once(spark, sf_dir).selectExpr("CAST(day AS STRING) AS day", "user_id", "accesses")


QUERIES = {"file_listing": file_listing, "stream_accesses": stream_accesses}
ORACLES = {
    "stream_accesses": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, user_id, count(*) AS accesses FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2 HAVING count(*) > 3",
}
