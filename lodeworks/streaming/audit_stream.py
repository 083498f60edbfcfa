"""The audit log as a stream: watermarked windows of accesses per user."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import store
from lodeworks.plans.lineage import shared_dir


def accesses(audits: DataFrame, window: str = "1 day", late: str = "1 day", above: int = 3) -> DataFrame:
    """(day, user_id, accesses): users with more than ``above`` accesses to protected records within a window."""
    timed = audits.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    hit = timed.filter(F.contains(F.col("path"), F.lit("patient")))
    return hit.groupBy(F.window("at", window), "user_id").agg(F.count(F.lit(1)).alias("accesses")).filter(F.col("accesses") > above).select(F.col("window.start").alias("day"), "user_id", "accesses")


def run_once(spark: SparkSession, folder: str, name: str = "events.parquet", above: int = 3) -> DataFrame:
    """Reads the files called ``name`` in ``folder`` as a stream to its end; a later batch replaces the counts of its windows."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    out = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{out}/rows")

    q = accesses(store.audits(events), above=above).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy("day", "user_id").agg(F.max_by("accesses", "batch").alias("accesses"))
