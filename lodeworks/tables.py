"""Loading of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeworks.plans.shipping import ship


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` below ``sf_dir``; Parquet carries the schema, so nothing is inferred from rows.

    The first table read in a context also hands the package to the executors.
    """
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that costs far more than moving the rows.

    A table that is read in that many splits or more is left as it is, so only small files are ever moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
