"""Generated rows and embedded texts: sources that make their rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def patients(spark: SparkSession, count: int, seed: int, ages: tuple[int, int] = (18, 90), today: str = "2024-01-31", gender: str | None = None) -> DataFrame:
    """(id, name, gender, age, birth_date, phone) of ``count`` invented patients, the same for the same seed."""
    low, high = ages
    age = (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("int")
    sex = F.lit(gender) if gender else F.when(F.rand(seed + 1) < 0.5, "female").otherwise("male")
    phone = F.format_string("555-%03d-%04d", F.floor(F.rand(seed + 2) * 1000).cast("int"), F.floor(F.rand(seed + 3) * 10000).cast("int"))
    rows = spark.range(count).select(F.concat(F.lit("patient-"), (F.col("id") + 1).cast("string")).alias("id"), F.concat(F.lit("Patient "), (F.col("id") + 1).cast("string")).alias("name"), sex.alias("gender"), age.alias("age"), phone.alias("phone"))
    return rows.withColumn("birth_date", F.date_sub(F.lit(today).cast("date"), F.col("age") * 365))


def embedded(table: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]] | None], length: int, batch: int = 25) -> DataFrame:
    """(key, vector) for each text, embedded in batches on the executors.

    A failing batch and vectors of another length give null, so that a later run takes them up again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k in range(0, len(b), batch):
                part = list(b["text"][k : k + batch])
                try:
                    got = embed(part)
                except Exception:
                    got = None
                out += [v if v is not None and len(v) == length else None for v in (got or [None] * len(part))]
            yield pd.DataFrame({"key": b["key"], "vector": out})

    kind = table.schema[key].dataType.simpleString()
    return table.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).mapInPandas(run, f"key {kind}, vector array<float>")
