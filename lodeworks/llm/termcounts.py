"""Occurrence and record counts of every term, kept by signed deltas (problem 5).

State: one row per term with ``occurrences`` and ``records``, and one row for the number of all records under the
null term, in persistent buckets (``Store``). A batch of changed records becomes a small table of signed differences,
which is merged into the buckets it touches; nothing that did not change is counted again. Counting anew takes every
record as added to an empty store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.plans.lineage import cut, scratch


def readable_counts(json: Column) -> Column:
    """The map n-gram -> count of a JSON object, null where the text is no whole readable object of terms."""
    return F.from_json(json, "map<string,string>", {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})


def records(table: DataFrame, key: str, json: str) -> DataFrame:
    """(key, json) of the readable records, each key once.

    Null keys, null or unreadable JSON and repeats of a key are left out; where a key bears several texts the
    least in byte order stands. Readability is tested before the shuffle, the text itself crosses it once.
    """
    rows = table.select(F.col(key).alias("key"), F.col(json).alias("json")).filter(F.col("key").isNotNull() & F.json_object_keys("json").isNotNull())
    return rows.groupBy("key").agg(F.min("json").alias("json"))


def changes(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """(sign, json): records added or changed in ``after`` with +1, records deleted or changed since ``before`` with -1."""
    if before is None:
        return after.select(F.lit(1).alias("sign"), "json")
    b = before.select(F.col("key").alias("_b"), F.col("json").alias("old"))
    pair = b.join(after, F.col("_b") == F.col("key"), "full_outer").filter(~F.col("old").eqNullSafe(F.col("json")))
    signed = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("json")), F.struct(F.lit(1).alias("sign"), F.col("json").alias("json")))
    return pair.select(F.inline(signed)).filter(F.col("json").isNotNull())


def deltas(changed: DataFrame) -> DataFrame:
    """(term, occurrences, records): signed differences per term, and under the null term those of all records.

    Each record gives one row for the null term beside those of its terms, so that one reading serves both; rows are
    summed before they are shuffled.
    """
    entries = F.map_entries(readable_counts(F.col("json")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit("0").alias("value")))
    each = changed.select("sign", F.inline(F.concat(whole, F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")))))
    times = F.greatest(F.coalesce(F.expr("try_cast(value AS BIGINT)"), F.lit(0)), F.lit(0))
    return _summed(each.select(F.col("key").alias("term"), (times * F.col("sign")).alias("occurrences"), F.col("sign").cast("long").alias("records")))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


class Store:
    """Counts that last, below a shared folder: ``version=n/bucket=b``, a term's bucket being a hash of it.

    A merge reads and rewrites the buckets that the delta touches and leaves the others where they are; of each bucket
    its newest complete version holds. A version counts once its write has ended, so a lost job changes nothing.
    Terms whose count fell to zero stay as rows of zero, which keep an emptied bucket from being taken for its past.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _versions(self) -> tuple[dict[int, int], int]:
        """(bucket -> newest complete version, highest version begun); a listing of folders, bounded by buckets times versions."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        newest: dict[int, int] = {}
        highest = 0
        for v in files.listStatus(path) if files.exists(path) else ():
            if not v.getPath().getName().startswith("version="):
                continue
            highest = max(highest, int(v.getPath().getName().split("=")[1]))
            if files.exists(jvm.org.apache.hadoop.fs.Path(v.getPath(), "_SUCCESS")):
                n = int(v.getPath().getName().split("=")[1])
                for b in files.listStatus(v.getPath()):
                    if (name := b.getPath().getName()).startswith("bucket="):
                        newest[int(name.split("=")[1])] = max(n, newest.get(int(name.split("=")[1]), 0))
        return newest, highest

    def _read(self, newest: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.folder}/version={n}/bucket={b}" for b, n in sorted(newest.items())]
        return self.spark.read.schema("term string, occurrences long, records long").parquet(*paths) if paths else None

    def read(self) -> DataFrame:
        """(term, occurrences, records) as they are now; the null term counts all records."""
        found = self._read(self._versions()[0])
        return self.spark.createDataFrame([], "term string, occurrences long, records long") if found is None else found.filter((F.col("records") > 0) | F.col("term").isNull())

    def merge(self, delta: DataFrame) -> None:
        """Adds signed differences to the counts, bucket by bucket."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        newest, highest = self._versions()
        if newest:
            delta = cut(delta)
            touched = [r[0] for r in delta.select(bucket.alias("b")).distinct().collect()]
            old = self._read({b: n for b, n in newest.items() if b in touched})
            delta = _summed(delta if old is None else old.unionByName(delta))
        delta.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/version={highest + 1}")


def marked(state: DataFrame, common_above: float = 0.1) -> DataFrame:
    """The state's terms with ``mark``: ``rare`` (one record), ``common`` (above that share of all records) or null.

    With ten records or fewer a term of one record is not common unless it passes the share, and then both marks
    hold: the term comes twice. The total is a scalar subquery.
    """
    total = state.filter(F.col("term").isNull()).agg(F.max("records").alias("all_records")).scalar()
    named = state.filter(F.col("term").isNotNull()).withColumn("all_records", total)
    marks = F.array_compact(F.array(F.when(F.col("records") == 1, "rare"), F.when(F.col("records") > F.col("all_records") * common_above, "common")))
    return named.select("term", "occurrences", "records", "all_records", F.explode_outer(marks).alias("mark"))


def count_terms(table: DataFrame, key: str = "path", json: str = "ngrams_json") -> DataFrame:
    """Counted anew: every record of ``table`` taken as added to an empty store. An empty table gives an empty result."""
    store = Store(table.sparkSession, scratch(table.sparkSession, "terms"))
    store.merge(deltas(changes(None, records(table, key, json))))
    return store.read()
