"""An index of files that lasts: rows by file in buckets, replaced file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.plans.lineage import cut


class IndexStore:
    """Rows keyed by ``key`` below a shared folder: ``version=n/bucket=b``, a key's bucket being a hash of it.

    ``replace`` takes the rows of the files it is given out of their buckets and puts the new ones in; other buckets
    stay where they are. Of each bucket the newest complete version holds; a version counts once its write has ended.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 16):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = None

    def _newest(self) -> tuple[dict[int, int], int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        newest: dict[int, int] = {}
        highest = 0
        for v in files.listStatus(path) if files.exists(path) else ():
            name = v.getPath().getName()
            if not name.startswith("version="):
                continue
            n = int(name.split("=")[1])
            highest = max(highest, n)
            if files.exists(jvm.org.apache.hadoop.fs.Path(v.getPath(), "_SUCCESS")):
                for b in files.listStatus(v.getPath()):
                    if b.getPath().getName().startswith("bucket="):
                        k = int(b.getPath().getName().split("=")[1])
                        newest[k] = max(n, newest.get(k, 0))
        return newest, highest

    def _read(self, newest: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.folder}/version={n}/bucket={b}" for b, n in sorted(newest.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The index as it is now; None where nothing was ever written."""
        found = self._read(self._newest()[0])
        return found.filter("NOT _gone").drop("_gone") if found is not None else None

    def replace(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Puts ``rows`` in the place of all rows of their files, and takes out the files of ``gone`` (key).

        A file taken out leaves a mark, which keeps an emptied bucket from being taken for its past.
        """
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = rows.withColumn("_gone", F.lit(False))
        if gone is not None:
            new = new.unionByName(gone.select(self.key).distinct().withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        newest, highest = self._newest()
        if newest:
            new = cut(new)
            touched = {r[0] for r in new.select(bucket.alias("b")).distinct().collect()}  # at most as many as buckets
            old = self._read({b: n for b, n in newest.items() if b in touched})
            if old is not None:
                keys = new.select(F.col(self.key).alias("_k")).distinct()
                new = new.unionByName(old.join(keys, F.col(self.key) == F.col("_k"), "left_anti"))
        new.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/version={highest + 1}")
