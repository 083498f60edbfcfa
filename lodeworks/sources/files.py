"""File sources: listings, whole texts, JSON folders and idempotent imports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.functions.text import language_of

#: Folders that hold no source. Fixed values.
SKIPPED = ("node_modules", ".git", "dist", "coverage", "__pycache__", ".next", "build", "target", "vendor", ".cache")


def kept(path: Column, skipped: tuple[str, ...] = SKIPPED) -> Column:
    """Whether a path is a source: in no skipped folder, neither minified nor a map."""
    inside = "/(" + "|".join(s.replace(".", r"\.") for s in skipped) + ")/"
    return ~path.rlike(inside) & ~path.rlike(r"\.min\.[a-z]+$|\.map$")


def children(files: DataFrame, folder: str, hidden: bool = False) -> DataFrame:
    """(name, kind, size, modified, language, place) of what lies right in ``folder``: directories first, then by name.

    ``files`` is (path, size, modified). A directory has the size and time of all that is below it, no language.
    """
    root = folder.rstrip("/") + "/"
    rest = F.substring("path", len(root) + 1, 1 << 20)
    below = files.filter(F.col("path").startswith(root)).select(rest.alias("rest"), "size", "modified")
    name = F.substring_index("rest", "/", 1)
    each = below.select(name.alias("name"), F.when(F.contains("rest", F.lit("/")), "directory").otherwise("file").alias("kind"), "size", "modified")
    out = each.groupBy("name", "kind").agg(F.sum("size").alias("size"), F.max("modified").alias("modified"))
    out = out if hidden else out.filter(~F.col("name").startswith("."))
    w = Window.orderBy("kind", "name")  # over the children of one folder
    return out.withColumn("language", F.when(F.col("kind") == "file", language_of(F.col("name")))).withColumn("place", F.row_number().over(w).cast("long"))


def listing(spark: SparkSession, folder: str, pattern: str = "*", hidden: bool = False) -> DataFrame:
    """(path, name, size, modified) of the files below a folder; contents are not read."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    out = t.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out if hidden else out.filter(~F.col("name").startswith("."))


def corpus(spark: SparkSession, folder: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, content) of the text files below a folder, without build output, minified files and maps."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(folder).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return rows.filter(kept(F.col("path"), skipped))


def json_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, doc) of every JSON file of a folder, as text; a folder that is not there gives no rows."""
    try:
        rows = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, doc string")
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("doc"))


def import_once(spark: SparkSession, rows: DataFrame, target: str) -> bool:
    """Writes ``rows`` to ``target`` unless it already holds rows; says whether it wrote."""
    try:
        if not spark.read.parquet(target).isEmpty():
            return False
    except AnalysisException:
        pass
    rows.write.mode("overwrite").parquet(target)
    return True
