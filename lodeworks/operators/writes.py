"""The write path: files written and appended behind gates, documents created, changed and deleted with an outcome each.

A batch is a table of operations in order. What each operation meets is the state left by those before it on the same
key, taken by a window over the key's operations alone; nothing is looped over on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.functions import text as T

#: Signs that one write may have at most. Fixed value.
MOST_SIGNS = 10_000_000


def holds_secret(text: Column, patterns: tuple = T.SECRETS) -> Column:
    """Whether a text holds any of the secrets' shapes."""
    return reduce(Column.__or__, [F.regexp_count(text, F.lit(T.ascii_bounds(p))) > 0 for _, p, _ in patterns])


def written(current: DataFrame, writes: DataFrame, most_bytes: int) -> DataFrame:
    """(path, outcome, content, old_hash, hash, versioned): what a batch of whole-file writes, one a path, does.

    ``current`` and ``writes`` are (path, content). Outcome is ``too long``, ``secret``, ``too large``, ``created``,
    ``unchanged`` or ``changed``; the first three leave the file as it is. ``versioned`` marks writes that keep the old
    content as a version, because its hash differs. A null content is an empty file.
    """
    new = writes.select("path", F.coalesce("content", F.lit("")).alias("new"))
    old = current.select(F.col("path").alias("_p"), F.coalesce("content", F.lit("")).alias("old"))
    both = new.join(old, F.col("path") == F.col("_p"), "left")
    digest = lambda c: F.when(F.col(c).isNotNull(), F.sha2(F.col(c).cast("binary"), 256))
    outcome = T.first_label(
        [
            (F.length("new") > MOST_SIGNS, "too long"),
            (holds_secret(F.col("new")), "secret"),
            (F.octet_length("new") > most_bytes, "too large"),
            (F.col("_p").isNull(), "created"),
            (F.col("old") == F.col("new"), "unchanged"),
        ],
        "changed",
    )
    out = both.withColumn("outcome", outcome)
    stands = F.col("outcome").isin("created", "unchanged", "changed")
    return out.select("path", "outcome", F.when(stands, F.col("new")).otherwise(F.col("old")).alias("content"), digest("old").alias("old_hash"), digest("new").alias("hash"), (F.col("outcome") == "changed").alias("versioned"))


def appended(current: DataFrame, additions: DataFrame, create: bool) -> DataFrame:
    """(path, outcome, content): text put behind what a file holds, one addition a path.

    Only additions to a file that exists are searched for secrets. A file that is missing is created if ``create``.
    """
    new = additions.select("path", F.coalesce("content", F.lit("")).alias("new"))
    old = current.select(F.col("path").alias("_p"), F.coalesce("content", F.lit("")).alias("old"))
    both = new.join(old, F.col("path") == F.col("_p"), "left")
    there = F.col("_p").isNotNull()
    outcome = T.first_label([(there & holds_secret(F.col("new")), "secret"), (there, "appended"), (F.lit(create), "created")], "not found")
    out = both.withColumn("outcome", outcome)
    content = F.when(F.col("outcome") == "appended", F.concat("old", "new")).when(F.col("outcome") == "created", F.col("new")).otherwise(F.col("old"))
    return out.select("path", "outcome", content.alias("content"))


def document_outcomes(docs: DataFrame, operations: DataFrame) -> DataFrame:
    """``operations`` (seq, key, op, doc) with ``before`` (the document met), ``success`` and ``error``.

    In order of ``seq``: create needs a string id in the document, update writes whatever was there, delete succeeds
    also where nothing is, read fails where nothing is. Any other op is unknown. A failed operation changes nothing and
    never ends the batch. The operations of one key are ordered in one task.
    """
    has_id = F.coalesce(F.get_json_object("doc", "$.id"), F.lit("")) != ""
    known = F.col("op").isin("create", "read", "update", "delete")
    fails = T.first_label([(~known, "unknown op"), ((F.col("op") == "create") & ~has_id, "no id")], "")
    o = operations.withColumn("_fails", fails)
    # what an operation leaves: a document, nothing (the empty text), or null where it changes nothing
    leaves = F.when((F.col("_fails") == "") & F.col("op").isin("create", "update"), F.coalesce("doc", F.lit("null"))).when((F.col("_fails") == "") & (F.col("op") == "delete"), F.lit(""))
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    o = o.withColumn("_met", F.last(leaves, ignorenulls=True).over(w))
    first = docs.select(F.col("key").alias("_k"), F.col("doc").alias("_first"))
    o = o.join(first, F.col("key") == F.col("_k"), "left").withColumn("before", F.when(F.col("_met").isNull(), F.col("_first")).when(F.col("_met") != "", F.col("_met")))
    error = F.when(F.col("_fails") != "", F.col("_fails")).when((F.col("op") == "read") & F.col("before").isNull(), "not found")
    return o.withColumn("error", error).withColumn("success", F.col("error").isNull()).drop("_fails", "_met", "_k", "_first")


def document_versions(outcomes: DataFrame) -> DataFrame:
    """(key, seq, hash, size, message) of the version rows that document operations write: one a create or update, a tombstone a delete that met something."""
    text = F.when(F.col("op") == "delete", F.col("before")).otherwise(F.col("doc"))
    message = F.when(F.col("op") == "create", "create").when(F.col("op") == "update", "update").otherwise("File deleted")
    rows = outcomes.filter(F.col("success") & F.col("op").isin("create", "update", "delete")).withColumn("_t", text).filter("_t IS NOT NULL")
    return rows.select("key", "seq", F.sha2(F.col("_t").cast("binary"), 256).alias("hash"), F.octet_length("_t").cast("long").alias("size"), message.alias("message"))


def store_after(docs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(key, doc): the store after a batch; the last operation of a key that changed it stands."""
    changed = outcomes.filter(F.col("success") & F.col("op").isin("create", "update", "delete"))
    last = changed.groupBy(F.col("key").alias("_k")).agg(F.max_by(F.struct("op", "doc"), "seq").alias("l"))
    both = docs.join(last, F.col("key") == F.col("_k"), "full_outer").filter(F.col("l").isNull() | (F.col("l.op") != "delete"))
    return both.select(F.coalesce("key", "_k").alias("key"), F.when(F.col("l").isNull(), F.col("doc")).otherwise(F.col("l.doc")).alias("doc"))
