"""Validity history of changing attributes (problem 4).

The unit of work is a *state*: the value an entity had from some moment on. States of one entity are numbered
consecutively without ever bringing a whole entity into one task, and neighbouring states meet in a null-safe
full outer join on (entity, number), whose keys spread evenly however hot one entity is. The end of a period is the
lead of the next event.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodeworks.plans.lineage import cut

#: Rows of one key that a single task orders; a key with more is cut into ranges of its leading order column, so many at most.
CHUNK, MOST_PIECES = 200_000, 1_024


def _same(names: list[str]) -> Column:
    """Null-safe equality of each column with its namesake prefixed ``_r_``."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in names])


def _prefixed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_r_{k}" for k in names})


def _at(df: DataFrame, by: str) -> Column:
    """The order column as a number; null comes first."""
    timed = isinstance(df.schema[by].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return F.coalesce(F.col(by).cast("timestamp").cast("double") if timed else F.col(by).cast("double"), F.lit(float("-1e300")))


def pieces(df: DataFrame, keys: list[str], by: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame | None]:
    """(``df`` with ``_piece``, sizes): keys with more than ``chunk`` rows cut into ranges of ``by`` that hold about as many rows each.

    The cuts are quantiles of the key's own values, so that a burst is cut as finely as it is dense; rows of a key that
    agree in ``by`` stay together. ``sizes`` has the hot keys' pieces with their rows, the rows before them and the
    ``by`` that the next piece begins with; None where no key is hot. ``df`` should be stored, as it is read again.
    """
    count = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > chunk)
    hot = cut(count.select(*keys, F.least(F.ceil(F.col("_rows") / F.lit(chunk)), F.lit(MOST_PIECES)).cast("int").alias("_pieces")))
    if hot.isEmpty():
        return df.withColumn("_piece", F.lit(0)), None
    spot = df.withColumn("_at", _at(df, by))
    mine = _prefixed(hot, keys)
    marks = spot.join(mine, _same(keys)).groupBy(*keys).agg(F.percentile_approx("_at", [i / MOST_PIECES for i in range(1, MOST_PIECES)], 100 * MOST_PIECES).alias("_marks"), F.max("_pieces").alias("_pieces"))
    # of the marks at all quantiles every one at a multiple of 1 / _pieces is a cut
    cuts = cut(marks.select(*keys, F.expr(f"transform(sequence(1, _pieces - 1), i -> _marks[cast(floor(i * {MOST_PIECES} / _pieces) as int) - 1])").alias("_cuts")))
    cut_up = spot.join(_prefixed(cuts, keys), _same(keys), "left").withColumn("_piece", F.coalesce(F.expr("size(filter(_cuts, c -> c < _at))"), F.lit(0)))
    sized = cut_up.filter(F.col("_cuts").isNotNull()).groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_size"), F.min(by).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_piece")
    sizes = sized.select(*keys, "_piece", (F.sum("_size").over(w) - F.col("_size")).alias("_shift"), F.lead("_first").over(w).alias("_next"))
    return cut_up.select(*df.columns, "_piece"), sizes


def numbered(df: DataFrame, keys: list[str], by: str, then: list[str], name: str = "n", chunk: int = CHUNK, follow: str | None = None) -> DataFrame:
    """``df`` with consecutive numbers (from 1) per ``keys`` in the order of ``by`` (a timestamp or number) and ``then``.

    With ``follow`` also the ``by`` of the row that comes next, null for the last of a key. Keys with more than
    ``chunk`` rows are ordered in ``pieces``, apart; numbers are shifted by the pieces before, and the last row of a
    piece is followed by the first of the next. Null keys form one group; null ``by`` sorts first. Expects the
    columns ``keys + [by] + then`` to identify a row, else equal rows are numbered in any order.
    """
    held, sizes = pieces(cut(df), keys, by, chunk)
    w = Window.partitionBy(*keys, "_piece").orderBy(*[F.asc_nulls_first(c) for c in [by, *then]])
    local = held.withColumn("_n", F.row_number().over(w))
    if follow:
        local = local.withColumn(follow, F.lead(by).over(w)).withColumn("_last", F.lead(F.lit(False), 1, True).over(w))
    if sizes is None:
        return local.select(*df.columns, F.col("_n").cast("long").alias(name), *([follow] if follow else []))
    out = local.join(_prefixed(sizes, [*keys, "_piece"]), _same([*keys, "_piece"]), "left")
    after = [F.when(F.col("_last"), F.col("_next")).otherwise(F.col(follow)).alias(follow)] if follow else []
    return out.select(*df.columns, (F.col("_n") + F.coalesce("_shift", F.lit(0))).cast("long").alias(name), *after)


def diff_snapshots(old: DataFrame, new: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """Change events between two snapshots: keys, ``op`` (insert, update, delete), old_* and new_* attributes.

    Null keys and null attributes compare as equal to each other. A key repeated in a snapshot should be
    reduced by the caller first. Unchanged keys give no row; empty snapshots give only inserts or deletes.
    """
    o = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys], *[F.col(a).alias(f"old_{a}") for a in attrs], F.lit(1).alias("_o"))
    n = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys], *[F.col(a).alias(f"new_{a}") for a in attrs], F.lit(1).alias("_n"))
    on = reduce(lambda a, b: a & b, [F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(f"old_{a}").eqNullSafe(F.col(f"new_{a}")) for a in attrs])
    op = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(~same, "update")
    joined = o.join(n, on, "full_outer").withColumn("op", op).filter(F.col("op").isNotNull())
    return joined.select(*[F.when(F.col("_n").isNull(), F.col(f"_o_{k}")).otherwise(F.col(f"_n_{k}")).alias(k) for k in keys], "op", *[f"old_{a}" for a in attrs], *[f"new_{a}" for a in attrs])


def change_events(states: DataFrame, keys: list[str], at: str, attrs: list[str], then: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """The states that differ from the one before them, with ``op`` insert or update.

    ``states`` holds one row per key and moment. State n of a key is the snapshot it was in; it is compared with
    state n-1 by the same null-safe full outer join as whole snapshots are.
    """
    n = numbered(states, keys, at, then or [], "_state", chunk)
    was = n.select(*[F.col(k).alias(f"_p_{k}") for k in keys], (F.col("_state") + 1).alias("_p_state"), *[F.col(a).alias(f"_p_{a}") for a in attrs])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in keys]) & (F.col("_state") == F.col("_p_state"))
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(f"_p_{a}")) for a in attrs])
    op = F.when(F.col("_state").isNull(), "past").when(F.col("_p_state").isNull(), "insert").when(~same, "update").otherwise("same")
    return n.join(was, on, "full_outer").withColumn("op", op).filter(F.col("op").isin("insert", "update")).select(*states.columns, "op")


def validity(events: DataFrame, keys: list[str], at: str, then: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Change events with ``valid_from``, ``valid_to`` (the next event of the key, null while current) and ``period``."""
    n = numbered(events, keys, at, then or [], "period", chunk, "valid_to")
    return n.select(*events.columns, "period", F.col(at).alias("valid_from"), "valid_to")


def history_from_snapshots(snapshots: DataFrame, keys: list[str], at: str, attrs: list[str], dates: list, chunk: int = CHUNK) -> DataFrame:
    """Full history from periodic snapshots: ``dates`` lists the snapshot moments in order, as metadata of the load.

    Consecutive snapshots are differenced pairwise, the change events united, and validity derived with the next
    event; a delete closes the period of its key and gives no row of its own. A key that comes back opens a new one.
    """
    parts, old = [], snapshots.limit(0)
    for when in dates:
        new = snapshots.filter(F.col(at) == F.lit(when))
        parts.append(diff_snapshots(old, new, keys, attrs).withColumn(at, F.lit(when)))
        old = new
    events = reduce(DataFrame.unionByName, parts).select(*keys, at, "op", *[F.col(f"new_{a}").alias(a) for a in attrs])
    return validity(events, keys, at, [], chunk).filter(F.col("op") != "delete")


def clean_path(path: Column) -> Column:
    """One spelling of a file path: backslashes and doubled slashes read as ``/``, a leading ``.`` dropped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/{2,}", "/"), r"^\.(?=/|$)", "")


def version_states(versions: DataFrame) -> DataFrame:
    """(file, timestamp, id, seq, hash) of the version rows that stand, the hash packed.

    Every id counts once (of rows that share an id the lowest seq), and of rows of a file with one timestamp the
    highest seq stands. Hashes are lower case; an empty or null one is the SHA-256 of the content; where the
    content is null too the hash stays null. Rows without id are left out. Extra columns are ignored.
    """
    text = F.trim("hash")
    rows = versions.filter(F.col("id").isNotNull()).select(
        "id", "seq", clean_path(F.col("file_path")).alias("file"), "timestamp",
        F.when(F.coalesce(text, F.lit("")) != "", pack_hash(F.lower(text))).otherwise(F.unhex(F.sha2(F.col("content").cast("binary"), 256))).alias("hash"),
    )
    once = rows.groupBy("id").agg(F.min(F.struct("seq", "timestamp", "file", "hash")).alias("r")).select("id", "r.*")
    return once.groupBy("file", "timestamp").agg(F.max(F.struct("seq", "id", "hash")).alias("r")).select("file", "timestamp", "r.*")


def pack_hash(text: Column) -> Column:
    """A 64-digit hex hash as its 32 bytes, half of what a shuffle would carry; other text padded beyond that length."""
    return F.when(text.rlike("^[0-9a-f]{64}$"), F.unhex(text)).otherwise(F.concat(F.unhex(F.lit("00" * 33)), text.cast("binary")))


def hash_text(packed: Column) -> Column:
    """The text that ``pack_hash`` took."""
    return F.when(F.length(packed) == 32, F.lower(F.hex(packed))).otherwise(F.decode(F.substring(packed, 34, 1 << 30), "UTF-8"))


def version_changes(versions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The version rows that open a validity period, with ``op``."""
    return change_events(version_states(versions), ["file"], "timestamp", ["hash"], ["seq"], chunk)


def version_history(versions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per state of a file with valid_from and valid_to."""
    return validity(version_changes(versions, chunk), ["file"], "timestamp", ["seq"], chunk).drop("timestamp").withColumn("hash", hash_text(F.col("hash")))
