"""A store of JSON documents: validation, search, paging, batches of operations, rule joins and ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def missing_fields(docs: DataFrame, doc: str, kind: str, required: dict[str, list[str]]) -> DataFrame:
    """``docs`` with ``missing``, the required keys of its kind that a document lacks, sorted.

    A key that is there with a null value is not missing; an unknown kind requires nothing; an unreadable document
    lacks every key of its kind.
    """
    keys = F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>"))
    need = F.lit(None).cast("array<string>")
    for k, fields in required.items():
        need = F.when(F.col(kind) == k, F.array(*[F.lit(f) for f in fields])).otherwise(need)
    return docs.withColumn("missing", F.array_sort(F.array_except(F.coalesce(need, F.array().cast("array<string>")), keys)))


def as_text(value: Column, kind: Column) -> Column:
    """A JSON value as text: arrays as their elements joined by commas, objects as ``[object Object]``, scalars as they are.

    ``kind`` is the value's variant type; a null element of an array is empty.
    """
    element = lambda e: F.when(e.startswith("{"), "[object Object]").otherwise(F.coalesce(e, F.lit("")))
    joined = F.array_join(F.transform(F.from_json(value, "array<string>"), element), ",")
    return F.when(kind.startswith("ARRAY"), joined).when(kind.startswith("OBJECT"), "[object Object]").otherwise(value)


def search(docs: DataFrame, doc: str, params: dict[str, str]) -> DataFrame:
    """Documents in which every parameter's text occurs, in its case, in the value of its key or, where that is null, of its key after an underscore."""
    if not params:
        return docs
    v = docs.withColumn("_v", F.try_parse_json(doc))

    def value(k: str) -> Column:
        kinds = [F.schema_of_variant(F.try_variant_get("_v", f"$.{n}", "variant")) for n in (k, f"_{k}")]
        texts = [F.get_json_object(doc, f"$.{n}") for n in (k, f"_{k}")]
        return F.coalesce(*[as_text(t, c) for t, c in zip(texts, kinds)])

    return v.filter(reduce(Column.__and__, [F.contains(value(k), F.lit(x)) for k, x in params.items()])).drop("_v")


def apply_operations(docs: DataFrame, operations: DataFrame, key: str, order: str) -> DataFrame:
    """The store after a batch: per key the last create, update or delete in ``order`` stands."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = operations.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(F.col(key).alias("_k"), F.col("op").alias("_op"), F.col("doc").alias("_doc"))
    both = docs.join(last, F.col(key) == F.col("_k"), "full_outer").filter(F.coalesce("_op", F.lit("keep")) != "delete")
    return both.select(F.coalesce(key, "_k").alias(key), F.coalesce("_doc", "doc").alias("doc"))


def lacking(have: DataFrame, rules: DataFrame, others: DataFrame, subject: str, condition: str, needed: str, other: str) -> DataFrame:
    """(subject, condition, needed): rules whose condition a subject meets while it lacks the companion they need.

    ``rules`` is a small stated table (condition, needed) and is broadcast; what is there is an anti-join.
    """
    due = have.select(subject, condition).distinct().join(F.broadcast(rules), condition).select(subject, condition, needed)
    there = others.select(F.col(subject).alias("_s"), F.col(other).alias("_o")).distinct()
    return due.join(there, (F.col(subject) == F.col("_s")) & (F.col(needed) == F.col("_o")), "left_anti")


def together(items: DataFrame, pairs: list[tuple[str, str]], subject: str, item: str) -> DataFrame:
    """(subject, pair): stated pairs whose two parts both occur, as a part of some item's name, with a subject.

    One pass: per subject the parts seen are aggregated, and each pair is a condition on them.
    """
    parts = sorted({p for pair in pairs for p in pair})
    name = F.lower(item)
    seen = items.groupBy(subject).agg(*[F.bool_or(F.contains(name, F.lit(p.lower()))).alias(f"_{i}") for i, p in enumerate(parts)])
    at = {p: F.col(f"_{i}") for i, p in enumerate(parts)}
    found = F.array_compact(F.array(*[F.when(at[a] & at[b], F.lit(f"{a} + {b}")) for a, b in pairs]))
    return seen.select(subject, F.explode(found).alias("pair"))


def in_range(value: Column, low: Column, high: Column) -> Column:
    """LOW, HIGH or NORMAL against a range, UNKNOWN without one."""
    return F.when(low.isNull() | high.isNull(), "UNKNOWN").when(value < low, "LOW").when(value > high, "HIGH").otherwise("NORMAL")


def routed(messages: DataFrame, endpoints: list[tuple[str, str]], to: str) -> DataFrame:
    """``messages`` with ``route``: the first endpoint whose id equals, or whose address holds, the addressee."""
    route = F.lit(None).cast("string")
    for name, address in reversed(endpoints):
        route = F.when((F.col(to) == name) | F.contains(F.lit(address), F.col(to)), F.lit(name)).otherwise(route)
    return messages.withColumn("route", route)


def with_default(keys: DataFrame, table: DataFrame, key: str, value: str, default: list[str]) -> DataFrame:
    """``keys`` with the array ``value`` of ``table``, or ``default`` where the key is unknown."""
    t = table.select(F.col(key).alias("_k"), F.col(value))
    return keys.join(t, F.col(key) == F.col("_k"), "left").select(*keys.columns, F.coalesce(value, F.array(*[F.lit(x) for x in default])).alias(value))
