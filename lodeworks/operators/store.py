"""The relational store: files, versions, audits and vectors as pure functions from old state and batch to new state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def audits(events: DataFrame) -> DataFrame:
    """The audit view of an event table."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"), "ts", "user_id", kind.alias("action"),
        F.when(kind == "error", "failure").otherwise("success").alias("result"),
        F.when(kind.isin("view", "click"), F.concat(F.lit("fhir-store/patient/"), F.col("user_id").cast("string"))).otherwise("system").alias("path"),
        "value",
    )


def matching(table: DataFrame, equal: dict | None = None, at: str | None = None, since=None, until=None) -> DataFrame:
    """Rows for which every given equality holds and ``at`` lies in the closed range; None, '' and 0 mean not given."""
    terms = [F.col(c) == F.lit(v) for c, v in (equal or {}).items() if v]
    if at and since:
        terms.append(F.col(at) >= F.lit(since).cast("timestamp_ntz"))
    if at and until:
        terms.append(F.col(at) <= F.lit(until).cast("timestamp_ntz"))
    return table.filter(reduce(Column.__and__, terms)) if terms else table


def page(table: DataFrame, order: list[Column], limit: int = 1000, offset: int = 0) -> DataFrame:
    """A page of rows: ``order`` must name every row apart, so that pages do not overlap."""
    ordered = table.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def newest(table: DataFrame, at: str, key: str) -> list[Column]:
    return [F.desc(at), F.desc(key)]


def access_log(log: DataFrame, path_part: str, limit: int = 100, action: str | None = None) -> DataFrame:
    """The newest ``5 * limit`` rows are taken before they are filtered, then ``limit`` of what is left."""
    recent = page(log, newest(log, "ts", "id"), limit * 5)
    kept = matching(recent.filter(F.contains(F.col("path"), F.lit(path_part))), {"action": action})
    return page(kept, newest(kept, "ts", "id"), limit)


def latest_per_key(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return table.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def latest_scan(files: DataFrame) -> DataFrame:
    """One row per path: that of its latest scan. Aggregated before the shuffle, so hot paths and repeats cost nothing."""
    whole = F.struct("modified", "size", "created", "mode", "language", "imports", "exports", "complexity")
    return files.filter(F.col("path").isNotNull()).groupBy("path").agg(F.max(whole).alias("f")).select("path", "f.*")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str] = (), coalesced: list[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key.

    Columns in ``keep`` stay as they were on conflict; columns in ``coalesced`` stay where the new value is null.
    """
    o = old.select(*[F.col(c).alias(f"_o_{c}") for c in old.columns])
    both = o.join(new, F.col(f"_o_{key}") == F.col(key), "full_outer")
    fresh = F.col(key).isNotNull()

    def pick(c: str) -> Column:
        was = F.col(f"_o_{c}")
        if c == key:
            return F.coalesce(F.col(key), was).alias(c)
        if c in keep:
            return F.when(F.col(f"_o_{key}").isNotNull(), was).otherwise(F.col(c)).alias(c)
        if c in coalesced:
            return F.when(fresh, F.coalesce(F.col(c), was)).otherwise(was).alias(c)
        return F.when(fresh, F.col(c)).otherwise(was).alias(c)

    return both.select(*[pick(c) for c in old.columns])


def without(table: DataFrame, gone: DataFrame, on: str, key: str) -> DataFrame:
    """Rows of ``table`` whose ``on`` is no ``key`` of ``gone``; used for deletes and their cascades."""
    return table.join(gone.select(F.col(key).alias("_gone")), F.col(on) == F.col("_gone"), "left_anti")


def keep_newest(versions: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` versions of each file, content kept on the newest alone, and ``position`` from the newest.

    The bound on the rank lets Spark cut each key to ``n`` rows before the shuffle, so a hot file does not matter.
    """
    w = Window.partitionBy("file_path").orderBy(F.desc("timestamp"), F.desc("seq"), F.desc("id"))
    ranked = versions.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)
    return ranked.withColumn("content", F.when(F.col("position") == 1, F.col("content")))


def retain(log: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows not older than ``days`` before ``now``."""
    return log.filter(F.col(at) >= F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {int(days)} DAYS"))


def half_cut(log: DataFrame, order: list[Column], above: int) -> DataFrame:
    """The whole log while it has at most ``above`` rows, else its newest half of that number."""
    n = log.count()
    return log if n <= above else log.orderBy(*order).limit(above // 2)


def capped(table: DataFrame, size: str, order: list[Column], total: int, each: int, most: int) -> DataFrame:
    """The rows indexed in ``order`` until their sizes pass ``total``: at most ``most`` rows, rows above ``each`` passed over.

    The walk stops at the first row that would pass the total; later smaller rows are not taken.
    """
    first = table.filter(F.col(size) <= each).orderBy(*order).limit(most)
    run = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("_run", run).filter(F.col("_run") <= total).drop("_run")


def percentiles(calls: DataFrame, key: str, value: str, at: str, tie: str, samples: int = 1000) -> DataFrame:
    """Per key: calls, samples, mean and the 50th, 95th and 99th percentile of the newest ``samples`` values.

    A percentile p is the value at index floor(n * p), at most n - 1, of the sorted samples.
    """
    n_all = calls.groupBy(key).agg(F.count(F.lit(1)).alias("calls")).withColumnRenamed(key, "_k")
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    kept = calls.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= samples)
    s = kept.groupBy(key).agg(F.count(value).alias("samples"), F.avg(value).alias("mean"), F.sort_array(F.collect_list(value)).alias("v"))

    def at_share(p: float) -> Column:
        return F.element_at("v", F.least(F.col("samples"), F.floor(F.col("samples") * p) + 1).cast("int"))

    return s.join(n_all, F.col(key) == F.col("_k")).select(key, "calls", "samples", F.round("mean", 6).alias("mean"), *[F.round(at_share(p), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)])


def suspicious(log: DataFrame, above: int = 100, newest_rows: int = 10_000) -> DataFrame:
    """Users with more than ``above`` accesses to protected records among the newest rows."""
    return protected(log, newest_rows).groupBy("user_id").agg(F.count(F.lit(1)).alias("accesses")).filter(F.col("accesses") > above)


def protected(log: DataFrame, newest_rows: int = 10_000) -> DataFrame:
    recent = page(log, newest(log, "ts", "id"), newest_rows)
    return recent.filter(F.col("action").startswith("fhir") | F.contains(F.col("path"), F.lit("patient")))


def read_page(texts: DataFrame, key: str, text: str, offset: int = 1, limit: int = 2000) -> DataFrame:
    """Lines ``offset`` to ``offset + limit - 1`` of each text, with its number of lines and bytes and the next offset."""
    lines = F.split(F.col(text), r"\r?\n")
    rows = texts.filter(F.col(text).isNotNull()).select(key, F.size(lines).cast("long").alias("total_lines"), F.octet_length(text).cast("long").alias("total_bytes"), F.posexplode(lines).alias("i", "line"))
    last = offset + limit - 1
    shown = rows.filter((F.col("i") + 1 >= offset) & (F.col("i") + 1 <= last))
    return shown.select(key, (F.col("i") + 1).cast("long").alias("line_no"), "line", "total_lines", "total_bytes", (F.col("total_lines") > last).alias("truncated"))


def first_policy(paths: DataFrame, policies: list[tuple[str, str]]) -> DataFrame:
    """The first policy, in order, whose glob matches a path: ``**`` crosses directories, ``*`` does not."""
    rule = F.lit(None).cast("string")
    for glob, name in reversed(policies):
        rule = F.when(F.col("path").rlike(path_glob(glob)), F.lit(name)).otherwise(rule)
    return paths.withColumn("policy", rule)


def path_glob(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + ("\\" if glob[i] in ".+?^${}()|[]\\" else "") + glob[i], i + 1
    return f"^(?:[A-Za-z]:)?{out}$"


def name_glob(glob: str) -> str:
    """Regular expression of a file-search glob: any case, ``*`` and ``?`` cross directories; a bare name is sought anywhere."""
    lifted = glob if "/" in glob else f"*/{glob}"
    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else ("\\" + c if c in ".+^${}()|[]\\" else c) for c in lifted) + "$"


def guard(path: Column, allowed: list[str], denied: list[str]) -> Column:
    """Why a path is refused, or ``ok``: NUL, climbing segments, look-alike letters, outside the allowed, inside the denied."""
    norm = F.lower(F.regexp_replace(path, r"\\", "/"))
    inside = reduce(Column.__or__, [(norm == a.lower()) | norm.startswith(a.lower() + "/") for a in allowed], F.lit(False))
    refused = reduce(Column.__or__, [(norm == d.lower()) | norm.startswith(d.lower() + "/") for d in denied], F.lit(False))
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(F.contains(path, F.lit("\x00")), "nul")
        .when(norm.rlike(r"(^|/)\.\.(/|$)"), "climbs")
        .when(path.rlike("[Ѐ-ӿͰ-Ͽ]"), "lookalike")
        .when(refused, "denied")
        .when(~inside, "outside")
        .otherwise("ok")
    )


def token_state(tokens: DataFrame, now: str) -> DataFrame:
    """Whether each token may be used at ``now``: its hash has the right form, and it is neither revoked nor expired."""
    at = F.expr(f"TIMESTAMP_NTZ '{now}'")
    state = F.when(~F.col("hash").rlike("^[0-9a-f]{64}$"), "malformed").when(F.col("revoked_at").isNotNull() & (F.col("revoked_at") <= at), "revoked").when(F.col("expires_at").isNotNull() & (F.col("expires_at") <= at), "expired").otherwise("valid")
    return tokens.withColumn("state", state)


def edges_json(edges: DataFrame) -> DataFrame:
    """An edge table as one row per source with its sorted targets, and back with ``edges_from``."""
    return edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("targets"))


def edges_from(table: DataFrame) -> DataFrame:
    return table.select("src", F.explode(F.split("targets", ",")).alias("dst"))


def issued(rows: DataFrame, key: str, now: Column) -> DataFrame:
    """Tokens for ``rows`` (key, role): the hash of what was handed out is kept, never the token."""
    return rows.select(key, "role", F.sha2(F.col(key).cast("string"), 256).alias("hash"), now.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("revoked_at"))


def revoked(tokens: DataFrame, which: Column, now: Column) -> DataFrame:
    """``tokens`` with those of ``which`` revoked; the first revocation keeps its time."""
    return tokens.withColumn("revoked_at", F.coalesce("revoked_at", F.when(which, now)))


def adjusted(counters: DataFrame, deltas: DataFrame, key: str, count: str) -> DataFrame:
    """(key, count): stored counters after signed ``deltas`` (key, delta); what falls to zero or below leaves."""
    d = deltas.select(F.col(key).alias("_k"), F.col("delta").alias("_d"))
    both = counters.join(d, F.col(key) == F.col("_k"), "full_outer")
    total = (F.coalesce(count, F.lit(0)) + F.coalesce("_d", F.lit(0))).cast("long")
    return both.select(F.coalesce(key, "_k").alias(key), total.alias(count)).filter(F.col(count) > 0)
