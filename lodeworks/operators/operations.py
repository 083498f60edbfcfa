"""Operational analytics: token buckets, sessions of attempts, rates, health and trends."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.operators.history import CHUNK, numbered


def sessions(events: DataFrame, keys: list[str], at: str, tie: str, gap_minutes: int) -> DataFrame:
    """``events`` with ``session`` (from 1 per key, a new one after a pause) and ``attempt`` (its number in the session)."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    pause = (F.col(at).cast("timestamp").cast("double") - F.lag(at).over(w).cast("timestamp").cast("double")) > gap_minutes * 60
    marked = events.withColumn("_new", F.coalesce(pause, F.lit(True)).cast("long"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("session", F.sum("_new").over(run)).drop("_new")
    return numbered.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys, "session").orderBy(at, tie)))


BUCKET = "key string, allowed long, blocked long"


def token_bucket(events: DataFrame, key: str, at: str, capacity: float, per_second: float) -> DataFrame:
    """(key, allowed, blocked): a bucket of ``capacity`` tokens per key, filled at ``per_second``, one token an event.

    The bucket is sequential in time, so events are first counted per key and second; what one task walks is as
    long as the seconds in which a key was active, whatever the number of events.
    """
    counted = events.groupBy(F.col(key).cast("string").alias("key"), F.floor(F.col(at).cast("timestamp").cast("double")).alias("second")).agg(F.count(F.lit(1)).alias("n"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        tokens, last, allowed, blocked = capacity, None, 0, 0
        for second, n in rows.sort_values("second")[["second", "n"]].itertuples(index=False):
            if last is not None:
                tokens = min(capacity, tokens + (second - last) * per_second)
            last = second
            take = min(int(n), int(tokens))
            tokens -= take
            allowed += take
            blocked += int(n) - take
        return pd.DataFrame({"key": [rows["key"].iat[0]], "allowed": [allowed], "blocked": [blocked]})

    return counted.groupBy("key").applyInPandas(walk, BUCKET)


LIMITS = "tool string, allowed long, blocked long, refunded long"


def two_level_bucket(events: DataFrame, limiter: str, tool: str, at: str, whole: tuple[float, float], each: tuple[float, float], costs: dict[str, int]) -> DataFrame:
    """(tool, allowed, blocked, refunded) of calls that take from a bucket of all tools, then from one of their own.

    ``whole`` and ``each`` are (capacity, tokens a second); a call costs what ``costs`` says, else one. Where the
    tool's own bucket cannot pay, what the common one paid is given back. A limiter is sequential in time: calls are
    counted per second and tool first, so that a task walks seconds, not calls; tools of one second go by name.
    """
    counted = events.groupBy(F.col(limiter).cast("string").alias("limiter"), F.floor(F.col(at).cast("timestamp").cast("double")).alias("second"), F.col(tool).cast("string").alias("tool")).agg(F.count(F.lit(1)).alias("n"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        common, last, own, seen = whole[0], None, {}, {}
        allowed: Counter = Counter()
        blocked: Counter = Counter()
        refunded: Counter = Counter()
        for second, name, n in rows.sort_values(["second", "tool"])[["second", "tool", "n"]].itertuples(index=False):
            if last is not None:
                common = min(whole[0], common + (second - last) * whole[1])
            last = second
            mine = min(each[0], own.get(name, each[0]) + (second - seen.get(name, second)) * each[1])
            seen[name] = second
            cost = costs.get(name, 1)
            payable = min(int(n), int(common // cost))
            take = min(payable, int(mine // cost))
            common -= take * cost
            own[name] = mine - take * cost
            allowed[name] += take
            blocked[name] += int(n) - take
            refunded[name] += payable - take
        names = sorted(own)
        return pd.DataFrame({"tool": names, "allowed": [allowed[x] for x in names], "blocked": [blocked[x] for x in names], "refunded": [refunded[x] for x in names]})

    return counted.groupBy("limiter").applyInPandas(walk, LIMITS)


def health(stats: DataFrame) -> DataFrame:
    """One row with ``healthy`` and ``warnings`` from success_rate, block_rate and hit_rate."""
    w = F.array_compact(F.array(F.when(F.col("success_rate") <= 0.5, "failures"), F.when(F.col("block_rate") >= 0.1, "blocked"), F.when(F.col("hit_rate") < 0.1, "cold cache")))
    return stats.withColumn("warnings", F.array_join(w, ",")).withColumn("healthy", (F.col("success_rate") > 0.5) & (F.col("block_rate") < 0.1))


def rolling(events: DataFrame, key: str, value: str, at: str, tie: str, samples: int, chunk: int = CHUNK) -> DataFrame:
    """``events`` with the mean and count of the last ``samples`` values of its key, itself included.

    Where a key has more than ``chunk`` rows, rows are numbered without bringing a key together and cut into blocks of
    ``chunk``; the last rows of each block go along with the next one too, so that its first rows see all their samples.
    """
    chunk = max(chunk, samples)
    if events.groupBy(key).count().filter(F.col("count") > chunk).isEmpty():
        w = Window.partitionBy(key).orderBy(at, tie).rowsBetween(-(samples - 1), 0)
        return events.withColumn("rolling_mean", F.avg(value).over(w)).withColumn("rolling_n", F.count(value).over(w))
    n = numbered(events, [key], at, [tie], "_n", chunk)
    own = F.floor((F.col("_n") - 1) / chunk)
    blocks = F.when(F.pmod(F.col("_n") - 1, F.lit(chunk)) >= chunk - samples + 1, F.array(own, own + 1)).otherwise(F.array(own))
    each = n.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy(key, "_block").orderBy("_n").rowsBetween(-(samples - 1), 0)
    out = each.withColumn("rolling_mean", F.avg(value).over(w)).withColumn("rolling_n", F.count(value).over(w))
    return out.filter("_own = _block").drop("_n", "_own", "_block")


def call_snapshot(calls: DataFrame, key: str, value: str, result: str, failed: str, at: str, tie: str, samples: int = 1000) -> DataFrame:
    """(key, calls, errors, mean) per key, with the mean of its newest ``samples`` values, and a row ``<all>`` weighted by samples.

    Means are rounded half up to hundredths. The newest values are found by a rank bound, which is met before the shuffle.
    """
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    recent = calls.select(key, value, at, tie).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= samples)
    sums = recent.groupBy(F.col(key).alias("_k")).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    per = calls.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col(result) == failed).alias("errors")).join(sums, F.col(key).eqNullSafe(F.col("_k")))
    mean = lambda t, n: F.floor(F.coalesce(F.try_divide(t, n), F.lit(0.0)) * 100 + 0.5) / 100
    each = per.select(F.col(key).cast("string").alias(key), "calls", "errors", mean(F.col("total"), F.col("n")).alias("mean"))
    whole = per.agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), mean(F.sum("total"), F.sum("n")).alias("mean"))
    return each.unionByName(whole.select(F.lit("<all>").alias(key), "calls", "errors", "mean"))


REPLAY = "cache string, hits long, misses long, expired long, evicted long"


def cache_replay(accesses: DataFrame, cache: str, key: str, at: str, tie: str, ttl: float, capacity: int) -> DataFrame:
    """(cache, hits, misses, expired, evicted): accesses in order against a cache that forgets.

    A value lives ``ttl`` seconds from when it was set; a hit makes it the most recently used and does not prolong it;
    a miss sets it, and beyond ``capacity`` the least recently used goes. Sequential per cache by nature.
    """
    rows = accesses.select(F.col(cache).cast("string").alias("cache"), F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").cast("double").alias("at"), F.col(tie).alias("tie"))

    def walk(t: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, float] = {}  # in order of use
        hits = misses = expired = evicted = 0
        for k, now in t.sort_values(["at", "tie"])[["key", "at"]].itertuples(index=False):
            since = held.pop(k, None)
            if since is not None and now - since <= ttl:
                hits += 1
                held[k] = since
                continue
            misses += 1
            expired += since is not None
            held[k] = now
            if len(held) > capacity:
                held.pop(next(iter(held)))
                evicted += 1
        return pd.DataFrame({"cache": [t["cache"].iat[0]], "hits": [hits], "misses": [misses], "expired": [expired], "evicted": [evicted]})

    return rows.groupBy("cache").applyInPandas(walk, REPLAY)
