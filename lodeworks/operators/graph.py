"""Graphs as edge tables (src, dst): closures, cycles, neighbourhoods, paths, coupling and impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.plans.lineage import cut


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, depth): nodes reached from each start over one edge or more, with the least number of edges.

    A start is in its own closure only if it lies on a cycle. Each round joins the frontier with the edges, drops
    what was seen and is cut to shared storage; it ends when a round finds nothing or after ``most`` rounds. What
    was seen is kept as one table per round, so that no round rewrites it.
    """
    e = cut(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    front = starts.select("start", F.col("start").alias("node"))
    rounds: list[DataFrame] = []
    seen: DataFrame | None = None
    while most is None or len(rounds) < most:
        step = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        if seen is not None:
            s = seen.select(F.col("start").alias("_s"), F.col("node").alias("_n"))
            step = step.join(s, (F.col("start") == F.col("_s")) & (F.col("node") == F.col("_n")), "left_anti")
        front = cut(step)
        if not front.count():  # one job, where isEmpty tries a few partitions at a time
            break
        rounds.append(front.withColumn("depth", F.lit(len(rounds) + 1)))
        seen = front if seen is None else seen.unionByName(front)
    if not rounds:
        return starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).limit(0)
    return reduce(DataFrame.unionByName, rounds)


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both a way in and a way out; what is peeled off lies on no cycle."""
    left, n = edges, -1
    while True:
        srcs = left.select(F.col("src").alias("_k")).distinct()
        dsts = left.select(F.col("dst").alias("_k")).distinct()
        left = cut(left.join(srcs, F.col("dst") == F.col("_k"), "left_semi").join(dsts, F.col("src") == F.col("_k"), "left_semi"))
        had, n = n, left.count()
        if n in (0, had):
            return left


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node): nodes on some cycle, by colouring: no table grows beyond nodes and edges.

    What has no way in or out is peeled off. Each node takes the greatest name that leads to it as its colour; those of
    a colour that lead back to the node of that name are a component, and on cycles if there are several or an edge leads
    from the node to itself. Components are taken out and the rest is coloured again.
    """
    left = _peeled(cut(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()))
    found = [left.filter("src = dst").select(F.col("src").alias("node"))]
    left = _peeled(cut(left.filter("src <> dst")))
    while not left.isEmpty():
        colour = cut(left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            sent = left.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("_n")).agg(F.max("colour").alias("_c"))
            new = cut(colour.join(sent, F.col("node") == F.col("_n"), "left").select("node", F.greatest("colour", "_c").alias("colour"), (F.col("_c") > F.col("colour")).alias("changed")))
            colour = new.select("node", "colour")
            if new.filter("changed").isEmpty():
                break
        of = colour.select(F.col("node").alias("_n"), F.col("colour").alias("_c"))
        within = left.join(of, F.col("src") == F.col("_n")).drop("_n").withColumnRenamed("_c", "_a").join(of, F.col("dst") == F.col("_n")).filter("_a = _c").select("src", "dst")
        within = cut(within)
        front = cut(colour.filter("node = colour").select("node"))
        taken = front
        while True:
            step = within.join(front, F.col("dst") == F.col("node")).select(F.col("src").alias("node")).distinct()
            front = cut(step.join(taken.select(F.col("node").alias("_t")), F.col("node") == F.col("_t"), "left_anti"))
            if front.isEmpty():
                break
            taken = taken.unionByName(front)
        part = cut(taken.select(F.col("node").alias("_n")))
        on = within.join(part, F.col("src") == F.col("_n"), "left_semi").join(part, F.col("dst") == F.col("_n"), "left_semi")
        found.append(on.select(F.col("src").alias("node")).distinct())
        left = _peeled(cut(left.join(part, F.col("src") == F.col("_n"), "left_anti").join(part, F.col("dst") == F.col("_n"), "left_anti")))
    return reduce(DataFrame.unionByName, found).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, outgoing, incoming) of every node of an edge table of distinct edges."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def coupling(edges: DataFrame) -> DataFrame:
    """(node, score): one less the share of other nodes it is linked with, not below 0; N counts nodes with a way out."""
    n = edges.select("src").distinct().count()
    linked = F.col("outgoing") + F.col("incoming")
    score = F.greatest(F.lit(0.0), 1 - linked / F.lit(max(n - 1, 1)))
    return degrees(edges).select("node", F.when(F.lit(n) <= 1, 1.0).otherwise(score).alias("score"))


def change_level(share: Column) -> Column:
    return F.when(share < 0.1, "low").when(share < 0.3, "medium").when(share < 0.6, "high").otherwise("critical")


def change_impact(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, affected, share, level): how many nodes a change could touch, up and down, out of all others.

    Both directions go forward in one frontier, told apart by a mark before the nodes' names.
    """
    n = edges.select(F.count_distinct("src").alias("n")).first()["n"]
    down, up = F.lit("d"), F.lit("u")
    marked = edges.select(F.concat(down, "src").alias("src"), F.concat(down, "dst").alias("dst")).unionByName(edges.select(F.concat(up, "dst").alias("src"), F.concat(up, "src").alias("dst")))
    begun = starts.select(F.concat(down, "start").alias("start")).unionByName(starts.select(F.concat(up, "start").alias("start")))
    name = lambda c: F.substring(c, 2, 1 << 30)
    both = closure(marked, begun).select(name("start").alias("start"), name("node").alias("node")).distinct()
    counted = both.groupBy("start").agg(F.count(F.lit(1)).alias("affected"))
    share = F.col("affected") / F.lit(max(n - 1, 1))
    return counted.select("start", "affected", F.round(share, 6).alias("share"), change_level(share).alias("level"))


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, node, depth): nodes within ``depth`` edges either way, the start itself at 0."""
    either = edges.select("src", "dst").unionByName(reversed_edges(edges)).distinct()
    near = closure(either, starts, depth).filter("start <> node")
    return starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).unionByName(near)


def shortest_paths(edges: DataFrame, starts: DataFrame, goal: str, most: int = 20) -> DataFrame:
    """(start, length, path): one shortest path to ``goal``, the least in order of its nodes; none if there is none."""
    e = cut(edges.select("src", "dst").distinct())
    front = starts.select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    seen = front.select("start", "node")
    for depth in range(1, most + 1):
        step = front.join(e, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        s = seen.select(F.col("start").alias("_s"), F.col("node").alias("_n"))
        front = cut(step.join(s, (F.col("start") == F.col("_s")) & (F.col("node") == F.col("_n")), "left_anti"))
        hit = front.filter(F.col("node") == goal)
        if not hit.isEmpty():
            return hit.select("start", F.lit(depth).alias("length"), F.array_join("path", " > ").alias("path"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front.select("start", "node")))
    return starts.select("start", F.lit(0).alias("length"), F.lit("").alias("path")).limit(0)


def with_index(edges: DataFrame, derived: DataFrame) -> DataFrame:
    """Registered edges and those derived from the index, each once."""
    return edges.select("src", "dst").unionByName(derived.select("src", "dst")).distinct()


def replaced(edges: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The graph after nodes were removed in both directions and the edges of new or updated nodes were put in."""
    gone = removed.select(F.col("node").alias("_g"))
    left = edges.join(gone, F.col("src") == F.col("_g"), "left_anti").join(gone, F.col("dst") == F.col("_g"), "left_anti")
    return left.unionByName(added).distinct()
