"""Queries over the call graph of the code base, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.operators import graph as G
from lodeworks.plans.lineage import cut
from lodeworks.tables import load

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Calls between named functions; the name after the last dot stands for a method.
EDGES = r"""edges AS (SELECT DISTINCT regexp_replace(name, '^.*\.', '') AS src, regexp_replace(c, '^.*\.', '') AS dst FROM (SELECT name, unnest(call_targets) AS c FROM extracted_units)
  WHERE regexp_replace(name, '^.*\.', '') IN (SELECT regexp_replace(name, '^.*\.', '') FROM extracted_units) AND regexp_replace(c, '^.*\.', '') IN (SELECT regexp_replace(name, '^.*\.', '') FROM extracted_units))"""
_STARTED = "starts AS (SELECT dst AS start FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 3)"
_START = "starts AS (SELECT src AS start FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 3)"


def _last(c):
    return F.regexp_replace(c, r"^.*\.", "")


def call_edges(spark, sf_dir):
    u = load(spark, sf_dir, "extracted_units")
    names = u.select(_last(F.col("name")).alias("n")).distinct()
    e = u.select(_last(F.col("name")).alias("src"), F.explode("call_targets").alias("c")).select("src", _last(F.col("c")).alias("dst")).distinct()
    return e.join(names, F.col("dst") == F.col("n"), "left_semi")


def _starts(edges, end="src"):
    return edges.groupBy(F.col(end).alias("src")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "src").limit(3).select(F.col("src").alias("start"))


_DOWN = f"WITH RECURSIVE {EDGES}, {_START}, r(start, node) AS (SELECT start, dst FROM starts JOIN edges ON src = start UNION SELECT r.start, e.dst FROM r JOIN edges e ON e.src = r.node)"
_UP = f"WITH RECURSIVE {EDGES}, {_STARTED}, r(start, node) AS (SELECT start, src FROM starts JOIN edges ON dst = start UNION SELECT r.start, e.src FROM r JOIN edges e ON e.dst = r.node)"


@query(f"WITH {EDGES}, n AS (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) SELECT node, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM n GROUP BY node")
def graph_degrees(spark, sf_dir):
    return G.degrees(call_edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT count(*) AS edges_n, count(DISTINCT src) AS sources, round(count(*) / nullif(count(DISTINCT src), 0), 6) AS mean_degree FROM edges")
def graph_stats(spark, sf_dir):
    e = call_edges(spark, sf_dir)
    return e.agg(F.count(F.lit(1)).alias("edges_n"), F.count_distinct("src").alias("sources")).withColumn("mean_degree", F.round(F.try_divide("edges_n", "sources"), 6))


@query(f"WITH {EDGES}, {_START} SELECT start, dst AS node, 'calls' AS kind FROM starts JOIN edges ON src = start UNION ALL SELECT start, src, 'called by' FROM starts JOIN edges ON dst = start")
def graph_direct(spark, sf_dir):
    e = call_edges(spark, sf_dir)
    s = F.broadcast(_starts(e))
    return e.join(s, F.col("src") == F.col("start")).select("start", F.col("dst").alias("node"), F.lit("calls").alias("kind")).unionByName(e.join(s, F.col("dst") == F.col("start")).select("start", F.col("src").alias("node"), F.lit("called by").alias("kind")))


@query(_DOWN + " SELECT start, node FROM r")
def graph_closure_down(spark, sf_dir):
    e = call_edges(spark, sf_dir)
    return G.closure(e, _starts(e)).select("start", "node")


@query(_UP + " SELECT start, node FROM r")
def graph_closure_up(spark, sf_dir):
    e = call_edges(spark, sf_dir)
    return G.closure(G.reversed_edges(e), _starts(e, "dst")).select("start", "node")


_STEPS = """steps AS (SELECT event_type || '@' || (user_id // 30) AS src, lead(event_type || '@' || (user_id // 30)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
  walks AS (SELECT DISTINCT src, dst FROM steps WHERE dst IS NOT NULL UNION SELECT src, dst FROM edges)"""


@query(f"WITH RECURSIVE {EDGES}, {_STEPS}, r(start, node) AS (SELECT src, dst FROM walks UNION SELECT r.start, e.dst FROM r JOIN walks e ON e.src = r.node) SELECT DISTINCT node FROM r WHERE start = node")
def graph_cycle_nodes(spark, sf_dir):
    """Nodes on cycles of the call graph together with the steps that users take between events."""
    name = F.concat(F.col("event_type"), F.lit("@"), F.floor(F.col("user_id") / 30).cast("string"))
    steps = load(spark, sf_dir, "events").select(name.alias("src"), F.lead(name).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst")).filter("dst IS NOT NULL").distinct()
    return G.on_cycles(steps.unionByName(call_edges(spark, sf_dir)))


@query(f"WITH {EDGES}, {_START}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), a AS (SELECT start, dst AS node FROM starts JOIN both_ways ON src = start), b AS (SELECT start, e.dst AS node FROM a JOIN both_ways e ON e.src = a.node), u AS (SELECT start, start AS node, 0 AS depth FROM starts UNION ALL SELECT start, node, 1 FROM a UNION ALL SELECT start, node, 2 FROM b) SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM u GROUP BY start, node")
def graph_neighbourhood(spark, sf_dir):
    e = call_edges(spark, sf_dir)
    return G.neighbourhood(e, _starts(e), 2)


@query(_UP + " SELECT r.start, r.node, e.dst IS NOT NULL AS direct FROM r LEFT JOIN edges e ON e.src = r.node AND e.dst = r.start")
def graph_impact(spark, sf_dir):
    """What depends on each start, directly or through others."""
    e = call_edges(spark, sf_dir)
    return G.closure(G.reversed_edges(e), _starts(e, "dst")).select("start", "node", (F.col("depth") == 1).alias("direct"))


@query(f"WITH {EDGES}, n AS (SELECT count(DISTINCT src) AS n FROM edges), d AS (SELECT node, count(*) AS c FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node) SELECT node, round(CASE WHEN n <= 1 THEN 1.0 ELSE greatest(0.0, 1 - c / (n - 1)) END, 6) AS score FROM d, n")
def coupling_scores(spark, sf_dir):
    return G.coupling(call_edges(spark, sf_dir)).select("node", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {EDGES}, {_START}, d(start, node) AS (SELECT start, dst FROM starts JOIN edges ON src = start UNION SELECT d.start, e.dst FROM d JOIN edges e ON e.src = d.node),
u(start, node) AS (SELECT start, src FROM starts JOIN edges ON dst = start UNION SELECT u.start, e.src FROM u JOIN edges e ON e.dst = u.node), c AS (SELECT start, count(*) AS affected FROM (SELECT * FROM d UNION SELECT * FROM u) GROUP BY start),
s AS (SELECT start, affected, affected / (SELECT greatest(count(DISTINCT src) - 1, 1) FROM edges) AS share FROM c)
SELECT start, affected, round(share, 6) AS share, CASE WHEN share < 0.1 THEN 'low' WHEN share < 0.3 THEN 'medium' WHEN share < 0.6 THEN 'high' ELSE 'critical' END AS level FROM s""")
def change_impact(spark, sf_dir):
    e = call_edges(spark, sf_dir)
    return G.change_impact(e, _starts(e))


@query(f"""WITH RECURSIVE {EDGES}, {_START}, r(start, node, depth) AS (SELECT start, start, 0 FROM starts UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 8),
goal AS (SELECT max(node) AS g FROM r WHERE depth > 0), l AS (SELECT start, min(depth) AS depth FROM r, goal WHERE node = g AND depth > 0 GROUP BY start)
SELECT start, CAST(depth AS INTEGER) AS length FROM l WHERE depth = (SELECT min(depth) FROM l)""")
def shortest_call_paths(spark, sf_dir):
    """The starts nearest to the last function by name that they reach, with the length of the way."""
    e = cut(call_edges(spark, sf_dir))
    starts = cut(_starts(e))
    goal = G.closure(e, starts, 8).agg(F.max("node").alias("g")).first()["g"]
    return G.shortest_paths(e, starts, goal or "", 8).select("start", "length")


@query(f"""WITH {EDGES}, g AS (SELECT DISTINCT src AS node FROM edges WHERE src LIKE 'load%'), k AS (SELECT * FROM edges WHERE src NOT IN (SELECT node FROM g) AND dst NOT IN (SELECT node FROM g)) SELECT src, dst FROM k UNION SELECT node, 'started' FROM g""")
def graph_update(spark, sf_dir):
    """The graph after the loading functions were taken out and put back with one call each."""
    e = call_edges(spark, sf_dir)
    gone = e.filter(F.col("src").startswith("load")).select(F.col("src").alias("node")).distinct()
    return G.replaced(e, gone, gone.select(F.col("node").alias("src"), F.lit("started").alias("dst")))


@query(f"WITH {EDGES} SELECT src, string_agg(dst, ',' ORDER BY dst) AS targets FROM edges GROUP BY src")
def graph_export(spark, sf_dir):
    from lodeworks.operators.store import edges_json

    return edges_json(call_edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT src, dst FROM edges")
def graph_round_trip(spark, sf_dir):
    from lodeworks.operators.store import edges_from, edges_json

    return edges_from(edges_json(call_edges(spark, sf_dir)))
