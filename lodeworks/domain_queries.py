"""Queries over JSON documents, rule joins and operational analytics, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators import documents as D
from lodeworks.operators import operations as O
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


#: Required keys of the document kinds. Fixed values.
REQUIRED = {
    "Patient": ["id", "resourceType", "name", "gender", "birthDate"],
    "Condition": ["id", "resourceType", "code", "subject"],
    "Observation": ["id", "resourceType", "status", "code"],
    "Procedure": ["id", "resourceType", "status", "code", "subject"],
    "MedicationRequest": ["id", "resourceType", "status", "intent", "medication", "subject"],
    "Encounter": ["id", "resourceType", "status", "class", "subject"],
    "AllergyIntolerance": ["id", "resourceType", "patient"],
}


def _resources(spark, sf_dir):
    """Rows of the small tables as JSON documents of all kinds, each lacking some keys; null values leave their key out."""

    def docs(table, letter, key, kind, **fields):
        t = load(spark, sf_dir, table)
        ident = F.concat(F.lit(letter), F.col(key).cast("string"))
        return t.select(ident.alias("id"), F.lit(kind).alias("kind"), F.to_json(F.struct(ident.alias("id"), F.lit(kind).alias("resourceType"), *[v.alias(k) for k, v in fields.items()])).alias("doc"))

    c, q = F.col, F.lit
    text = lambda x: F.struct(c(x).alias("text"))
    parts = [
        docs("customer", "p", "c_custkey", "Patient", name=c("c_name"), _segment=c("c_mktsegment"), gender=F.when(c("c_acctbal") > 0, c("c_nationkey").cast("string")), given=F.array(c("c_mktsegment"), c("c_nationkey").cast("string")), contact=F.struct(c("c_name").alias("name"))),
        docs("orders", "e", "o_orderkey", "Encounter", status=c("o_orderstatus"), **{"class": c("o_orderpriority")}),
        docs("part", "o", "p_partkey", "Observation", code=text("p_type"), status=F.when(c("p_size") > 25, q("final"))),
        docs("supplier", "c", "s_suppkey", "Condition", code=text("s_name"), subject=F.when(c("s_acctbal") > 0, c("s_name"))),
        docs("nation", "r", "n_nationkey", "Procedure", status=q("done"), code=text("n_name")),
        docs("region", "m", "r_regionkey", "MedicationRequest", status=q("active"), intent=q("order")),
        docs("region", "a", "r_regionkey", "AllergyIntolerance", note=c("r_name")),
    ]
    return reduce(DataFrame.unionByName, parts)


_MISSING = """SELECT 'p' || c_custkey AS id, 'Patient' AS kind, ['birthDate'] || CASE WHEN c_acctbal > 0 THEN [] ELSE ['gender'] END AS m FROM customer UNION ALL SELECT 'e' || o_orderkey, 'Encounter', ['subject'] FROM orders
UNION ALL SELECT 'o' || p_partkey, 'Observation', CASE WHEN p_size > 25 THEN [] ELSE ['status'] END FROM part UNION ALL SELECT 'c' || s_suppkey, 'Condition', CASE WHEN s_acctbal > 0 THEN [] ELSE ['subject'] END FROM supplier
UNION ALL SELECT 'r' || n_nationkey, 'Procedure', ['subject'] FROM nation UNION ALL SELECT 'm' || r_regionkey, 'MedicationRequest', ['medication', 'subject'] FROM region UNION ALL SELECT 'a' || r_regionkey, 'AllergyIntolerance', ['patient'] FROM region"""


@query(f"WITH r AS ({_MISSING}) SELECT id, kind, unnest(m) AS missing FROM r")
def documents_missing_fields(spark, sf_dir):
    return D.missing_fields(_resources(spark, sf_dir), "doc", "kind", REQUIRED).select("id", "kind", F.explode("missing").alias("missing"))


@query("SELECT 'p' || c_custkey AS id FROM customer WHERE contains(c_mktsegment || ',' || c_nationkey, 'ING,1')")
def documents_search_nested(spark, sf_dir):
    """Search in an array, which reads as its elements joined by commas, and in an object, which reads as its kind alone."""
    return D.search(_resources(spark, sf_dir).filter("kind = 'Patient'"), "doc", {"given": "ING,1", "contact": "[object"}).select("id")


@query("SELECT 'r' || n_nationkey AS id, 'subject' AS missing FROM nation")
def document_folder_read(spark, sf_dir):
    """Documents written one a file, read back from their folder and validated on reading; what they lack."""
    from lodeworks.plans.lineage import scratch
    from lodeworks.sources import files

    folder = scratch(spark, "documents")
    _resources(spark, sf_dir).filter("kind = 'Procedure'").select(F.from_json("doc", "id string, resourceType string, status string, code struct<text: string>").alias("d")).select("d.*").write.option("maxRecordsPerFile", 1).json(folder)
    read = files.json_folder(spark, folder).select(F.get_json_object("doc", "$.id").alias("id"), F.get_json_object("doc", "$.resourceType").alias("kind"), "doc")
    return D.missing_fields(read, "doc", "kind", REQUIRED).select("id", F.explode("missing").alias("missing"))


@query("SELECT 'p' || c_custkey AS id, true AS same, c_mktsegment AS segment FROM customer")
def documents_pretty(spark, sf_dir):
    """Documents as indented JSON and back: the segment survives, the text parses to the same document."""
    d = _resources(spark, sf_dir).filter("kind = 'Patient'").select("id", F.parse_json("doc").alias("v"))
    pretty = d.select("id", "v", F.to_json("v", {"pretty": "true"}).alias("text"))
    return pretty.select("id", (F.to_json(F.parse_json("text")) == F.to_json("v")).alias("same"), F.variant_get(F.parse_json("text"), "$._segment", "string").alias("segment"))


@query("SELECT 'store' AS name, '4.0.1' AS version, unnest(['Patient', 'Condition', 'Observation', 'Procedure', 'MedicationRequest', 'Encounter', 'AllergyIntolerance']) AS kind, unnest([5, 4, 4, 5, 6, 5, 3]) AS required")
def capability_record(spark, sf_dir):
    """What the document store can validate: a static record."""
    return spark.createDataFrame([("store", "4.0.1", k, len(v)) for k, v in REQUIRED.items()], "name string, version string, kind string, required int")


@query("SELECT 'p' || c_custkey AS id, coalesce(arg_max(event_type, (ts, event_id)), 'not_found') AS status FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey")
def task_status(spark, sf_dir):
    """The last state of each task asked for, not_found where none was ever sent."""
    asked = load(spark, sf_dir, "customer").select("c_custkey")
    last = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("_u")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("s"))
    return asked.join(last, F.col("c_custkey") == F.col("_u"), "left").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("id"), F.coalesce("s", F.lit("not_found")).alias("status"))


@query("SELECT 'p' || c_custkey AS id FROM customer WHERE contains(c_mktsegment, 'BUILD') AND contains(c_name, '1') ORDER BY id LIMIT 20 OFFSET 10")
def documents_search_page(spark, sf_dir):
    found = D.search(_resources(spark, sf_dir).filter("kind = 'Patient'"), "doc", {"segment": "BUILD", "name": "1"})
    return found.select("id").orderBy("id").offset(10).limit(20)


@query("SELECT count(*) AS total FROM customer WHERE contains(c_mktsegment, 'BUILD') AND contains(c_name, '1')")
def documents_search_total(spark, sf_dir):
    return D.search(_resources(spark, sf_dir).filter("kind = 'Patient'"), "doc", {"segment": "BUILD", "name": "1"}).agg(F.count(F.lit(1)).alias("total"))


@query("""WITH ops AS (SELECT 'p' || c_custkey AS id, event_id, event_type FROM events JOIN customer ON c_custkey = user_id), l AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1)
SELECT 'p' || c_custkey AS id, CASE WHEN event_type IS NULL OR event_type = 'error' THEN 'kept' ELSE 'changed' END AS state FROM customer LEFT JOIN l ON l.id = 'p' || c_custkey WHERE event_type IS DISTINCT FROM 'purchase'""")
def documents_batch(spark, sf_dir):
    """The patients after a batch of operations drawn from events: purchases delete, errors change nothing."""
    docs = _resources(spark, sf_dir).filter("kind = 'Patient'").select("id", F.lit("kept").alias("doc"))
    ids = docs.select(F.col("id").alias("_i"))
    ops = load(spark, sf_dir, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("id"), "event_id", F.when(F.col("event_type") == "purchase", "delete").otherwise("update").alias("op"), F.when(F.col("event_type") == "error", "kept").otherwise("changed").alias("doc"))
    ops = ops.join(ids, F.col("id") == F.col("_i"), "left_semi")
    return D.apply_operations(docs, ops, "id", "event_id").select("id", F.col("doc").alias("state"))


_NEEDS = (("1-URGENT", "R"), ("2-HIGH", "A"), ("3-MEDIUM", "N"))


@query("""WITH rules(condition, needed) AS (VALUES ('1-URGENT', 'R'), ('2-HIGH', 'A'), ('3-MEDIUM', 'N')), h AS (SELECT DISTINCT o_orderkey AS subject, o_orderpriority AS condition FROM orders),
d AS (SELECT subject, condition, needed FROM h JOIN rules USING (condition)) SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = subject AND l_returnflag = needed)""")
def rule_gaps(spark, sf_dir):
    """Orders of a priority that lack a line with the flag a stated rule asks for."""
    rules = spark.createDataFrame(_NEEDS, "condition string, needed string")
    have = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subject"), F.col("o_orderpriority").alias("condition"))
    others = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_returnflag").alias("flag"))
    return D.lacking(have, rules, others, "subject", "condition", "needed", "flag")


@query("""WITH s AS (SELECT l_orderkey AS subject, bool_or(contains(lower(p_type), 'economy')) AS b, bool_or(contains(lower(p_type), 'promo')) AS t, bool_or(contains(lower(p_type), 'large')) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT subject, 'economy + promo' AS pair FROM s WHERE b AND t UNION ALL SELECT subject, 'large + promo' FROM s WHERE s AND t""")
def pairs_together(spark, sf_dir):
    """Orders that hold both parts of a stated pair of kinds."""
    items = load(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("subject")).join(load(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("item")), F.col("l_partkey") == F.col("p_partkey"))
    return D.together(items, [("economy", "promo"), ("large", "promo")], "subject", "item")


@query("""WITH r AS (SELECT l_partkey, quantile_cont(l_quantity, 0.1) AS low, quantile_cont(l_quantity, 0.9) AS high FROM lineitem GROUP BY l_partkey HAVING count(*) >= 10)
SELECT CASE WHEN low IS NULL THEN 'UNKNOWN' WHEN l_quantity < low THEN 'LOW' WHEN l_quantity > high THEN 'HIGH' ELSE 'NORMAL' END AS status, count(*) AS n FROM lineitem LEFT JOIN r USING (l_partkey) GROUP BY 1""")
def range_status(spark, sf_dir):
    """Quantities against the middle four fifths of their part's, where the part has ten lines or more."""
    l = load(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    r = l.groupBy(F.col("l_partkey").alias("_p")).agg(F.percentile("l_quantity", F.lit(0.1)).alias("low"), F.percentile("l_quantity", F.lit(0.9)).alias("high"), F.count(F.lit(1)).alias("n")).filter("n >= 10").drop("n")
    return l.join(r, F.col("l_partkey") == F.col("_p"), "left").groupBy(D.in_range(F.col("l_quantity"), F.col("low"), F.col("high")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'viewer' WHEN contains('https://intake.local/signup/error', event_type) THEN 'intake' WHEN contains('https://shop.local/purchase', event_type) THEN 'shop' END AS route FROM events""")
def message_routes(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "viewer").otherwise(F.col("event_type")).alias("to"))
    return D.routed(e, [("viewer", "https://viewer.local/x"), ("intake", "https://intake.local/signup/error"), ("shop", "https://shop.local/purchase")], "to").select("event_id", "route")


@query("""WITH g(seg, steps) AS (VALUES ('BUILDING', ['survey', 'permit']), ('MACHINERY', ['inspect'])) SELECT c_custkey, unnest(coalesce(steps, ['review'])) AS step, generate_subscripts(coalesce(steps, ['review']), 1) AS position FROM customer LEFT JOIN g ON seg = c_mktsegment""")
def lookup_with_default(spark, sf_dir):
    g = spark.createDataFrame([("BUILDING", ["survey", "permit"]), ("MACHINERY", ["inspect"])], "seg string, steps array<string>")
    keys = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    out = D.with_default(keys, g, "seg", "steps", ["review"])
    return out.select("c_custkey", F.posexplode("steps").alias("i", "step")).select("c_custkey", "step", (F.col("i") + 1).cast("long").alias("position"))


@query("""WITH e AS (SELECT *, epoch(ts - lag(ts) OVER w) > 3600 AS pause FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), s AS (SELECT *, sum(CASE WHEN coalesce(pause, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS session FROM e),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, session ORDER BY ts, event_id) AS attempt FROM s) SELECT event_type, count(*) FILTER (attempt = 1) AS sessions_n, count(*) FILTER (attempt > 2) AS refused, max(attempt) AS longest FROM a GROUP BY event_type""")
def attempt_sessions(spark, sf_dir):
    """Attempts in sessions that end after an hour's pause; from the third on they are refused."""
    s = O.sessions(load(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 60)
    return s.groupBy("event_type").agg(F.count_if(F.col("attempt") == 1).alias("sessions_n"), F.count_if(F.col("attempt") > 2).alias("refused"), F.max("attempt").cast("long").alias("longest"))


@query("""WITH RECURSIVE c AS (SELECT event_type AS key, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY second) AS i FROM c),
r(key, i, second, tokens, allowed, blocked) AS (SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, 3.0::DOUBLE, 0::BIGINT, 0::BIGINT FROM o UNION ALL
SELECT key, i, second, t - take, allowed + take, blocked + n - take FROM (SELECT *, least(n, CAST(floor(t) AS BIGINT)) AS take FROM (SELECT o.key, o.i, o.second, o.n, r.allowed, r.blocked, CASE WHEN r.second IS NULL THEN r.tokens ELSE least(3.0, r.tokens + (o.second - r.second) * 0.001) END AS t FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1)))
SELECT key, max(allowed) AS allowed, max(blocked) AS blocked FROM r GROUP BY key""")
def token_bucket(spark, sf_dir):
    return O.token_bucket(load(spark, sf_dir, "events"), "event_type", "ts", 3, 0.001)


@query("""WITH b AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS f, count(*) FILTER (value > 95) AS blocked, count(*) FILTER (event_type = 'view') AS hits FROM events), r AS (SELECT round(1 - f / n, 6) AS success_rate, round(blocked / n, 6) AS block_rate, round(hits / n, 6) AS hit_rate FROM b)
SELECT *, success_rate > 0.5 AND block_rate < 0.1 AS healthy, array_to_string(list_filter([CASE WHEN success_rate <= 0.5 THEN 'failures' END, CASE WHEN block_rate >= 0.1 THEN 'blocked' END, CASE WHEN hit_rate < 0.1 THEN 'cold cache' END], lambda x: x IS NOT NULL), ',') AS warnings FROM r""")
def health_rollup(spark, sf_dir):
    n = F.count(F.lit(1))
    e = load(spark, sf_dir, "events").agg(F.round(1 - F.try_divide(F.count_if(F.col("event_type") == "error"), n), 6).alias("success_rate"), F.round(F.try_divide(F.count_if(F.col("value") > 95), n), 6).alias("block_rate"), F.round(F.try_divide(F.count_if(F.col("event_type") == "view"), n), 6).alias("hit_rate"))
    return O.health(e)


@query("""SELECT event_id, round(avg(value) OVER w, 9) AS rolling_mean, count(value) OVER w AS rolling_n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def rolling_latency(spark, sf_dir):
    return O.rolling(load(spark, sf_dir, "events"), "event_type", "value", "ts", "event_id", 100).select("event_id", F.round("rolling_mean", 9).alias("rolling_mean"), "rolling_n")


@query("""SELECT n_name, count(*) AS orders_n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def orders_by_nation(spark, sf_dir):
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    r = load(spark, sf_dir, "region")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders_n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
