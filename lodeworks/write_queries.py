"""Queries over the write path, tokens, limits and settings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.functions import text as T
from lodeworks.operators import operations as O
from lodeworks.operators import store as S
from lodeworks.operators import writes as W
from lodeworks.sources import settings
from lodeworks.store_queries import AUDITS, NOW, _audits
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


_SECRET = "(" + " OR ".join("regexp_matches(new, '" + p.replace("'", "''") + "')" for _, p, _ in T.SECRETS) + ")"
_BATCH = rf"""cur AS (SELECT path, max(content) AS content FROM file_contents WHERE path IS NOT NULL GROUP BY path),
rows AS (SELECT id, max(seq) AS seq, max(timestamp) AS ts, max(content) AS content, max(regexp_replace(regexp_replace(replace(file_path, '\', '/'), '/+', '/', 'g'), '^\.(/|$)', '\1')) AS path FROM versions WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id),
batch AS (SELECT path, arg_max(content, (ts, seq, id)) AS new FROM rows GROUP BY path)"""


def _batch(spark, sf_dir):
    """(current files, newest content of each versioned file)."""
    from lodeworks.operators.history import clean_path

    current = load(spark, sf_dir, "file_contents").filter("path IS NOT NULL").groupBy("path").agg(F.max("content").alias("content"))
    v = load(spark, sf_dir, "versions").filter("id IS NOT NULL AND content IS NOT NULL")
    rows = v.groupBy("id").agg(F.max("seq").alias("seq"), F.max("timestamp").alias("ts"), F.max("content").alias("content"), F.max(clean_path(F.col("file_path"))).alias("path"))
    return current, rows.groupBy("path").agg(F.max_by("content", F.struct("ts", "seq", "id")).alias("content"))


@query(f"""WITH {_BATCH} SELECT b.path, CASE WHEN {_SECRET} THEN 'secret' WHEN octet_length(encode(new)) > 400 THEN 'too large' WHEN c.path IS NULL THEN 'created' WHEN coalesce(c.content, '') = new THEN 'unchanged' ELSE 'changed' END AS outcome FROM batch b LEFT JOIN cur c ON c.path = b.path""")
def write_outcomes(spark, sf_dir):
    """What writing the newest version of every file comes to, at 400 bytes a file."""
    return W.written(*_batch(spark, sf_dir), 400).select("path", "outcome")


@query(f"""WITH {_BATCH}, o AS (SELECT b.path, new, c.content FROM batch b JOIN cur c ON c.path = b.path WHERE NOT {_SECRET} AND octet_length(encode(new)) <= 400 AND coalesce(c.content, '') <> new) SELECT path, sha256(coalesce(content, '')) AS hash, octet_length(encode(coalesce(content, ''))) AS size FROM o""")
def write_versions(spark, sf_dir):
    """The contents that those writes keep as versions."""
    current, batch = _batch(spark, sf_dir)
    out = W.written(current, batch, 400).filter("versioned").select(F.col("path").alias("_p"), "old_hash")
    return current.join(out, F.col("path") == F.col("_p")).select("path", F.col("old_hash").alias("hash"), F.octet_length(F.coalesce("content", F.lit(""))).cast("long").alias("size"))


@query(f"""WITH {_BATCH} SELECT b.path, CASE WHEN c.path IS NOT NULL AND {_SECRET} THEN 'secret' WHEN c.path IS NOT NULL THEN 'appended' ELSE 'not found' END AS outcome,
length(CASE WHEN c.path IS NOT NULL AND NOT {_SECRET} THEN coalesce(c.content, '') || new ELSE c.content END) AS length FROM batch b LEFT JOIN cur c ON c.path = b.path""")
def append_outcomes(spark, sf_dir):
    """The newest versions put behind the files they belong to; files that are missing are not created."""
    return W.appended(*_batch(spark, sf_dir), False).select("path", "outcome", F.length("content").cast("long").alias("length"))


_OPS = """docs AS (SELECT 'p' || c_custkey AS key, '{"id":"p' || c_custkey || '","segment":"' || c_mktsegment || '"}' AS doc FROM customer WHERE c_custkey % 2 = 0),
ops AS (SELECT event_id AS seq, 'p' || user_id AS key, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'update' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'delete' ELSE 'merge' END AS op,
 CASE WHEN event_type IN ('signup', 'click') THEN CASE WHEN value > 2 THEN '{"id":"p' || user_id || '","n":' || event_id || '}' ELSE '{"n":' || event_id || '}' END END AS doc FROM events),
f AS (SELECT *, CASE WHEN op = 'merge' THEN 'unknown op' WHEN op = 'create' AND NOT contains(doc, '"id"') THEN 'no id' END AS fails FROM ops),
m AS (SELECT *, last_value(CASE WHEN fails IS NULL AND op IN ('create', 'update') THEN doc WHEN fails IS NULL AND op = 'delete' THEN '' END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS met FROM f),
done AS (SELECT m.*, CASE WHEN met IS NULL THEN docs.doc WHEN met <> '' THEN met END AS before FROM m LEFT JOIN docs ON docs.key = m.key),
outcomes AS (SELECT *, coalesce(fails, CASE WHEN op = 'read' AND before IS NULL THEN 'not found' END) AS error FROM done)"""


def _documents(spark, sf_dir):
    """Customers as documents, and the events as operations on them."""
    c = load(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    key = F.concat(F.lit("p"), F.col("c_custkey").cast("string"))
    docs = c.select(key.alias("key"), F.to_json(F.struct(key.alias("id"), F.col("c_mktsegment").alias("segment"))).alias("doc"))
    e = load(spark, sf_dir, "events")
    op = T.first_label([(F.col("event_type") == a, b) for a, b in (("signup", "create"), ("click", "update"), ("view", "read"), ("purchase", "delete"))], "merge")
    who = F.concat(F.lit("p"), F.col("user_id").cast("string"))
    doc = F.when(F.col("value") > 2, F.to_json(F.struct(who.alias("id"), F.col("event_id").alias("n")))).otherwise(F.to_json(F.struct(F.col("event_id").alias("n"))))
    return docs, e.select(F.col("event_id").alias("seq"), who.alias("key"), op.alias("op"), F.when(F.col("event_type").isin("signup", "click"), doc).alias("doc"))


@query(f"WITH {_OPS} SELECT seq, key, op, error IS NULL AS success, error FROM outcomes")
def document_outcomes(spark, sf_dir):
    """Create, read, update and delete in order, with the outcome of each; a failure never ends the batch."""
    return W.document_outcomes(*_documents(spark, sf_dir)).select("seq", "key", "op", "success", "error")


@query(f"WITH {_OPS}, t AS (SELECT *, CASE WHEN op = 'delete' THEN before ELSE doc END AS text FROM outcomes WHERE error IS NULL AND op IN ('create', 'update', 'delete')) SELECT key, seq, sha256(text) AS hash, octet_length(encode(text)) AS size, CASE op WHEN 'delete' THEN 'File deleted' ELSE op END AS message FROM t WHERE text IS NOT NULL")
def document_versions(spark, sf_dir):
    """The versions and tombstones that these operations leave."""
    return W.document_versions(W.document_outcomes(*_documents(spark, sf_dir)))


@query(f"WITH {_OPS}, l AS (SELECT key, arg_max(op, seq) AS op, arg_max(doc, seq) AS doc FROM outcomes WHERE error IS NULL AND op IN ('create', 'update', 'delete') GROUP BY key) SELECT coalesce(docs.key, l.key) AS key, coalesce(l.doc, docs.doc) AS doc FROM docs FULL JOIN l ON l.key = docs.key WHERE l.op IS DISTINCT FROM 'delete'")
def document_store_after(spark, sf_dir):
    docs, ops = _documents(spark, sf_dir)
    return W.store_after(docs, W.document_outcomes(docs, ops))


@query(f"WITH {_OPS} SELECT op, count(*) AS n, count(*) FILTER (error IS NOT NULL) AS failed, count(*) FILTER (error IS NOT NULL) * 2 > count(*) AS warns FROM outcomes GROUP BY op")
def batch_summary(spark, sf_dir):
    """Per kind of operation how many failed, and whether more than half did."""
    o = W.document_outcomes(*_documents(spark, sf_dir))
    failed = F.count_if(~F.col("success"))
    return o.groupBy("op").agg(F.count(F.lit(1)).alias("n"), failed.alias("failed"), (failed * 2 > F.count(F.lit(1))).alias("warns"))


_TOKENS = f"tokens AS (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'admin' WHEN user_id % 2 = 0 THEN 'user' ELSE 'guest' END AS role, sha256(CAST(user_id AS VARCHAR)) AS hash, min(ts) AS created_at, CASE WHEN user_id % 5 = 0 THEN max(ts) FILTER (event_type = 'error') END AS revoked_at FROM events GROUP BY user_id)"


def _tokens(spark, sf_dir):
    """Tokens issued at a user's first event, revoked for every fifth user with an error; only hashes are kept."""
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("err"))
    role = T.first_label([(F.col("user_id") % 7 == 0, "admin"), (F.col("user_id") % 2 == 0, "user")], "guest")
    return e.select("user_id", role.alias("role"), F.sha2(F.col("user_id").cast("string"), 256).alias("hash"), "created_at", F.when(F.col("user_id") % 5 == 0, F.col("err")).alias("revoked_at"))


@query(f"WITH {_TOKENS} SELECT role, count(*) FILTER (revoked_at IS NULL) AS live, count(*) AS issued FROM tokens GROUP BY role")
def tokens_by_role(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy("role").agg(F.count_if(F.col("revoked_at").isNull()).alias("live"), F.count(F.lit(1)).alias("issued"))


@query(f"WITH {_TOKENS} SELECT user_id, role, hash, created_at, row_number() OVER (ORDER BY created_at DESC, user_id DESC) AS place FROM tokens ORDER BY place LIMIT 100")
def tokens_newest(spark, sf_dir):
    """The newest hundred tokens, numbered."""
    t = S.page(_tokens(spark, sf_dir), [F.desc("created_at"), F.desc("user_id")], 100)
    w = Window.orderBy(F.desc("created_at"), F.desc("user_id"))  # over the page alone
    return t.withColumn("place", F.row_number().over(w).cast("long")).select("user_id", "role", "hash", "created_at", "place")


@query(f"""WITH {_TOKENS}, n AS (SELECT coalesce(max(user_id), 0) AS m FROM tokens), again AS (SELECT user_id, role, hash, created_at, coalesce(revoked_at, CASE WHEN role = 'guest' THEN TIMESTAMP '{NOW}' END) AS revoked_at FROM tokens UNION ALL SELECT m + 1, 'admin', sha256(CAST(m + 1 AS VARCHAR)), TIMESTAMP '{NOW}', NULL FROM n)
SELECT user_id, role, hash, revoked_at IS NULL AS live FROM again""")
def token_changes(spark, sf_dir):
    """Tokens after one is issued to an administrator and those of guests are revoked; a token revoked before keeps its time."""
    t = _tokens(spark, sf_dir)
    now = F.lit(NOW).cast("timestamp_ntz")
    new = t.agg((F.coalesce(F.max("user_id"), F.lit(0)) + 1).alias("user_id"))
    issued = S.issued(new.withColumn("role", F.lit("admin")), "user_id", now)
    after = S.revoked(t, F.col("role") == "guest", now).unionByName(issued)
    return after.select("user_id", "role", "hash", F.col("revoked_at").isNull().alias("live"))


@query(f"WITH {AUDITS}, newest AS (SELECT * FROM audits ORDER BY ts DESC, id DESC LIMIT 100) SELECT id, action, ts FROM newest ORDER BY ts DESC, id DESC LIMIT 20")
def jobs_recent(spark, sf_dir):
    """Of the hundred newest jobs that are kept the twenty newest."""
    a = _audits(spark, sf_dir)
    order = S.newest(a, "ts", "id")
    return S.page(S.page(a, order, 100), order, 20).select("id", "action", "ts")


@query(f"WITH {AUDITS} SELECT id, ts, action, result FROM audits UNION ALL SELECT max(id) + 1, TIMESTAMP '{NOW}', 'gate', 'blocked' FROM audits")
def enforcement_append(spark, sf_dir):
    """The log with one enforcement row more."""
    a = _audits(spark, sf_dir).select("id", "ts", "action", "result")
    row = a.agg((F.max("id") + 1).alias("id")).select("id", F.lit(NOW).cast("timestamp_ntz").alias("ts"), F.lit("gate").alias("action"), F.lit("blocked").alias("result"))
    return a.unionByName(row)


@query("SELECT path, indexed_at FROM handling_vectors WHERE false")
def vectors_truncated(spark, sf_dir):
    """The vector table emptied: its columns without rows."""
    return load(spark, sf_dir, "handling_vectors").select("path", "indexed_at").limit(0)


@query()
def limiter_stats(spark, sf_dir):
    """Allowed and blocked calls under a bucket for all and one per action, calls of several costs, refunds where the second is empty."""
    e = load(spark, sf_dir, "events").select(F.lit("all").alias("limiter"), F.col("event_type").alias("tool"), "ts", "event_id")
    return O.two_level_bucket(e, "limiter", "tool", "ts", (50.0, 0.02), (20.0, 0.004), {"purchase": 5, "signup": 2})


@query("SELECT * FROM (VALUES ('cache.ttl', '60', 'environment'), ('limits.search', '25', 'file'), ('security.enforce', 'True', 'default')) t(name, value, source)")
def settings_effective(spark, sf_dir):
    """Settings from defaults, a file and the environment, with where each came from; guarded ones stay."""
    merged = settings.merged({"cache.ttl": 300, "limits.search": 10, "security.enforce": True}, {"limits": {"search": 25}}, {"LODE_CACHE_TTL": "60", "LODE_SECURITY_ENFORCE": "false"}, "LODE_", ("security.enforce",))
    return spark.createDataFrame([(k, str(v), w) for k, (v, w) in sorted(merged.items())], "name string, value string, source string")
