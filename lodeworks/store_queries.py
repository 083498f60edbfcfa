"""Queries over files, versions, audits and vector rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.operators import store as S
from lodeworks.operators.history import numbered
from lodeworks.tables import load

QUERIES: dict = {}
ORACLES: dict = {}
NOW = "2024-01-31 00:00:00"
AUDITS = """audits AS (SELECT event_id AS id, ts, user_id, event_type AS action, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result,
  CASE WHEN event_type IN ('view', 'click') THEN 'fhir-store/patient/' || user_id ELSE 'system' END AS path, value FROM events)"""
SCANS = """scans AS (SELECT * FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY modified DESC NULLS LAST, size DESC NULLS LAST, created DESC NULLS LAST) = 1)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.audits(load(spark, sf_dir, "events"))


@query(f"WITH {AUDITS} SELECT id, ts, user_id, action, result FROM audits WHERE action = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 20")
def audit_filter_page(spark, sf_dir):
    a = S.matching(_audits(spark, sf_dir), {"action": "error", "user_id": None}, "ts", "2024-01-05", "2024-01-20")
    return S.page(a, S.newest(a, "ts", "id"), 50, 20).select("id", "ts", "user_id", "action", "result")


@query(f"WITH {AUDITS}, r AS (SELECT * FROM audits ORDER BY ts DESC, id DESC LIMIT 500) SELECT id, ts, user_id, action FROM r WHERE contains(path, 'patient') AND action = 'view' ORDER BY ts DESC, id DESC LIMIT 100")
def access_log_limit_then_filter(spark, sf_dir):
    return S.access_log(_audits(spark, sf_dir), "patient", 100, "view").select("id", "ts", "user_id", "action")


@query(f"""WITH {AUDITS}, r AS (SELECT * FROM audits ORDER BY ts DESC, id DESC LIMIT 10000), p AS (SELECT * FROM r WHERE starts_with(action, 'fhir') OR contains(path, 'patient'))
SELECT (SELECT count(*) FROM r) AS total, count(*) AS protected, count(DISTINCT user_id) AS users FROM p""")
def access_report_totals(spark, sf_dir):
    a = _audits(spark, sf_dir)
    recent = S.page(a, S.newest(a, "ts", "id"), 10_000)
    hit = F.col("action").startswith("fhir") | F.contains(F.col("path"), F.lit("patient"))
    return recent.agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("protected"), F.count_distinct(F.when(hit, F.col("user_id"))).alias("users"))


@query(f"""WITH {AUDITS}, r AS (SELECT * FROM audits ORDER BY ts DESC, id DESC LIMIT 10000) SELECT user_id, count(*) AS accesses FROM r
WHERE starts_with(action, 'fhir') OR contains(path, 'patient') GROUP BY user_id HAVING count(*) > 30""")
def access_report_suspicious(spark, sf_dir):
    return S.suspicious(_audits(spark, sf_dir), 30)


@query(f"WITH {AUDITS} SELECT action, count(*) AS kept, min(ts) AS first_ts FROM audits WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS GROUP BY action")
def audit_retention(spark, sf_dir):
    return S.retain(_audits(spark, sf_dir), "ts", NOW, 7).groupBy("action").agg(F.count(F.lit(1)).alias("kept"), F.min("ts").alias("first_ts"))


@query(f"""WITH {AUDITS}, n AS (SELECT count(*) AS c FROM audits), o AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS r FROM audits)
SELECT count(*) AS kept, min(ts) AS first_ts FROM o, n WHERE c <= 8000 OR r <= 4000""")
def audit_half_cut(spark, sf_dir):
    a = _audits(spark, sf_dir)
    return S.half_cut(a, S.newest(a, "ts", "id"), 8000).agg(F.count(F.lit(1)).alias("kept"), F.min("ts").alias("first_ts"))


@query(f"""WITH {AUDITS}, r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY ts DESC, id DESC) AS rn, count(*) OVER (PARTITION BY action) AS calls FROM audits),
s AS (SELECT action, any_value(calls) AS calls, count(value) AS samples, avg(value) AS mean, list_sort(list(value)) AS v FROM r WHERE rn <= 1000 GROUP BY action)
SELECT action, calls, samples, round(mean, 6) AS mean, round(v[least(samples, CAST(floor(samples * 0.5) AS BIGINT) + 1)], 6) AS p50,
round(v[least(samples, CAST(floor(samples * 0.95) AS BIGINT) + 1)], 6) AS p95, round(v[least(samples, CAST(floor(samples * 0.99) AS BIGINT) + 1)], 6) AS p99 FROM s""")
def call_percentiles(spark, sf_dir):
    return S.percentiles(_audits(spark, sf_dir), "action", "value", "ts", "id")


@query(f"WITH {AUDITS} SELECT action, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS largest, min(value) AS least FROM audits GROUP BY action")
def metric_stats(spark, sf_dir):
    return _audits(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("largest"), F.min("value").alias("least"))


@query("SELECT count(DISTINCT path) AS files, (SELECT count(*) FROM versions) AS versions, (SELECT count(*) FROM events) AS audits FROM files")
def store_stats(spark, sf_dir):
    f = load(spark, sf_dir, "files").agg(F.count_distinct("path").alias("files")).withColumn("k", F.lit(1))
    v = load(spark, sf_dir, "versions").agg(F.count(F.lit(1)).alias("versions")).withColumn("k", F.lit(1))
    e = load(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("audits")).withColumn("k", F.lit(1))
    return f.join(v, "k").join(e, "k").drop("k")


@query("SELECT DISTINCT file_path FROM versions")
def distinct_version_paths(spark, sf_dir):
    return load(spark, sf_dir, "versions").select("file_path").distinct()


@query("SELECT path FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL) ORDER BY path")
def all_paths(spark, sf_dir):
    return load(spark, sf_dir, "files").select("path").filter("path IS NOT NULL").distinct().orderBy("path")


@query(f"WITH {SCANS} SELECT path, size, modified, created, mode, language, complexity, len(imports) AS imports FROM scans")
def latest_scans(spark, sf_dir):
    return S.latest_scan(load(spark, sf_dir, "files")).select("path", "size", "modified", "created", "mode", "language", "complexity", F.when(F.col("imports").isNotNull(), F.size("imports")).cast("long").alias("imports"))


@query(f"WITH {SCANS} SELECT s.path, s.size, s.language FROM scans s JOIN (SELECT min(path) AS p FROM files) ON path = p")
def file_lookup(spark, sf_dir):
    files = load(spark, sf_dir, "files")
    wanted = files.agg(F.min("path").alias("p"))
    return S.latest_scan(files).join(F.broadcast(wanted), F.col("path") == F.col("p")).select("path", "size", "language")


@query(f"""WITH {SCANS}, b AS (SELECT path, size + 1 AS size, TIMESTAMP '2030-01-01' AS created FROM scans WHERE complexity >= 8 UNION ALL SELECT path || '.new', 1, TIMESTAMP '2030-01-01' FROM scans WHERE complexity = 3)
SELECT coalesce(b.path, o.path) AS path, CASE WHEN b.path IS NOT NULL THEN b.size ELSE o.size END AS size, CASE WHEN o.path IS NOT NULL THEN o.created ELSE b.created END AS created FROM scans o FULL JOIN b ON o.path = b.path""")
def file_upsert(spark, sf_dir):
    """A batch of new scans: sizes change, ``created`` of known files does not."""
    old = S.latest_scan(load(spark, sf_dir, "files")).select("path", "size", "created", "complexity")
    stamp = F.expr("TIMESTAMP_NTZ '2030-01-01'").alias("created")
    batch = old.filter("complexity >= 8").select("path", (F.col("size") + 1).alias("size"), stamp).unionByName(old.filter("complexity = 3").select(F.concat("path", F.lit(".new")).alias("path"), F.lit(1).cast("long").alias("size"), stamp))
    return S.upsert(old.select("path", "size", "created"), batch, "path", keep=["created"])


@query(f"""WITH {SCANS}, g AS (SELECT path FROM scans WHERE language = 'yaml') SELECT 'files' AS kind, count(*) AS n FROM scans WHERE path NOT IN (SELECT path FROM g)
UNION ALL SELECT 'versions', count(*) FROM versions WHERE file_path NOT IN (SELECT path FROM g)""")
def file_delete_cascade(spark, sf_dir):
    scans = S.latest_scan(load(spark, sf_dir, "files"))
    gone = scans.filter("language = 'yaml'").select("path")
    files = S.without(scans, gone, "path", "path").agg(F.count(F.lit(1)).alias("n")).select(F.lit("files").alias("kind"), "n")
    versions = S.without(load(spark, sf_dir, "versions"), gone, "file_path", "path").agg(F.count(F.lit(1)).alias("n")).select(F.lit("versions").alias("kind"), "n")
    return files.unionByName(versions)


_ROWS = "rows AS (SELECT DISTINCT id, seq, file_path, timestamp, author, message, hash, size, content FROM versions)"


@query(f"WITH {_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY timestamp DESC, seq DESC, id DESC) AS position FROM rows) SELECT id, file_path, position, position = 1 AND content IS NOT NULL AS has_content FROM r WHERE position <= 10")
def version_keep_newest(spark, sf_dir):
    return S.keep_newest(load(spark, sf_dir, "versions").distinct(), 10).select("id", "file_path", F.col("position").cast("long").alias("position"), F.col("content").isNotNull().alias("has_content"))


@query(f"WITH {_ROWS} SELECT id, file_path, timestamp, author, message FROM rows WHERE file_path = (SELECT max(file_path) FROM versions) ORDER BY timestamp DESC, seq DESC LIMIT 20")
def version_history_page(spark, sf_dir):
    v = load(spark, sf_dir, "versions")
    one = v.agg(F.max("file_path").alias("p"))
    rows = v.join(F.broadcast(one), F.col("file_path") == F.col("p")).distinct()
    return S.page(rows, [F.desc("timestamp"), F.desc("seq")], 20).select("id", "file_path", "timestamp", "author", "message")


@query(f"WITH {_ROWS} SELECT id, 'v' || row_number() OVER (PARTITION BY file_path ORDER BY timestamp, seq, id) AS label FROM rows")
def version_labels(spark, sf_dir):
    rows = load(spark, sf_dir, "versions").select("id", "seq", "file_path", "timestamp").distinct()
    return numbered(rows, ["file_path"], "timestamp", ["seq", "id"]).select("id", F.concat(F.lit("v"), F.col("n").cast("string")).alias("label"))


@query(f"""WITH {_ROWS}, t AS (SELECT id, file_path, content, hash, row_number() OVER (PARTITION BY file_path ORDER BY timestamp DESC, seq DESC, id DESC) AS p FROM rows)
SELECT a.file_path, a.id AS target, CASE WHEN a.content IS NULL THEN 'no content' WHEN lower(a.hash) = lower(b.hash) THEN 'same' ELSE 'restore' END AS outcome FROM t a JOIN t b ON a.file_path = b.file_path AND b.p = 1 WHERE a.p = 2""")
def rollback_plan(spark, sf_dir):
    """What restoring the version before the newest would do to each file."""
    w = Window.partitionBy("file_path").orderBy(F.desc("timestamp"), F.desc("seq"), F.desc("id"))
    two = load(spark, sf_dir, "versions").distinct().withColumn("p", F.row_number().over(w)).filter("p <= 2")
    v = two.select("id", "file_path", "content", "hash", "p", F.lag("hash").over(w).alias("newer"))
    outcome = F.when(F.col("content").isNull(), "no content").when(F.lower("hash") == F.lower("newer"), "same").otherwise("restore")
    return v.filter("p = 2").select("file_path", F.col("id").alias("target"), outcome.alias("outcome"))


@query(f"WITH {_ROWS} SELECT id, sha256(content) = lower(hash) AS agrees FROM rows WHERE content IS NOT NULL AND hash <> ''")
def content_hash_check(spark, sf_dir):
    v = load(spark, sf_dir, "versions").filter("content IS NOT NULL AND hash <> ''").select("id", "hash", "content").distinct()
    return v.select("id", (F.sha2("content", 256) == F.lower("hash")).alias("agrees"))


_VEC = "vec AS (SELECT path, any_value(qwen3_vector) AS dense, any_value(qwen3_version) AS version, any_value(content_snippet) AS snippet, max(indexed_at) AS indexed_at FROM handling_vectors GROUP BY path)"


def _vectors(spark, sf_dir):
    v = load(spark, sf_dir, "handling_vectors")
    return v.groupBy("path").agg(F.max(F.struct("indexed_at", "qwen3_version", "content_snippet", "qwen3_vector")).alias("r")).select("path", F.col("r.qwen3_vector").alias("dense"), F.col("r.qwen3_version").alias("version"), F.col("r.content_snippet").alias("snippet"), "r.indexed_at")


@query(f"WITH {_VEC} SELECT path, indexed_at FROM vec WHERE dense IS NULL ORDER BY indexed_at, path")
def dense_missing(spark, sf_dir):
    return _vectors(spark, sf_dir).filter("dense IS NULL").select("path", "indexed_at").orderBy("indexed_at", "path")


@query(f"WITH {_VEC} SELECT path, version FROM vec WHERE version <> 'qwen3-emb-r2'")
def dense_stale(spark, sf_dir):
    return _vectors(spark, sf_dir).filter("version <> 'qwen3-emb-r2'").select("path", "version")


@query(f"WITH {_VEC} SELECT coalesce(version, '<unversioned>') AS version, count(*) AS rows_n, CAST(sum(CASE WHEN dense IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS with_dense FROM vec GROUP BY 1")
def dense_versions(spark, sf_dir):
    return _vectors(spark, sf_dir).groupBy(F.coalesce("version", F.lit("<unversioned>")).alias("version")).agg(F.count(F.lit(1)).alias("rows_n"), F.count_if(F.col("dense").isNotNull()).alias("with_dense"))


@query(f"WITH {_VEC} SELECT path, dense IS NOT NULL AND len(dense) <> 64 AS dropped FROM vec")
def dense_length_sweep(spark, sf_dir):
    return _vectors(spark, sf_dir).select("path", (F.col("dense").isNotNull() & (F.size("dense") != 64)).alias("dropped"))


@query(f"""WITH {_VEC}, b AS (SELECT path, CASE WHEN length(path) % 2 = 0 THEN 'r3' END AS version, 'again' AS snippet FROM vec WHERE length(path) % 3 = 0)
SELECT v.path, coalesce(b.version, v.version) AS version, coalesce(b.snippet, v.snippet) AS snippet FROM vec v LEFT JOIN b ON v.path = b.path""")
def vector_upsert_keeps_dense(spark, sf_dir):
    """Re-indexing without a new dense vector keeps the old one and its version."""
    old = _vectors(spark, sf_dir).select("path", "version", "snippet")
    batch = old.filter(F.length("path") % 3 == 0).select("path", F.when(F.length("path") % 2 == 0, "r3").alias("version"), F.lit("again").alias("snippet"))
    return S.upsert(old, batch, "path", coalesced=["version"])


@query("""WITH d AS (SELECT doc_id, n_chars FROM documents WHERE n_chars <= 2000 ORDER BY doc_id LIMIT 500), r AS (SELECT *, sum(n_chars) OVER (ORDER BY doc_id) AS run FROM d) SELECT doc_id, n_chars FROM r WHERE run <= 100000""")
def index_until_full(spark, sf_dir):
    return S.capped(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", [F.col("doc_id")], 100_000, 2_000, 500)


@query(r"""WITH l AS (SELECT path, string_split_regex(content, '\r?\n') AS a, octet_length(encode(content)) AS b FROM file_contents WHERE content IS NOT NULL)
SELECT path, i + 9 AS line_no, a[i + 9] AS line, len(a) AS total_lines, b AS total_bytes, len(a) > 14 AS truncated FROM l, (SELECT unnest(range(1, 6)) AS i) WHERE i + 9 <= len(a)""")
def read_lines_10_to_14(spark, sf_dir):
    return S.read_page(load(spark, sf_dir, "file_contents"), "path", "content", 10, 5)


@query(r"SELECT path FROM file_contents WHERE regexp_matches(path, '(?i)^.*/split.*\.t.$')")
def search_files(spark, sf_dir):
    return load(spark, sf_dir, "file_contents").select("path").filter(F.col("path").rlike(S.name_glob("split*.t?")))


@query(r"""SELECT path, CASE WHEN regexp_matches(path, '^(?:[A-Za-z]:)?/srv/ws/[^/]*/vendor/.*$') THEN 'vendored' WHEN regexp_matches(path, '^(?:[A-Za-z]:)?/srv/ws/care-hub/.*$') THEN 'owner' WHEN regexp_matches(path, '^(?:[A-Za-z]:)?.*\.ts$') THEN 'web' END AS policy FROM file_contents""")
def policy_match(spark, sf_dir):
    return S.first_policy(load(spark, sf_dir, "file_contents").select("path"), [("/srv/ws/*/vendor/**", "vendored"), ("/srv/ws/care-hub/**", "owner"), ("**.ts", "web")])


_RULES = "(VALUES ('owner', 'user', 'read,write'), ('owner', 'guest', 'read'), ('owner', 'admin', 'read,write,delete,admin'), ('web', 'user', 'read')) r(policy, role, permissions)"


@query(f"""SELECT a.action, r.policy, r.role, r.role = 'admin' OR list_contains(string_split(r.permissions, ','), 'admin') OR list_contains(string_split(r.permissions, ','), CASE WHEN a.action IN ('view', 'click') THEN 'read' ELSE 'write' END) AS allowed, count(*) AS n
FROM (SELECT event_type AS action, CASE WHEN user_id % 2 = 0 THEN 'owner' ELSE 'web' END AS policy FROM events) a JOIN {_RULES} ON a.policy = r.policy GROUP BY ALL""")
def permission_decisions(spark, sf_dir):
    """Decisions per policy, role and action: the role holds the action, or is an administrator."""
    rules = spark.createDataFrame([("owner", "user", "read,write"), ("owner", "guest", "read"), ("owner", "admin", "read,write,delete,admin"), ("web", "user", "read")], "policy string, role string, permissions string")
    a = load(spark, sf_dir, "events").select(F.col("event_type").alias("action"), F.when(F.col("user_id") % 2 == 0, "owner").otherwise("web").alias("policy")).groupBy("action", "policy").agg(F.count(F.lit(1)).alias("n"))
    may = F.split("permissions", ",")
    need = F.when(F.col("action").isin("view", "click"), "read").otherwise("write")
    return a.join(F.broadcast(rules), "policy").select("action", "policy", "role", ((F.col("role") == "admin") | F.array_contains(may, "admin") | F.array_contains(may, need)).alias("allowed"), "n")


@query(r"""WITH p AS (SELECT DISTINCT file_path FROM versions), n AS (SELECT file_path, lower(replace(file_path, '\', '/')) AS q FROM p)
SELECT file_path, CASE WHEN file_path = '' THEN 'empty' WHEN regexp_matches(q, '(^|/)\.\.(/|$)') THEN 'climbs' WHEN q = '/srv/ws/ward-board' OR starts_with(q, '/srv/ws/ward-board/') THEN 'denied'
WHEN NOT (q = '/srv/ws' OR starts_with(q, '/srv/ws/')) THEN 'outside' ELSE 'ok' END AS verdict FROM n""")
def path_guard(spark, sf_dir):
    p = load(spark, sf_dir, "versions").select("file_path").distinct()
    return p.withColumn("verdict", S.guard(F.col("file_path"), ["/srv/ws"], ["/srv/ws/ward-board"]))


@query(f"""SELECT user_id, sha256(CAST(user_id AS VARCHAR)) AS hash, CASE WHEN max(ts) FILTER (event_type = 'error') IS NOT NULL AND user_id % 5 = 0 THEN 'revoked' WHEN max(ts) + INTERVAL 1 DAY <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'valid' END AS state FROM events GROUP BY user_id""")
def token_validity(spark, sf_dir):
    """Tokens issued per user, expiring a day after the user's last event, revoked for every fifth user with an error."""
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("err"))
    t = e.select("user_id", F.sha2(F.col("user_id").cast("string"), 256).alias("hash"), (F.col("last") + F.expr("INTERVAL 1 DAY")).alias("expires_at"), F.when(F.col("user_id") % 5 == 0, F.col("err")).alias("revoked_at"))
    return S.token_state(t, NOW).select("user_id", "hash", "state")


@query(r"""WITH u AS (SELECT DISTINCT id, unnest(regexp_extract_all(content, '[a-z+]+://[^\s"''`<>]+')) AS url FROM versions WHERE content IS NOT NULL), h AS (SELECT regexp_extract(url, '^[a-z+]+://(?:[^/@\s]*@)?([^/:?#\s]+)', 1) AS host FROM u)
SELECT host, host IN ('ward.carehub.invalid', 'localhost') AS allowed, count(*) AS n FROM h WHERE host <> '' GROUP BY host""")
def url_hosts(spark, sf_dir):
    """Hosts of addresses in file contents, and whether an allow-list has them."""
    v = load(spark, sf_dir, "versions").filter("content IS NOT NULL").select("id", F.explode(F.expr(r"""regexp_extract_all(content, '[a-z+]+://[^\\s"\'`<>]+', 0)""")).alias("url")).distinct()
    h = v.select(F.regexp_extract("url", r"^[a-z+]+://(?:[^/@\s]*@)?([^/:?#\s]+)", 1).alias("host")).filter("host <> ''")
    return h.groupBy("host").agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", F.col("host").isin("ward.carehub.invalid", "localhost"))


@query(f"WITH {AUDITS} SELECT id, ts, action, result FROM audits ORDER BY ts DESC, id DESC LIMIT 20")
def enforcement_tail(spark, sf_dir):
    a = _audits(spark, sf_dir)
    return S.page(a, S.newest(a, "ts", "id"), 20).select("id", "ts", "action", "result")
