"""Queries that put operators together: scans, searches, checks, upkeep of the index, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks import graph_queries, retrieval_queries, store_queries, text_queries
from lodeworks.functions import text as T
from lodeworks.inventory_queries import COHERENCE
from lodeworks.operators import operations as O
from lodeworks.operators import store as S
from lodeworks.plans.lineage import cut, scratch
from lodeworks.sources import files, settings
from lodeworks.store_queries import AUDITS, SCANS, _VEC, _audits, _vectors
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


@query(f"""SELECT v.id, s.id IS NOT NULL AS has_secret, g.verdict = 'ok' AS allowed FROM (SELECT DISTINCT id, file_path FROM versions) v LEFT JOIN (SELECT DISTINCT id FROM ({text_queries.ORACLES['secret_lines']})) s ON s.id = v.id
JOIN ({store_queries.ORACLES['path_guard']}) g ON g.file_path = v.file_path""")
def security_scan(spark, sf_dir):
    """Every version with whether its content holds a secret and whether its path is allowed."""
    v = load(spark, sf_dir, "versions").select("id", "file_path").distinct()
    secret = text_queries.secret_lines(spark, sf_dir).select(F.col("id").alias("_s")).distinct()
    guard = store_queries.path_guard(spark, sf_dir).select(F.col("file_path").alias("_f"), "verdict")
    out = v.join(secret, F.col("id") == F.col("_s"), "left").join(guard, F.col("file_path") == F.col("_f"))
    return out.select("id", F.col("_s").isNotNull().alias("has_secret"), (F.col("verdict") == "ok").alias("allowed"))


@query(retrieval_queries._LEX + ", r AS (SELECT q, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc_id) AS place FROM lex WHERE round(score, 6) >= 0.3) SELECT q, doc_id, score FROM r WHERE place <= 10")
def semantic_search(spark, sf_dir):
    """The ten best of each query that reach the threshold."""
    from lodeworks.operators import retrieval as R

    s = retrieval_queries._lexical(spark, sf_dir).withColumn("score", F.round("score", 6)).filter("score >= 0.3")
    return R.rank(s, "score", "doc_id", "place", ["q"], 10).select("q", "doc_id", "score")


_MESSAGE = f"CASE WHEN score > 0.8 THEN '{COHERENCE[0]}' WHEN score > 0.5 THEN '{COHERENCE[1]}' ELSE '{COHERENCE[2]}' END"


@query(f"""SELECT c.node, c.score, i.level AS risk, {_MESSAGE} AS message, false AS circular FROM ({graph_queries.ORACLES['coupling_scores']}) c JOIN ({graph_queries.ORACLES['change_impact']}) i ON i.start = c.node""")
def coherence_check(spark, sf_dir):
    """Per node its score, the risk of a change and what the score says."""
    c = graph_queries.coupling_scores(spark, sf_dir)
    i = graph_queries.change_impact(spark, sf_dir).select(F.col("start").alias("_n"), F.col("level").alias("risk"))
    message = T.first_label([(F.col("score") > 0.8, COHERENCE[0]), (F.col("score") > 0.5, COHERENCE[1])], COHERENCE[2])
    return c.join(i, F.col("node") == F.col("_n")).select("node", "score", "risk", message.alias("message"), F.lit(False).alias("circular"))


@query(f"""WITH {_VEC}, f AS (SELECT path, max(content) AS content FROM file_contents WHERE path IS NOT NULL GROUP BY path), b AS (SELECT path, substring(content, 1, 500) AS snippet FROM f WHERE path LIKE '%.ts')
SELECT coalesce(b.path, v.path) AS path, length(coalesce(b.snippet, v.snippet)) AS length, b.path IS NOT NULL AS again FROM vec v FULL JOIN b ON b.path = v.path WHERE coalesce(b.path, v.path) NOT LIKE '%.md'""")
def index_batch(spark, sf_dir):
    """The snippets after the typed scripts were indexed again as one batch and the Markdown files removed."""
    index = _vectors(spark, sf_dir).select("path", "snippet").withColumn("again", F.lit(False))
    f = load(spark, sf_dir, "file_contents").filter("path IS NOT NULL").groupBy("path").agg(F.max("content").alias("content"))
    batch = f.filter("path LIKE '%.ts'").select("path", F.substring("content", 1, 500).alias("snippet"), F.lit(True).alias("again"))
    both = S.upsert(index, batch, "path", coalesced=["snippet"])
    return both.filter("path NOT LIKE '%.md'").select("path", F.length("snippet").cast("long").alias("length"), "again")


@query("""WITH t AS (SELECT lower(term) AS term, max(doc_freq) AS doc_freq FROM handling_term_frequencies WHERE term IS NOT NULL GROUP BY 1), r AS (SELECT path, any_value(terms_json) AS j FROM handling_vectors WHERE path IS NOT NULL GROUP BY path),
k AS (SELECT CASE WHEN path LIKE '%.md' THEN -1 WHEN path LIKE '%.json' THEN 1 END AS sign, unnest(json_keys(CAST(j AS JSON))) AS term FROM r WHERE json_valid(j)), d AS (SELECT term, sum(sign) AS delta FROM k WHERE sign IS NOT NULL GROUP BY term)
SELECT coalesce(t.term, d.term) AS term, CAST(coalesce(doc_freq, 0) + coalesce(delta, 0) AS BIGINT) AS doc_freq FROM t FULL JOIN d ON d.term = t.term WHERE coalesce(doc_freq, 0) + coalesce(delta, 0) > 0""")
def term_frequency_upkeep(spark, sf_dir):
    """The stored counters after the JSON files were added and the Markdown files removed; terms at zero or below leave."""
    t = load(spark, sf_dir, "handling_term_frequencies").filter("term IS NOT NULL").groupBy(F.lower("term").alias("term")).agg(F.max("doc_freq").alias("doc_freq"))
    r = load(spark, sf_dir, "handling_vectors").filter("path IS NOT NULL").groupBy("path").agg(F.min("terms_json").alias("j"))
    sign = F.when(F.col("path").endswith(".md"), -1).when(F.col("path").endswith(".json"), 1)
    terms = r.filter(sign.isNotNull() & F.json_object_keys("j").isNotNull()).select(sign.alias("sign"), F.explode(F.json_object_keys("j")).alias("term"))
    return S.adjusted(t, terms.groupBy("term").agg(F.sum("sign").alias("delta")), "term", "doc_freq")


@query(f"""WITH {AUDITS}, r AS (SELECT action, value, result, row_number() OVER (PARTITION BY action ORDER BY ts DESC, id DESC) AS rn FROM audits), s AS (SELECT action, count(*) AS calls, count(*) FILTER (result = 'failure') AS errors, avg(value) FILTER (rn <= 1000) AS mean, sum(value) FILTER (rn <= 1000) AS total, count(value) FILTER (rn <= 1000) AS samples FROM r GROUP BY action)
SELECT action, calls, errors, floor(coalesce(mean, 0) * 100 + 0.5) / 100 AS mean FROM s UNION ALL SELECT '<all>', CAST(sum(calls) AS BIGINT), CAST(sum(errors) AS BIGINT), floor(coalesce(sum(total) / sum(samples), 0) * 100 + 0.5) / 100 FROM s""")
def call_snapshot(spark, sf_dir):
    """Calls, errors and mean of the newest thousand per action, and over all, weighted by samples."""
    return O.call_snapshot(_audits(spark, sf_dir), "action", "value", "result", "failure", "ts", "id")


@query(f"""WITH {SCANS}, k AS (SELECT regexp_replace(path, '^/srv/ws/care-hub/', '') AS rest, size FROM scans WHERE starts_with(path, '/srv/ws/care-hub/')), c AS (SELECT string_split(rest, '/')[1] AS name, CASE WHEN contains(rest, '/') THEN 'directory' ELSE 'file' END AS kind, CAST(sum(size) AS BIGINT) AS size FROM k GROUP BY 1, 2)
SELECT name, kind, size, row_number() OVER (ORDER BY kind, name) AS place FROM c WHERE NOT starts_with(name, '.')""")
def folder_listing(spark, sf_dir):
    """What lies right in a folder, directories first, without hidden names."""
    scans = S.latest_scan(load(spark, sf_dir, "files"))
    return files.children(scans.select("path", "size", "modified"), "/srv/ws/care-hub").select("name", "kind", "size", "place")


@query(r"SELECT path FROM file_contents WHERE NOT regexp_matches(path, '/(node_modules|\.git|dist|coverage|__pycache__|\.next|build|target|vendor|\.cache)/') AND NOT regexp_matches(path, '\.min\.[a-z]+$|\.map$')")
def corpus_collected(spark, sf_dir):
    """The sources that an index takes up."""
    return load(spark, sf_dir, "file_contents").filter(files.kept(F.col("path"))).select("path")


@query("SELECT term, doc_freq FROM handling_term_frequencies")
def legacy_import(spark, sf_dir):
    """Counters imported from JSON into an empty table; a second import of other rows changes nothing."""
    rows = load(spark, sf_dir, "handling_term_frequencies")
    source, target = scratch(spark, "legacy"), scratch(spark, "table")
    rows.write.json(source)
    read = spark.read.schema("term string, doc_freq long").json(source)
    files.import_once(spark, read, target)
    files.import_once(spark, read.filter("doc_freq > 10"), target)
    return spark.read.parquet(target)


@query("SELECT * FROM (VALUES ('**', 'admin', 'read,write,delete,admin'), ('**', 'user', 'read,write')) t(pattern, role, permissions)")
def policies_default(spark, sf_dir):
    """The policies of a file that is not there: the defaults."""
    rules = settings.policies(spark, f"{sf_dir}/policies.json", [("**", "admin", ["read", "write", "delete", "admin"]), ("**", "user", ["read", "write"])])
    return rules.select("pattern", "role", F.array_join("permissions", ",").alias("permissions"))


@query()
def cache_replay(spark, sf_dir):
    """Accesses replayed against one cache a user: an hour to live, three entries, the least recently used goes first."""
    return O.cache_replay(load(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", 3600, 3)


@query(f"WITH {_VEC} SELECT path, length(substring(snippet, 1, 500)) AS length FROM vec WHERE dense IS NULL AND snippet IS NOT NULL")
def backfill_candidates(spark, sf_dir):
    """The rows that a dense backfill takes up, with the length of what it embeds."""
    v = cut(_vectors(spark, sf_dir).select("path", "dense", "snippet"))
    return v.filter("dense IS NULL AND snippet IS NOT NULL").select("path", F.length(F.substring("snippet", 1, 500)).cast("long").alias("length"))
