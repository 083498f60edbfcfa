"""Further queries over the store, the code base and generated sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.operators import codeintel as C
from lodeworks.operators import extract
from lodeworks.operators import graph as G
from lodeworks.operators import store as S
from lodeworks.operators.history import clean_path
from lodeworks.sources import generated
from lodeworks.code_queries import UNITS
from lodeworks.graph_queries import EDGES, call_edges
from lodeworks.store_queries import _ROWS, _VEC, SCANS, _vectors
from lodeworks.tables import load, spread

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


@query(f"WITH {_ROWS}, w AS (SELECT file_path AS wanted, min(id) OVER () AS first_id, id FROM rows), q AS (SELECT wanted, id FROM w UNION SELECT wanted, first_id FROM w) SELECT q.id, q.wanted FROM q JOIN rows r ON r.id = q.id AND r.file_path = q.wanted")
def version_lookup(spark, sf_dir):
    """Versions asked for by file and id; an id that belongs to another file is refused."""
    v = load(spark, sf_dir, "versions").select("id", "file_path").distinct()
    first = v.agg(F.min("id").alias("id"))
    asked = v.select(F.col("file_path").alias("wanted"), "id").unionByName(v.select(F.col("file_path").alias("wanted")).distinct().join(F.broadcast(first)))
    owner = v.select(F.col("id").alias("_i"), F.col("file_path").alias("_f"))
    return asked.distinct().join(owner, (F.col("id") == F.col("_i")) & (F.col("wanted") == F.col("_f"))).select("id", "wanted")


@query(f"WITH {_ROWS}, {SCANS}, g AS (SELECT path FROM scans WHERE language = 'yaml'), l AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY timestamp DESC, seq DESC, id DESC) AS p FROM rows WHERE file_path IN (SELECT path FROM g)) SELECT file_path, id AS last_id, size, content IS NOT NULL AS restorable FROM l WHERE p = 1")
def tombstones(spark, sf_dir):
    """What is kept of deleted files: the last version of each."""
    gone = S.latest_scan(load(spark, sf_dir, "files")).filter("language = 'yaml'").select(F.col("path").alias("_g"))
    v = load(spark, sf_dir, "versions").distinct().join(gone, F.col("file_path") == F.col("_g"), "left_semi")
    return S.latest_per_key(v, ["file_path"], [F.desc("timestamp"), F.desc("seq"), F.desc("id")]).select("file_path", F.col("id").alias("last_id"), "size", F.col("content").isNotNull().alias("restorable"))


@query(f"WITH {_VEC} SELECT path, CASE WHEN version = 'qwen3-emb-r2' AND len(dense) = 64 THEN version END AS version, dense IS NOT NULL AND (version IS DISTINCT FROM 'qwen3-emb-r2' OR len(dense) <> 64) AS invalidated FROM vec")
def dense_invalidated(spark, sf_dir):
    """Dense vectors of another version or length are dropped and taken up again by the next run."""
    good = F.coalesce((F.col("version") == "qwen3-emb-r2") & (F.size("dense") == 64) & F.col("dense").isNotNull(), F.lit(False))
    return _vectors(spark, sf_dir).select("path", F.when(good, F.col("version")).alias("version"), (F.col("dense").isNotNull() & ~good).alias("invalidated"))


@query(f"WITH {_VEC} SELECT path FROM vec WHERE path NOT IN (SELECT path FROM files WHERE complexity > 6 AND path IS NOT NULL)")
def index_removed(spark, sf_dir):
    """The index after files of high complexity were taken out of it."""
    gone = load(spark, sf_dir, "files").filter("complexity > 6 AND path IS NOT NULL").select("path").distinct()
    return S.without(_vectors(spark, sf_dir), gone, "path", "path").select("path")


@query(r"""SELECT DISTINCT file_path FROM versions WHERE regexp_replace(regexp_replace(replace(file_path, '\', '/'), '/+', '/', 'g'), '^\.(/|$)', '\1') IN (SELECT path FROM file_contents)""")
def path_set_members(spark, sf_dir):
    """Spellings of paths that name a known file."""
    known = load(spark, sf_dir, "file_contents").select(F.col("path").alias("_k"))
    p = load(spark, sf_dir, "versions").select("file_path").distinct()
    return p.join(known, clean_path(F.col("file_path")) == F.col("_k"), "left_semi")


@query(f"WITH {UNITS} SELECT file_path, start_line, name FROM u WHERE list_contains(tags, 'data-retrieval')")
def units_by_tag(spark, sf_dir):
    return C.classified(load(spark, sf_dir, "extracted_units")).filter(F.array_contains("tags", "data-retrieval")).select("file_path", "start_line", "name")


@query("SELECT DISTINCT file_path, module_name FROM extracted_modules WHERE starts_with(file_path, '/srv/ws/triage-core/') AND len(exports) > 0")
def module_filter(spark, sf_dir):
    m = load(spark, sf_dir, "extracted_modules").filter(F.col("file_path").startswith("/srv/ws/triage-core/") & (F.size("exports") > 0))
    return m.select("file_path", "module_name").distinct()


@query(f"WITH {UNITS} SELECT file_path, start_line, CAST(floor(length('{{\"name\":\"' || name || '\",\"kind\":\"' || kind || '\"}}') / 4 + 0.5) AS BIGINT) AS tokens FROM u")
def token_estimates(spark, sf_dir):
    """A quarter of the length of a unit's JSON, rounded half up."""
    u = C.units(load(spark, sf_dir, "extracted_units"))
    return u.select("file_path", "start_line", F.floor(F.length(F.to_json(F.struct("name", "kind"))) / 4 + 0.5).alias("tokens"))


@query("SELECT event_type, count(*) FILTER (value >= 20) AS hits, count(*) FILTER (value < 20) AS misses, round(count(*) FILTER (value >= 20) / count(*), 6) AS hit_rate FROM events GROUP BY event_type")
def cache_stats(spark, sf_dir):
    hit = F.count_if(F.col("value") >= 20)
    return load(spark, sf_dir, "events").groupBy("event_type").agg(hit.alias("hits"), F.count_if(F.col("value") < 20).alias("misses"), F.round(hit / F.count(F.lit(1)), 6).alias("hit_rate"))


@query("""WITH r(policy, role, permissions) AS (VALUES ('a', 'user', 'write'), ('a', 'guest', 'delete'), ('b', 'user', 'read,write'), ('b', 'guest', 'write'), ('c', 'user', ''))
SELECT policy FROM r GROUP BY policy HAVING bool_and(NOT list_contains(string_split(permissions, ','), 'read'))""")
def unreadable_policies(spark, sf_dir):
    """Policies under which no role may read."""
    r = spark.createDataFrame([("a", "user", "write"), ("a", "guest", "delete"), ("b", "user", "read,write"), ("b", "guest", "write"), ("c", "user", "")], "policy string, role string, permissions string")
    return r.groupBy("policy").agg(F.bool_and(~F.array_contains(F.split("permissions", ","), "read")).alias("closed")).filter("closed").select("policy")


#: Messages by score above 0.8, above 0.5 and below. Fixed values.
COHERENCE = ("File has high coherence (well-isolated)", "File has moderate coupling", "File is highly coupled - consider refactoring")


@query(f"""WITH {EDGES}, n AS (SELECT count(DISTINCT src) AS n FROM edges), d AS (SELECT node, count(*) AS c FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node), s AS (SELECT node, CASE WHEN n <= 1 THEN 1.0 ELSE greatest(0.0, 1 - c / (n - 1)) END AS score FROM d, n)
SELECT CASE WHEN score > 0.8 THEN 'File has high coherence (well-isolated)' WHEN score > 0.5 THEN 'File has moderate coupling' ELSE 'File is highly coupled - consider refactoring' END AS message, count(*) AS nodes FROM s GROUP BY 1""")
def coherence_messages(spark, sf_dir):
    s = G.coupling(call_edges(spark, sf_dir))
    return s.groupBy(T.first_label([(F.col("score") > 0.8, COHERENCE[0]), (F.col("score") > 0.5, COHERENCE[1])], COHERENCE[2]).alias("message")).agg(F.count(F.lit(1)).alias("nodes"))


@query(f"""WITH {UNITS}, c AS (SELECT unnest(['query', 'command', 'handler', 'utility', 'validation']) AS category) SELECT file_path, start_line, category, round(least(1.0, 0.8 + CASE WHEN class = category THEN 0.15 ELSE 0 END + CASE WHEN len(list_filter(tags, lambda t: contains(t, category))) > 0 THEN 0.05 ELSE 0 END), 2)::DOUBLE AS confidence FROM u JOIN c ON class = category""")
def instance_confidence(spark, sf_dir):
    """How sure a unit is to be an instance of its class."""
    u = C.classified(load(spark, sf_dir, "extracted_units")).filter(F.col("class").isin("query", "command", "handler", "utility", "validation"))
    tag = F.exists("tags", lambda t: F.contains(t, F.col("class")))
    return u.select("file_path", "start_line", F.col("class").alias("category"), F.round(F.least(F.lit(1.0), F.lit(0.95) + F.when(tag, 0.05).otherwise(0.0)), 2).alias("confidence"))


@query(f"WITH {UNITS} SELECT t AS type, count(*) AS consumers FROM (SELECT unnest(type_dependencies) AS t FROM u) GROUP BY t")
def type_consumers(spark, sf_dir):
    return C.units(load(spark, sf_dir, "extracted_units")).select(F.explode("type_dependencies").alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("consumers"))


@query(r"""WITH f AS (SELECT DISTINCT path AS src, unnest(imports) AS dst FROM files WHERE path IS NOT NULL), m AS (SELECT DISTINCT file_path AS src, i.from_module AS dst FROM (SELECT file_path, unnest(imports) AS i FROM extracted_modules WHERE file_path IS NOT NULL)) SELECT src, dst FROM f UNION SELECT src, dst FROM m""")
def dependencies_with_index(spark, sf_dir):
    """Imports that scans registered, together with those of the module index."""
    f = load(spark, sf_dir, "files").filter("path IS NOT NULL").select(F.col("path").alias("src"), F.explode("imports").alias("dst"))
    m = load(spark, sf_dir, "extracted_modules").filter("file_path IS NOT NULL").select(F.col("file_path").alias("src"), F.explode("imports").alias("i")).select("src", F.col("i.from_module").alias("dst"))
    return G.with_index(f, m)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || substring(strftime(ts, '%f'), 1, 3) || 'Z' AS iso FROM events")
def iso_timestamps(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"))


@query(f"WITH {SCANS} SELECT path, to_json(coalesce(imports, []))::VARCHAR AS imports_json, len(coalesce(imports, [])) AS n FROM scans")
def arrays_as_json(spark, sf_dir):
    """Arrays to JSON text and back, with the length of what came back."""
    s = S.latest_scan(load(spark, sf_dir, "files")).select("path", F.to_json(F.coalesce("imports", F.array().cast("array<string>"))).alias("imports_json"))
    return s.withColumn("n", F.size(F.from_json("imports_json", "array<string>")).cast("long"))


@query("""WITH p AS (SELECT path, string_split(regexp_replace(path, '^/', ''), '/') AS a FROM file_contents), n AS (SELECT a, unnest(range(1, least(len(a), 5) + 1)) AS level FROM p)
SELECT array_to_string(a[1:level], '/') AS node, array_to_string(a[1:level - 1], '/') AS parent, CAST(level AS INTEGER) AS level, CASE WHEN level = len(a) THEN 'file' ELSE 'directory' END AS kind, count(*) AS files FROM n GROUP BY ALL""")
def directory_tree(spark, sf_dir):
    return extract.tree(load(spark, sf_dir, "file_contents").select("path"), 5).withColumn("level", F.col("level").cast("int"))


@query(r"""SELECT regexp_extract(path, '^/srv/ws/([^/]+)', 1) AS repo, coalesce(lower(regexp_extract(path, '\.([^./\\]+)$', 1)), '') AS extension, count(*) AS files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines FROM file_contents WHERE content IS NOT NULL GROUP BY 1, 2""")
def repository_skeleton(spark, sf_dir):
    """Files and lines per repository and extension."""
    c = load(spark, sf_dir, "file_contents").filter("content IS NOT NULL")
    return c.groupBy(F.regexp_extract("path", "^/srv/ws/([^/]+)", 1).alias("repo"), T.extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.size(F.split("content", "\n"))).alias("lines"))


#: Shapes of a code base: path pattern and name. Fixed values.
SIGNATURES = ((r"/(packages|services)/", "monorepo"), (r"/tests?/", "tests"), (r"/node_modules/|package-lock\.json$", "node"), (r"\.py$", "python"), (r"\.go$", "go"), (r"/vendor/|/third_party/", "vendored dependencies"))


@query("WITH s(p, name) AS (VALUES " + ", ".join(f"('{p}', '{n}')" for p, n in SIGNATURES) + "), m AS (SELECT regexp_extract(path, '^/srv/ws/([^/]+)', 1) AS repo, name, count(*) AS files FROM file_contents, s WHERE regexp_matches(path, p) GROUP BY ALL) SELECT repo, name, files, round(least(0.95, 0.5 + 0.05 * files), 3)::DOUBLE AS confidence FROM m")
def stack_signatures(spark, sf_dir):
    """What each repository is made of, with a confidence that grows with the evidence."""
    names = T.tagged([(F.col("path").rlike(p), n) for p, n in SIGNATURES])
    m = load(spark, sf_dir, "file_contents").select(F.regexp_extract("path", "^/srv/ws/([^/]+)", 1).alias("repo"), F.explode(names).alias("name")).groupBy("repo", "name").agg(F.count(F.lit(1)).alias("files"))
    return m.withColumn("confidence", F.round(F.least(F.lit(0.95), 0.5 + F.col("files") * 0.05), 3))


@query()
def units_extracted(spark, sf_dir):
    """Functions taken from all texts by signature and braces; a test compares them with the unit table of the parser."""
    return extract.units(spread(load(spark, sf_dir, "file_contents"))).select("file_path", "name", "start_line", "end_line")


@query()
def units_measured(spark, sf_dir):
    """Complexity, calls and types of the functions of all scripts."""
    m = extract.measured(spread(load(spark, sf_dir, "file_contents")))
    return m.select("file_path", "name", "start_line", "complexity", F.array_join("calls", ",").alias("calls"), F.array_join("types", ",").alias("types"))


@query()
def synthetic_patients(spark, sf_dir):
    return generated.patients(spark, 100, 42)


@query()
def embedding_backfill(spark, sf_dir):
    """Snippets without a dense vector, embedded by a stand-in that counts letters."""
    missing = _vectors(spark, sf_dir).filter("dense IS NULL AND snippet IS NOT NULL")
    return generated.embedded(missing, "path", "snippet", lambda texts: [[float(t.count(chr(97 + i))) for i in range(26)] for t in texts], 26)


@query("SELECT CAST(k AS INTEGER) AS attempt, CAST(500 * power(2, k) AS BIGINT) AS wait_ms FROM (SELECT unnest(range(0, 5)) AS k)")
def backoff_schedule(spark, sf_dir):
    return spark.range(5).select(F.col("id").cast("int").alias("attempt"), (F.lit(500) * F.pow(F.lit(2), "id")).cast("long").alias("wait_ms"))


@query("SELECT event_id, CAST(floor(value * 1000 + 0.5) / 1000 AS DOUBLE) AS rounded FROM events")
def rounded_half_up(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", (F.floor(F.col("value") * 1000 + 0.5) / 1000).alias("rounded"))
