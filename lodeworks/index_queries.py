"""Queries over the module index taken from texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.code_queries import INSTANCES, UNITS, _modules, _units
from lodeworks.operators import codeintel as C
from lodeworks.operators import contracts as K
from lodeworks.operators import extract
from lodeworks.operators import index_store
from lodeworks.plans.lineage import cut, scratch
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


def _quoted(p: str) -> str:
    return p.replace("'", "''")


_FILES = r"f AS (SELECT path, content, lower(regexp_extract(path, '\.([^./\\]+)$', 1)) AS e FROM file_contents WHERE content IS NOT NULL)"
_HIT = lambda p, where: f"(SELECT path, unnest(regexp_extract_all(content, '{_quoted(p)}')) AS m FROM f WHERE {where})"
_G = lambda p, i: f"regexp_extract(m, '{_quoted(p)}', {i})"
_SCRIPT = "e IN ('ts', 'tsx', 'js', 'jsx')"
_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_AS = lambda x: _TRIM(f"regexp_replace(' ' || {_TRIM(x)}, '^[\\s\\S]*\\sas\\s+', '')")
IMPORTS = rf"""{_FILES}, imports AS (SELECT DISTINCT * FROM (
SELECT path, {_AS('n')} AS name, source, kind FROM (SELECT path, unnest(string_split({_G(K.NAMED, 1)}, ',')) AS n, {_G(K.NAMED, 2)} AS source, CASE WHEN contains(m, 'import type') THEN 'type' ELSE 'named' END AS kind FROM {_HIT(K.NAMED, _SCRIPT)})
UNION ALL SELECT path, {_G(K.DEFAULT, 1)}, {_G(K.DEFAULT, 2)}, 'default' FROM {_HIT(K.DEFAULT, _SCRIPT)} WHERE {_G(K.DEFAULT, 1)} <> 'type'
UNION ALL SELECT path, {_G(K.NAMESPACE, 1)}, {_G(K.NAMESPACE, 2)}, 'namespace' FROM {_HIT(K.NAMESPACE, _SCRIPT)}
UNION ALL SELECT path, {_AS('n')}, source, 'python' FROM (SELECT path, source, unnest(CASE WHEN listed <> '' THEN string_split(listed, ',') ELSE [source] END) AS n FROM (SELECT path, {_G(K.PYTHON, 1)} || {_G(K.PYTHON, 4)} AS source, {_G(K.PYTHON, 2)} || {_G(K.PYTHON, 3)} AS listed FROM {_HIT(K.PYTHON, "e = 'py'")}))
UNION ALL SELECT path, regexp_replace(source, '^.*\.', ''), source, 'java' FROM (SELECT path, {_TRIM(_G(K.JAVA, 1))} AS source FROM {_HIT(K.JAVA, "e = 'java'")})
UNION ALL SELECT path, regexp_replace(source, '^.*/', ''), source, 'go' FROM (SELECT path, replace({_TRIM('l')}, '"', '') AS source FROM (SELECT path, unnest(string_split({_G(K.GO, 1)} || {_G(K.GO, 2)}, chr(10))) AS l FROM {_HIT(K.GO, "e = 'go'")})) WHERE source <> '' AND NOT starts_with(source, '//')
) WHERE name <> '')"""
EXPORTS = "every AS (SELECT path, name, kind, bool_or(is_async) AS is_async, bool_or(is_default) AS is_default FROM (" + " UNION ALL ".join(f"SELECT path, {_G(p, 1)} AS name, '{k}' AS kind, contains(m, 'async') AS is_async, contains(m, 'default') AS is_default FROM {_HIT(p, _SCRIPT)}" for k, p in K.EXPORTS) + rf"""
UNION ALL SELECT path, {_G(K.PYTHON_EXPORT, 1)}, CASE WHEN starts_with(m, 'class') THEN 'class' ELSE 'function' END, false, false FROM {_HIT(K.PYTHON_EXPORT, "e = 'py'")} WHERE NOT starts_with({_G(K.PYTHON_EXPORT, 1)}, '_')
UNION ALL SELECT path, {_G(K.JAVA_EXPORT, 1)}, CASE WHEN contains(m, 'interface') THEN 'interface' WHEN contains(m, 'enum') THEN 'enum' ELSE 'class' END, false, false FROM {_HIT(K.JAVA_EXPORT, "e = 'java'")}) GROUP BY ALL),
exports AS (SELECT * FROM every WHERE kind <> 'constant' OR (path, name) NOT IN (SELECT (path, name) FROM every WHERE kind <> 'constant'))"""
_N = lambda x: f"CASE WHEN {x} <> '' THEN len(string_split({x}, ',')) ELSE 0 END"
_T = {k: p for k, p in K.TYPES}
_TYPED = "e IN ('ts', 'tsx')"
_LINES = f"list_filter(list_transform(string_split({_G(_T['interface'], 4)}, chr(10)), lambda x: regexp_replace({_TRIM('x')}, '[,;]$', '')), lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '/*'))"
TYPES = rf"""types AS (SELECT DISTINCT * FROM (SELECT path, {_G(_T['interface'], 1)} AS name, 'interface' AS kind, {_N(_G(_T['interface'], 3))} AS bases, {_N(_G(_T['interface'], 2))} AS generics,
len(list_filter({_LINES}, lambda x: NOT regexp_matches(x, '{K.METHOD}') AND regexp_matches(x, '{K.PROPERTY}'))) AS properties, len(list_filter({_LINES}, lambda x: regexp_matches(x, '{K.METHOD}'))) AS methods FROM {_HIT(_T['interface'], _TYPED)}
UNION ALL SELECT path, {_G(_T['type'], 1)}, 'type', 0, {_N(_G(_T['type'], 2))}, 0, 0 FROM {_HIT(_T['type'], _TYPED)}
UNION ALL SELECT path, {_G(_T['enum'], 1)}, 'enum', 0, 0, len(list_filter(string_split({_G(_T['enum'], 2)}, ','), lambda x: {_TRIM("regexp_replace(x, '=[\\s\\S]*$', '')")} <> '')), 0 FROM {_HIT(_T['enum'], _TYPED)}))"""


def _contents(spark, sf_dir):
    return load(spark, sf_dir, "file_contents").select("path", "content")


@query(f"WITH {IMPORTS} SELECT * FROM imports")
def index_imports(spark, sf_dir):
    """Every name that a file imports, with its source: scripts, Python, Java and Go."""
    return K.imports(_contents(spark, sf_dir))


@query(f"WITH {_FILES}, {EXPORTS} SELECT * FROM exports")
def index_exports(spark, sf_dir):
    """Every name that a file exports, by kind."""
    return K.exports(_contents(spark, sf_dir))


@query(f"WITH {_FILES}, {TYPES} SELECT path, name, kind, CAST(bases AS BIGINT) AS bases, CAST(generics AS BIGINT) AS generics, CAST(properties AS BIGINT) AS properties, CAST(methods AS BIGINT) AS methods FROM types")
def index_types(spark, sf_dir):
    """Interfaces, type aliases and enums with the sizes of their parts."""
    return K.types(_contents(spark, sf_dir)).select("path", "name", "kind", *[F.col(c).cast("long").alias(c) for c in ("bases", "generics", "properties", "methods")])


@query(f"""WITH {IMPORTS}, {EXPORTS}, {TYPES} SELECT p.path, coalesce(i.n, 0) AS imports_n, coalesce(x.n, 0) AS exports_n, coalesce(t.n, 0) AS types_n FROM (SELECT DISTINCT path FROM file_contents) p
LEFT JOIN (SELECT path, count(*) AS n FROM imports GROUP BY path) i ON i.path = p.path LEFT JOIN (SELECT path, count(*) AS n FROM exports GROUP BY path) x ON x.path = p.path LEFT JOIN (SELECT path, count(*) AS n FROM types GROUP BY path) t ON t.path = p.path""")
def module_contracts(spark, sf_dir):
    """How much each file takes, gives and defines."""
    return K.contracts(_contents(spark, sf_dir))


_NODES = r"nodes AS (SELECT DISTINCT regexp_extract(path, '^/srv/ws/([^/]+)', 1) AS repo, array_to_string(a[1:level], '/') || CASE WHEN level < len(a) THEN '/' ELSE '' END AS node FROM (SELECT path, a, unnest(range(1, least(len(a), 4) + 1)) AS level FROM (SELECT path, string_split(regexp_replace(path, '^/srv/ws/[^/]+/', ''), '/') AS a FROM file_contents WHERE path IS NOT NULL)))"
_ARCH = "arch AS (" + " UNION ALL ".join(f"SELECT {i} AS rule, '{n}' AS name, '{p}' AS p, {list(ev)} AS ev, {least} AS least" for i, (p, n, ev, least) in enumerate(K.ARCHITECTURES)) + ")"


@query(f"""WITH {_NODES}, {_ARCH}, m AS (SELECT repo, rule, count(*) FILTER (regexp_matches(node, p)) AS fits FROM nodes, arch GROUP BY ALL), v AS (SELECT repo, rule, count(DISTINCT x) AS evidence FROM (SELECT repo, node, rule, unnest(ev) AS x FROM nodes, arch) WHERE contains(node, x) GROUP BY ALL),
c AS (SELECT m.repo, arch.name, CAST(evidence AS BIGINT) AS evidence, round(least(0.95, 0.5 + 0.05 * fits + 0.1 * evidence), 2)::DOUBLE AS confidence, rule FROM m JOIN v USING (repo, rule) JOIN arch USING (rule) WHERE fits > 0 AND evidence >= least)
SELECT repo, name, evidence, confidence, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, rule) AS place FROM c""")
def architecture_patterns(spark, sf_dir):
    """The architectures each repository's tree shows, the surest first."""
    parts = F.split(F.regexp_replace("path", "^/srv/ws/[^/]+/", ""), "/")
    p = load(spark, sf_dir, "file_contents").filter("path IS NOT NULL").select(F.regexp_extract("path", "^/srv/ws/([^/]+)", 1).alias("repo"), parts.alias("a"))
    nodes = p.select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("a"), F.lit(4))), lambda n: F.concat(F.array_join(F.slice("a", F.lit(1), n), "/"), F.when(n < F.size("a"), "/").otherwise("")))).alias("node")).distinct()
    w = Window.partitionBy("repo").orderBy(F.desc("confidence"), "rule")  # ten rules at most
    return K.architectures(nodes).withColumn("place", F.row_number().over(w).cast("long")).select("repo", "name", F.col("evidence").cast("long").alias("evidence"), "confidence", "place")


@query()
def technology_stack(spark, sf_dir):
    """Technologies that manifests name, and the languages of the files, per repository."""
    from lodeworks.text_queries import INDEX_LANGUAGES
    from lodeworks.functions import text as T

    repo, file = F.regexp_extract("path", "^/srv/ws/([^/]+)", 1), F.regexp_extract("path", "([^/]+)$", 1)
    c = load(spark, sf_dir, "file_contents")
    found = K.technologies(c.select(repo.alias("repo"), file.alias("file"), "content"))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in INDEX_LANGUAGES.items() for x in kv]), T.extension(F.col("path")))
    languages = c.select(repo.alias("repo"), name.alias("name")).filter("name IS NOT NULL").distinct().select("repo", "name", F.lit("language").alias("category"), F.lit(1.0).alias("confidence"))
    return found.unionByName(languages)


@query("SELECT DISTINCT file_path, module_name, CAST(coalesce(len(exports), 0) AS BIGINT) AS exports_n, CAST(coalesce(len(imports), 0) AS BIGINT) AS imports_n FROM extracted_modules WHERE file_path IS NOT NULL")
def index_round_trip(spark, sf_dir):
    """The module index saved in buckets and read back, then updated file by file with what it holds: nothing is lost."""
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0).cast("long")
    m = load(spark, sf_dir, "extracted_modules").filter("file_path IS NOT NULL").select("file_path", "module_name", size("exports").alias("exports_n"), size("imports").alias("imports_n")).distinct()
    store = index_store.IndexStore(spark, scratch(spark, "index"), "file_path")
    store.replace(m)
    store.replace(m.filter("exports_n > 2"))
    return store.read()


@query("SELECT file_path, name, start_line FROM (SELECT DISTINCT file_path, name, start_line FROM extracted_units) WHERE file_path NOT LIKE '%.py' UNION SELECT file_path, name || '!', start_line FROM (SELECT DISTINCT file_path, name, start_line FROM extracted_units) WHERE file_path LIKE '%.py'")
def index_incremental(spark, sf_dir):
    """The unit index after all Python files were taken out and indexed again under other names."""
    u = load(spark, sf_dir, "extracted_units").select("file_path", "name", "start_line").distinct()
    store = index_store.IndexStore(spark, scratch(spark, "index"), "file_path")
    store.replace(u)
    store.replace(u.filter("file_path LIKE '%.py'").withColumn("name", F.concat("name", F.lit("!"))))
    return store.read()


@query(f"""WITH {UNITS}, {INSTANCES} SELECT (SELECT count(DISTINCT file_path) FROM extracted_modules) AS modules, (SELECT count(*) FROM u) AS units_n, (SELECT count(*) FROM mined) AS patterns, (SELECT CAST(sum(greatest(0, original_tokens - compressed_tokens)) AS BIGINT) FROM mined) AS savings,
(SELECT CAST(sum(floor(length(coalesce(signature, '')) / 4 + 0.5)) AS BIGINT) FROM u) AS tokens""")
def intelligence_stats(spark, sf_dir):
    """One row about the whole index: modules, units, patterns, savings and tokens."""
    u = cut(_units(spark, sf_dir))
    out = u.agg(F.count(F.lit(1)).alias("units_n"), F.sum(F.floor(F.length(F.coalesce("signature", F.lit(""))) / 4 + 0.5)).cast("long").alias("tokens"))
    m = cut(C.mined_patterns(u))
    out = out.withColumn("patterns", m.agg(F.count(F.lit(1)).alias("n")).scalar()).withColumn("savings", m.agg(F.sum("savings").alias("n")).scalar())
    return out.withColumn("modules", _modules(spark, sf_dir).agg(F.count_distinct("file_path").alias("n")).scalar())


@query(f"WITH {UNITS} SELECT file_path, start_line, name, class, 1.0::DOUBLE AS confidence, CAST(floor(length(coalesce(signature, '')) / 4 + 0.5) AS BIGINT) AS tokens FROM u WHERE class IN ('query', 'validation') AND complexity <= 5")
def ask_units(spark, sf_dir):
    """The one entry to the index, asked for units of two classes and bounded complexity."""
    a = C.ask("units", load(spark, sf_dir, "extracted_units"), _modules(spark, sf_dir), classes=["query", "validation"], most=5)
    return a.select("file_path", "start_line", "name", "class", F.lit(1.0).alias("confidence"), F.floor(F.length(F.coalesce("signature", F.lit(""))) / 4 + 0.5).alias("tokens"))


@query("WITH e AS (SELECT DISTINCT file_path, x.name AS export, x.kind AS kind FROM (SELECT file_path, unnest(exports) AS x FROM extracted_modules)) SELECT file_path, export, kind FROM e WHERE contains(lower(export), 'audit')")
def ask_exports(spark, sf_dir):
    """The same entry, asked for exports by a part of their name."""
    return C.ask("exports", load(spark, sf_dir, "extracted_units"), _modules(spark, sf_dir), name="audit")


@query("SELECT path, octet_length(encode(coalesce(content, ''))) AS size, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension, CAST(len(string_split(coalesce(content, ''), chr(10))) AS BIGINT) AS lines FROM file_contents")
def metadata_built(spark, sf_dir):
    """The metadata row of every file as it is built from its text."""
    c = load(spark, sf_dir, "file_contents")
    text = F.coalesce("content", F.lit(""))
    return c.select("path", F.octet_length(text).cast("long").alias("size"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.size(F.split(text, "\n")).cast("long").alias("lines"))


@query("SELECT DISTINCT path FROM files WHERE list_contains(exports, 'default') OR list_contains(imports, 'react') OR len(list_filter(coalesce(exports, []), lambda x: contains(x, 'Ledger'))) > 0")
def files_by_capability(spark, sf_dir):
    """Files that offer something: an array holds a value, or a value with a part."""
    has = F.array_contains("exports", "default") | F.array_contains("imports", "react") | F.exists("exports", lambda x: F.contains(x, F.lit("Ledger")))
    return load(spark, sf_dir, "files").filter(has).select("path").distinct()
