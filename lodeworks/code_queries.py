"""Queries over code units and modules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.operators import codeintel as C
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


_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(short, '(?i)^({p})') THEN '{c}'" for p, c in C.NAME_CLASSES) + " WHEN list_contains(side_effects, 'network-request') OR list_contains(side_effects, 'filesystem-write') THEN 'io-bound' WHEN coalesce(is_async, false) THEN 'async-operation' ELSE 'utility' END"
_TAGS = "list_filter([" + ", ".join([f"CASE WHEN regexp_matches(short, '(?i)^({p})') THEN '{t}' END" for p, t in C.NAME_TAGS] + [f"CASE WHEN list_contains(side_effects, '{e}') THEN '{t}' END" for e, t in C.EFFECT_TAGS] + ["CASE WHEN len(list_filter(call_targets, lambda c: contains(c, 'validate') OR contains(c, 'check'))) > 0 THEN 'validation-chain' END", "CASE WHEN len(list_filter(call_targets, lambda c: contains(c, 'emit'))) > 0 THEN 'event-emitter' END"]) + "], lambda t: t IS NOT NULL)"
UNITS = rf"""once AS (SELECT DISTINCT file_path, name, kind, start_line, end_line, complexity, is_async, is_exported, signature, input_signature, output_signature, coalesce(call_targets, []) AS call_targets, coalesce(type_dependencies, []) AS type_dependencies,
  coalesce(side_effects, []) AS side_effects, body, regexp_replace(name, '^.*\.', '') AS short FROM extracted_units), u AS (SELECT *, {_CLASS} AS class, {_TAGS} AS tags FROM once)"""


def _units(spark, sf_dir):
    return C.classified(load(spark, sf_dir, "extracted_units"))


def _modules(spark, sf_dir):
    return load(spark, sf_dir, "extracted_modules")


@query(f"WITH {UNITS} SELECT file_path, start_line, name, class FROM u")
def unit_classes(spark, sf_dir):
    return _units(spark, sf_dir).select("file_path", "start_line", "name", "class")


@query(f"WITH {UNITS} SELECT file_path, start_line, unnest(tags) AS tag FROM u")
def unit_tags(spark, sf_dir):
    return _units(spark, sf_dir).select("file_path", "start_line", F.explode("tags").alias("tag"))


@query(rf"WITH {UNITS} SELECT file_path, start_line, 1 + len(regexp_extract_all(body, '\b(if|else|for|while|switch|case|catch|&&|\|\||\?\.|try)\b')) AS branches FROM u WHERE body IS NOT NULL")
def unit_branches(spark, sf_dir):
    return _units(spark, sf_dir).filter("body IS NOT NULL").select("file_path", "start_line", C.branch_count(F.col("body")).alias("branches"))


_NOCALL = "(" + ", ".join(f"'{w}'" for w in C.NO_CALLS) + ")"


_MATCHES = rf"list_filter(list_transform(regexp_extract_all(body, '{C.CALL}'), lambda c: regexp_replace(c, '[\s(]', '', 'g')), lambda c: regexp_replace(c, '^.*\.', '') NOT IN {_NOCALL})"


@query(rf"WITH {UNITS}, c AS (SELECT file_path, start_line, {_MATCHES} AS a FROM u WHERE body IS NOT NULL), d AS (SELECT file_path, start_line, list_filter(a, lambda x, i: list_position(a, x) = i)[1:30] AS a FROM c) SELECT file_path, start_line, unnest(a) AS target FROM d")
def unit_calls(spark, sf_dir):
    """The first thirty distinct calls of each body, in the order in which they occur."""
    u = _units(spark, sf_dir).filter("body IS NOT NULL").select("file_path", "start_line", C.calls_in(F.col("body")).alias("c"))
    return u.select("file_path", "start_line", F.explode("c").alias("target"))


@query(rf"WITH {UNITS} SELECT file_path, start_line, unnest(list_distinct(list_concat(regexp_extract_all(body, ':\s*([A-Z]\w+)', 1), regexp_extract_all(body, '<\s*([A-Z]\w+)', 1)))) AS type FROM u WHERE body IS NOT NULL")
def unit_type_refs(spark, sf_dir):
    return _units(spark, sf_dir).filter("body IS NOT NULL").select("file_path", "start_line", F.explode(C.types_in(F.col("body"))).alias("type"))


@query(f"WITH {UNITS} SELECT file_path, start_line, name, class, complexity FROM u WHERE class IN ('query', 'validation') AND complexity <= 4 AND starts_with(file_path, '/srv/ws/care-hub/')")
def unit_filter(spark, sf_dir):
    u = _units(spark, sf_dir)
    return u.filter(F.col("class").isin("query", "validation") & (F.col("complexity") <= 4) & F.col("file_path").startswith("/srv/ws/care-hub/")).select("file_path", "start_line", "name", "class", "complexity")


@query(f"""WITH {UNITS} SELECT class, count(*) AS units_n, round(avg(complexity), 2) AS mean_complexity, round(avg(CASE WHEN len(side_effects) = 0 THEN 1 ELSE 0 END), 3) AS pure_share, round(avg(CASE WHEN is_async THEN 1 ELSE 0 END), 3) AS async_share,
CAST(sum(floor(length(coalesce(signature, '')) / 4 + 0.5)) AS BIGINT) AS tokens FROM u GROUP BY class""")
def unit_stats(spark, sf_dir):
    flag = lambda c: F.avg(F.when(c, 1).otherwise(0))
    return _units(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("units_n"), F.round(F.avg("complexity"), 2).alias("mean_complexity"), F.round(flag(F.size("side_effects") == 0), 3).alias("pure_share"), F.round(flag(F.col("is_async")), 3).alias("async_share"), F.sum(F.floor(F.length(F.coalesce("signature", F.lit(""))) / 4 + 0.5)).cast("long").alias("tokens"))


_N = {k: f"regexp_matches(short, '{p}')" for k, p in C.CATEGORY_NAMES.items()}
_MEMBER = "[" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in (
    ("crud", _N["crud"]),
    ("middleware", _N["middleware"] + " OR list_contains(tags, 'validation-chain') OR class = 'handler' AND contains(coalesce(input_signature, ''), 'next')"),
    ("observer", _N["observer"] + " OR list_contains(tags, 'event-emitter')"),
    ("factory", _N["factory"] + " AND class = 'command' AND NOT list_contains(side_effects, 'filesystem-write')"),
    ("singleton", _N["singleton"]),
    ("adapter", _N["adapter"] + " AND class = 'transformer'"),
    ("strategy", _N["strategy"] + " AND class = 'handler'"),
    ("repository", _N["repository"] + " AND len(list_filter(side_effects, lambda e: contains(e, 'disk-io') OR contains(e, 'network-io'))) > 0"),
    ("service", "class = 'handler' OR coalesce(is_async, false) AND class NOT IN ('utility', 'query')"),
    ("controller", "class = 'handler' AND list_contains(tags, 'network-io')"),
    ("utility", "class = 'utility' AND len(side_effects) = 0"),
)) + "]"
_TEMPLATE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in C.TEMPLATES.items()) + "}"


_DELTAS = """CASE category
 WHEN 'crud' THEN [CASE WHEN is_async THEN 'async' END, CASE WHEN list_contains(side_effects, 'network-request') THEN 'network-io' END, CASE WHEN list_contains(side_effects, 'filesystem-write') THEN 'disk-io' END, CASE WHEN complexity > 5 THEN 'complexity:' || complexity END]
 WHEN 'middleware' THEN [CASE WHEN is_async THEN 'async' END, CASE WHEN list_contains(side_effects, 'network-request') THEN 'network-io' END]
 WHEN 'observer' THEN [class]
 WHEN 'factory' THEN [CASE WHEN len(type_dependencies) > 0 THEN 'creates:' || array_to_string(type_dependencies, ',') END]
 WHEN 'strategy' THEN [CASE WHEN is_async THEN 'async' END, CASE WHEN len(call_targets) > 3 THEN 'delegates:' || len(call_targets) END]
 WHEN 'repository' THEN [CASE WHEN list_contains(side_effects, 'network-request') THEN 'remote-store' END, CASE WHEN list_contains(side_effects, 'filesystem-write') THEN 'local-store' END]
 WHEN 'service' THEN [class, CASE WHEN len(call_targets) > 0 THEN 'calls:' || len(call_targets) END]
 WHEN 'controller' THEN [CASE WHEN len(list_filter(call_targets, lambda c: contains(c, 'service') OR contains(c, 'Service'))) > 0 THEN 'delegates-to-service' END]
 WHEN 'singleton' THEN CAST([] AS VARCHAR[])
 ELSE [coalesce(input_signature, '') || '\u2192' || coalesce(output_signature, '')] END"""
INSTANCES = f"""m AS (SELECT *, unnest({_MEMBER}) AS category, CAST(floor((length(coalesce(signature, '')) + length(coalesce(input_signature, '')) + length(coalesce(output_signature, '')) + length(array_to_string(side_effects, ',')) + length(array_to_string(call_targets[1:5], ',')) + length(array_to_string(type_dependencies, ','))) / 4 + 0.5) AS BIGINT) AS cost FROM u),
inst AS (SELECT category, file_path, name, start_line, list_filter({_DELTAS}, lambda d: d IS NOT NULL) AS deltas, round(least(1.0, 0.8 + CASE WHEN class = category THEN 0.15 ELSE 0 END + CASE WHEN len(list_filter(tags, lambda t: contains(t, category))) > 0 THEN 0.05 ELSE 0 END), 2)::DOUBLE AS confidence, cost FROM m WHERE category IS NOT NULL),
mined AS (SELECT category, 'pattern:' || category || ':' || substring(sha1(string_agg(file_path || '::' || name || '|' || array_to_string(deltas, ','), chr(10) ORDER BY file_path || '::' || name || '|' || array_to_string(deltas, ','))), 1, 12) AS id, count(*) AS instances, CAST(sum(cost) AS BIGINT) AS original_tokens,
 CAST(floor(length(({_TEMPLATE})[category]) / 4 + 0.5) + sum(floor(length(array_to_string(deltas, ',')) / 4 + 0.5) + 8) AS BIGINT) AS compressed_tokens FROM inst GROUP BY category HAVING count(*) >= 2)"""


@query(f"WITH {UNITS}, {INSTANCES} SELECT *, CASE WHEN original_tokens > 0 THEN round(compressed_tokens / original_tokens, 6) ELSE 1 END::DOUBLE AS ratio, greatest(0, original_tokens - compressed_tokens) AS savings FROM mined")
def pattern_mining(spark, sf_dir):
    return C.mined_patterns(_units(spark, sf_dir))


@query(f"WITH {UNITS}, {INSTANCES} SELECT category, file_path, name, start_line, array_to_string(deltas, ',') AS deltas, confidence FROM inst")
def pattern_instances(spark, sf_dir):
    """Each unit in each category it belongs to, with what sets it apart and the confidence."""
    return C.pattern_instances(_units(spark, sf_dir)).select("category", "file_path", "name", "start_line", F.array_join("deltas", ",").alias("deltas"), "confidence")


@query(f"WITH {UNITS}, {INSTANCES} SELECT count(*) AS patterns, CAST(sum(instances) AS BIGINT) AS instances, CAST(sum(greatest(0, original_tokens - compressed_tokens)) AS BIGINT) AS savings, (SELECT count(*) FROM u) AS units_n, round(((SELECT count(*) FROM u) - sum(instances) + count(*)) / (SELECT count(*) FROM u), 6)::DOUBLE AS ratio FROM mined")
def pattern_stats(spark, sf_dir):
    """Patterns, their instances and savings, and the overall ratio of compression."""
    from lodeworks.plans.lineage import cut

    u = cut(_units(spark, sf_dir))
    total = u.agg(F.count(F.lit(1)).alias("units_n"))
    m = C.mined_patterns(u).agg(F.count(F.lit(1)).alias("patterns"), F.sum("instances").alias("instances"), F.sum("savings").alias("savings"))
    return m.withColumn("units_n", total.scalar()).withColumn("ratio", F.round((F.col("units_n") - F.col("instances") + F.col("patterns")) / F.col("units_n"), 6))


@query(f"""WITH {UNITS}, {INSTANCES} SELECT category, 1 AS line_no, 'PATTERN: ' || category || ' pattern (' || instances || ' instances)' AS line FROM mined UNION ALL SELECT category, 2, '  Template: ' || ({_TEMPLATE})[category] FROM mined
UNION ALL SELECT category, 3, '  Token savings: ~' || greatest(0, original_tokens - compressed_tokens) FROM mined""")
def pattern_text(spark, sf_dir):
    """The mined patterns as text: title, template and savings; ``pattern_instances`` has the instances, one a row."""
    m = C.mined_patterns(_units(spark, sf_dir))
    template = F.element_at(F.create_map(*[F.lit(x) for kv in C.TEMPLATES.items() for x in kv]), F.col("category"))
    lines = [F.concat(F.lit("PATTERN: "), "category", F.lit(" pattern ("), F.col("instances").cast("string"), F.lit(" instances)")), F.concat(F.lit("  Template: "), template), F.concat(F.lit("  Token savings: ~"), F.col("savings").cast("string"))]
    return m.select("category", F.posexplode(F.array(*lines)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


_TYPES = "types AS (SELECT DISTINCT t.name AS type FROM (SELECT unnest(defined_types) AS t FROM extracted_modules) WHERE t.name IS NOT NULL)"


@query(rf"""WITH {UNITS}, types AS (SELECT t.name AS type FROM (SELECT unnest(defined_types) AS t FROM extracted_modules) WHERE t.name IS NOT NULL UNION SELECT t.name FROM (SELECT unnest(imports) AS t FROM extracted_modules) WHERE t.is_type AND t.name IS NOT NULL UNION SELECT unnest(type_dependencies) FROM u), s AS (SELECT file_path, start_line, class, tags, type_dependencies AS d, regexp_extract_all(coalesce(input_signature, ''), '([A-Za-z_]\w*)', 1) AS i, regexp_extract_all(coalesce(output_signature, ''), '([A-Za-z_]\w*)', 1) AS o FROM u),
e AS (SELECT *, unnest(list_distinct(list_concat(i, o, d))) AS name FROM s), h AS (SELECT e.*, t.type, list_contains(i, type) AS hi, list_contains(o, type) AS ho FROM e JOIN types t ON e.name = t.type)
SELECT type, file_path, start_line, CASE WHEN ho AND NOT hi THEN 'produces' WHEN hi AND ho AND class = 'transformer' THEN 'transforms' WHEN hi AND class = 'validation' THEN 'validates' WHEN ho AND list_contains(tags, 'network-io') THEN 'serializes' WHEN hi AND NOT ho THEN 'consumes' WHEN ho THEN 'produces' ELSE 'consumes' END AS operation FROM h""")
def type_flows(spark, sf_dir):
    u = _units(spark, sf_dir)
    return C.type_flows(u, C.known_types(u, _modules(spark, sf_dir)))


@query(rf"""WITH {UNITS}, f AS (SELECT short, min(file_path) AS to_file FROM u GROUP BY short), g AS (SELECT u.short, to_file, min(start_line) AS to_line FROM u JOIN f ON u.short = f.short AND u.file_path = f.to_file GROUP BY u.short, to_file),
c AS (SELECT DISTINCT file_path, start_line, unnest(call_targets) AS target FROM u) SELECT c.file_path, c.start_line, target, to_file, to_line FROM c LEFT JOIN g ON regexp_replace(target, '^.*\.', '') = g.short""")
def call_resolution(spark, sf_dir):
    return C.resolved_calls(_units(spark, sf_dir))


@query(r"""WITH k AS (SELECT regexp_replace(regexp_replace(file_path, '^.*/', ''), '\.[^.]+$', '') AS b, min(file_path) AS to_file FROM extracted_modules WHERE file_path IS NOT NULL GROUP BY 1),
i AS (SELECT DISTINCT file_path, x.from_module AS from_module FROM (SELECT file_path, unnest(imports) AS x FROM extracted_modules WHERE file_path IS NOT NULL) WHERE x.from_module IS NOT NULL),
w AS (SELECT *, regexp_extract(regexp_replace(from_module, '\.(js|ts)$', ''), '([^/.]*)$', 1) AS b FROM i)
SELECT w.file_path, from_module, CASE WHEN to_file IS NOT NULL THEN 'resolved' WHEN starts_with(from_module, '.') THEN 'unresolved' ELSE 'external' END AS kind, to_file FROM w LEFT JOIN k ON w.b = k.b""")
def import_resolution(spark, sf_dir):
    return C.resolved_imports(_modules(spark, sf_dir))


@query("""WITH e AS (SELECT DISTINCT file_path, x.name AS export, x.kind AS kind FROM (SELECT file_path, unnest(exports) AS x FROM extracted_modules)) SELECT file_path, export, kind FROM e WHERE contains(lower(export), 'ledger')""")
def exports_by_name(spark, sf_dir):
    return C.search_exports(_modules(spark, sf_dir), "ledger")


@query("""WITH m AS (SELECT DISTINCT file_path, module_name, len(exports) AS e, len(imports) AS i, len(defined_types) AS t FROM extracted_modules) SELECT module_name, count(*) AS files, CAST(sum(coalesce(e, 0)) AS BIGINT) AS exports_n, CAST(sum(coalesce(i, 0)) AS BIGINT) AS imports_n, CAST(sum(coalesce(t, 0)) AS BIGINT) AS types_n FROM m GROUP BY module_name""")
def module_sizes(spark, sf_dir):
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    m = _modules(spark, sf_dir).select("file_path", "module_name", size("exports").alias("e"), size("imports").alias("i"), size("defined_types").alias("t")).distinct()
    return m.groupBy("module_name").agg(F.count(F.lit(1)).alias("files"), F.sum("e").alias("exports_n"), F.sum("i").alias("imports_n"), F.sum("t").alias("types_n"))


@query(rf"""WITH {UNITS}, {_TYPES}, n AS (SELECT short, arg_min(file_path || '#' || name, (file_path, start_line)) AS dst FROM u GROUP BY short),
e AS (SELECT file_path AS src, file_path || '#' || name AS dst, 'contains' AS kind FROM u UNION SELECT c.src, n.dst, 'calls' FROM (SELECT file_path || '#' || name AS src, unnest(call_targets) AS t FROM u) c JOIN n ON regexp_replace(c.t, '^.*\.', '') = n.short
UNION SELECT c.src, 'type:' || c.t, 'uses-type' FROM (SELECT file_path || '#' || name AS src, unnest(type_dependencies) AS t FROM u) c JOIN types ON c.t = types.type)
SELECT kind, count(*) AS edges_n, count(DISTINCT src) AS sources, round(sum(CASE kind WHEN 'uses-type' THEN 0.8 ELSE 1.0 END), 3)::DOUBLE AS weight FROM e GROUP BY kind""")
def knowledge_graph_stats(spark, sf_dir):
    e = C.knowledge_edges(_units(spark, sf_dir), _modules(spark, sf_dir))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("edges_n"), F.count_distinct("src").alias("sources"), F.round(F.sum("weight"), 3).alias("weight"))


@query(rf"""WITH RECURSIVE {UNITS}, n AS (SELECT DISTINCT short FROM u), calls AS (SELECT DISTINCT u.short AS src, regexp_replace(t, '^.*\.', '') AS dst FROM (SELECT short, unnest(call_targets) AS t FROM u) u WHERE regexp_replace(t, '^.*\.', '') IN (SELECT short FROM n)),
entry AS (SELECT DISTINCT short FROM u WHERE is_exported AND class = 'query'), r(entry, node, depth) AS (SELECT short, short, 0 FROM entry UNION SELECT r.entry, c.dst, r.depth + 1 FROM r JOIN calls c ON c.src = r.node WHERE r.depth < 10),
b AS (SELECT entry, node, min(depth) AS depth FROM r GROUP BY entry, node) SELECT entry, CAST(max(depth) AS INTEGER) AS steps, count(*) AS nodes FROM b GROUP BY entry""")
def pipelines(spark, sf_dir):
    """How far the calls of each exported query function lead, ten steps at most."""
    from lodeworks.operators.graph import closure
    from lodeworks.plans.lineage import cut

    u = cut(_units(spark, sf_dir).select("short", "class", "is_exported", "call_targets"))
    names = u.select(F.col("short").alias("n")).distinct()
    calls = u.select(F.col("short").alias("src"), F.explode("call_targets").alias("t")).select("src", F.regexp_replace("t", r"^.*\.", "").alias("dst")).distinct().join(names, F.col("dst") == F.col("n"), "left_semi")
    entry = u.filter("is_exported AND class = 'query'").select(F.col("short").alias("start")).distinct()
    r = entry.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).unionByName(closure(calls, entry, 10).filter("start <> node"))
    return r.groupBy(F.col("start").alias("entry")).agg(F.max("depth").alias("steps"), F.count(F.lit(1)).alias("nodes"))
