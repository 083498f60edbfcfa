"""Queries over references between units and modules, pipelines and the knowledge graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.code_queries import UNITS, _modules, _units
from lodeworks.operators import resolution as R

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


_FIRST = "byname AS (SELECT name, min((file_path, start_line)) AS k FROM u GROUP BY name), owner AS (SELECT lower(regexp_replace(name, '\\.[^.]*$', '')) AS cls, min((file_path, start_line)) AS k FROM u WHERE contains(name, '.') GROUP BY 1)"


@query(rf"""WITH {UNITS}, {_FIRST}, c AS (SELECT DISTINCT file_path, start_line, unnest(call_targets) AS target FROM u),
m AS (SELECT lower(regexp_replace(name, '\.[^.]*$', '')) AS cls, short, min((file_path, start_line)) AS k FROM u WHERE contains(name, '.') GROUP BY 1, 2),
j AS (SELECT c.*, byname.k AS a, m.k AS b, owner.k AS d FROM c LEFT JOIN byname ON byname.name = c.target LEFT JOIN m ON contains(c.target, '.') AND m.cls = lower(string_split(c.target, '.')[1]) AND m.short = string_split(c.target, '.')[2] LEFT JOIN owner ON contains(c.target, '.') AND owner.cls = lower(string_split(c.target, '.')[1])),
r AS (SELECT *, coalesce(a, b, d) AS k, CASE WHEN a IS NOT NULL THEN 'name' WHEN b IS NOT NULL THEN 'method' WHEN d IS NOT NULL THEN 'class' ELSE 'unresolved' END AS step FROM j)
SELECT file_path, start_line, target, step, k[1] AS to_file, k[2] AS to_line FROM r""")
def call_cascade(spark, sf_dir):
    """Call targets resolved by name, else by class and method, else to the class."""
    return R.call_cascade(_units(spark, sf_dir))


_DEFINED = "defined AS (SELECT DISTINCT file_path, t.name AS name, t.kind AS kind, t.extends_types AS bases FROM (SELECT file_path, unnest(defined_types) AS t FROM extracted_modules) WHERE t.name IS NOT NULL)"


@query(rf"""WITH {UNITS}, {_DEFINED}, f AS (SELECT name, min(file_path) AS to_file FROM defined WHERE kind IN ('interface', 'type', 'class', 'enum') GROUP BY name), t AS (SELECT DISTINCT file_path, start_line, unnest(type_dependencies) AS type FROM u)
SELECT t.file_path, t.start_line, t.type, to_file FROM t LEFT JOIN f ON f.name = t.type""")
def type_resolution(spark, sf_dir):
    """Type references of units with the first definition of the type."""
    return R.resolved_types(_units(spark, sf_dir), R.defined_types(_modules(spark, sf_dir)))


_SUFFIX = r"""m AS (SELECT DISTINCT file_path FROM extracted_modules WHERE file_path IS NOT NULL), i AS (SELECT DISTINCT file_path, x.from_module AS spec FROM (SELECT file_path, unnest(imports) AS x FROM extracted_modules WHERE file_path IS NOT NULL) WHERE x.from_module IS NOT NULL),
n AS (SELECT *, regexp_replace(regexp_replace(replace(regexp_replace(spec, '\.js$', '.ts'), '\', '/'), '(^|/)(\.\.?/)+', '/', 'g'), '^/+', '') AS want FROM i)"""


@query(rf"""WITH {_SUFFIX}, h AS (SELECT n.file_path, spec, min(m.file_path) AS to_file FROM n JOIN m ON n.want <> '' AND (ends_with(m.file_path, '/' || want) OR ends_with(m.file_path, '/' || want || '.ts') OR ends_with(m.file_path, '/' || want || '/index.ts')) GROUP BY ALL)
SELECT n.file_path, n.spec, to_file FROM n LEFT JOIN h ON h.file_path = n.file_path AND h.spec = n.spec""")
def import_suffixes(spark, sf_dir):
    """Imports joined to the module whose path ends in them, alone, with .ts or as a folder's index."""
    return R.suffix_imports(_modules(spark, sf_dir)).select("file_path", "spec", "to_file")


_BUILTIN = "(" + ", ".join(f"'{b}'" for b in R.BUILTINS) + ")"


@query(rf"""WITH RECURSIVE m AS (SELECT DISTINCT file_path FROM extracted_modules WHERE file_path IS NOT NULL), i AS (SELECT DISTINCT file_path, x.from_module AS spec FROM (SELECT file_path, unnest(imports) AS x FROM extracted_modules WHERE file_path IS NOT NULL) WHERE x.from_module IS NOT NULL),
s AS (SELECT *, CASE WHEN starts_with(spec, '.') THEN regexp_replace(file_path, '/[^/]*$', '') || '/' || spec WHEN starts_with(spec, '@/') THEN regexp_extract(file_path, '^(/srv/ws/[^/]+)', 1) || '/src/' || substring(spec, 3) END AS raw FROM i),
w(file_path, spec, p) AS (SELECT file_path, spec, regexp_replace(raw, '(/\.)+(/|$)', '\2', 'g') FROM s WHERE raw IS NOT NULL UNION SELECT file_path, spec, regexp_replace(p, '/[^/]+/\.\.(/|$)', '\1') FROM w WHERE regexp_matches(p, '/[^/]+/\.\.(/|$)')),
t AS (SELECT file_path, spec, p FROM w WHERE NOT regexp_matches(p, '/[^/]+/\.\.(/|$)')),
x AS (SELECT file_path, spec, p, unnest([p || e, regexp_replace(p, '\.js$', '') || e, p || '/index' || e]) AS cand FROM t, (SELECT unnest(['', {", ".join(f"'{e}'" for e in R.EXTENSIONS)}]) AS e)),
h AS (SELECT x.file_path, x.spec, min(m.file_path) AS hit FROM x JOIN m ON m.file_path = x.cand GROUP BY ALL)
SELECT s.file_path, s.spec, CASE WHEN s.spec = '' THEN 'unresolved' WHEN regexp_replace(s.spec, '^node:', '') IN {_BUILTIN} THEN 'builtin' WHEN hit IS NOT NULL AND starts_with(s.spec, '.') THEN 'relative' WHEN hit IS NOT NULL THEN 'alias' WHEN starts_with(s.spec, '.') THEN 'fallback' ELSE 'unresolved' END AS kind,
CASE WHEN regexp_replace(s.spec, '^node:', '') IN {_BUILTIN} THEN NULL WHEN hit IS NOT NULL THEN hit WHEN starts_with(s.spec, '.') THEN t.p END AS to_file FROM s LEFT JOIN t ON t.file_path = s.file_path AND t.spec = s.spec LEFT JOIN h ON h.file_path = s.file_path AND h.spec = s.spec""")
def import_cascade(spark, sf_dir):
    """Imports as builtin, relative, by alias, fallback or unresolved; @/ stands for the repository's src folder."""
    return R.import_cascade(_modules(spark, sf_dir), {"@/": "src/"}, "^(/srv/ws/[^/]+)")


_ENTRY = r"(class IN ('handler', 'async-operation', 'initializer') OR list_contains(tags, 'network-io') OR regexp_matches(name, '(?i)^(main|init|start|bootstrap|setup|run|launch)'))"


@query(rf"WITH {UNITS} SELECT file_path, arg_min(name, (start_line, name)) AS name, min(start_line) AS start_line FROM u WHERE {_ENTRY} GROUP BY file_path")
def entry_units(spark, sf_dir):
    """The first unit of each file that can be the entry of a pipeline."""
    return R.entry_units(_units(spark, sf_dir)).select("file_path", "name", "start_line")


@query(rf"""WITH RECURSIVE {UNITS}, e AS (SELECT file_path AS entry, arg_min(name, (start_line, name)) AS name FROM u WHERE {_ENTRY} GROUP BY file_path), first AS (SELECT name, arg_min(class, (file_path, start_line)) AS class, arg_min(len(list_distinct(call_targets)), (file_path, start_line)) AS targets, arg_min(list_distinct(call_targets), (file_path, start_line)) AS calls FROM u GROUP BY name),
calls AS (SELECT f.name AS src, x.t AS dst FROM (SELECT name, unnest(calls) AS t FROM first) x JOIN first f ON f.name = x.name JOIN first g ON g.name = x.t),
r(entry, node, depth) AS (SELECT entry, name, 0 FROM e UNION SELECT r.entry, calls.dst, r.depth + 1 FROM r JOIN calls ON calls.src = r.node WHERE r.depth < 10), b AS (SELECT entry, node, min(depth) AS depth FROM r GROUP BY ALL)
SELECT entry, node, CAST(depth AS INTEGER) AS depth, CASE class WHEN 'validation' THEN 'validates' WHEN 'transformer' THEN 'transforms' WHEN 'command' THEN 'stores' WHEN 'query' THEN 'produces' ELSE 'consumes' END AS operation, targets > 1 AS branching FROM b JOIN first ON first.name = b.node""")
def pipeline_steps(spark, sf_dir):
    """What each file's entry leads to along calls, ten steps at most, with the operation and branching of each step."""
    return R.pipeline_steps(_units(spark, sf_dir))


_EDGES = rf"""{_FIRST}, {_DEFINED}, first AS (SELECT name, min(file_path) AS to_file FROM defined WHERE kind IN ('interface', 'type', 'class', 'enum') GROUP BY name), mods AS (SELECT DISTINCT file_path FROM extracted_modules WHERE file_path IS NOT NULL), {_SUFFIX.replace('m AS', 'mm AS', 1).replace('FROM extracted_modules WHERE file_path IS NOT NULL), i AS', 'FROM extracted_modules WHERE file_path IS NOT NULL), i AS')},
imp AS (SELECT n.file_path, spec, min(mm.file_path) AS to_file FROM n JOIN mm ON n.want <> '' AND (ends_with(mm.file_path, '/' || want) OR ends_with(mm.file_path, '/' || want || '.ts') OR ends_with(mm.file_path, '/' || want || '/index.ts')) GROUP BY ALL),
edges AS (SELECT 'module:' || file_path AS src, file_path || '#' || name AS dst, 'contains' AS kind, 1.0 AS weight FROM u
UNION SELECT c.src, k.file_path || '#' || k.name, 'calls', 1.0 FROM (SELECT file_path || '#' || name AS src, unnest(call_targets) AS t FROM u) c JOIN (SELECT name, min(file_path) AS file_path FROM u GROUP BY name) k ON k.name = c.t
UNION SELECT c.src, 'type:' || to_file || '::' || c.t, 'uses-type', 0.8 FROM (SELECT file_path || '#' || name AS src, unnest(type_dependencies) AS t FROM u) c JOIN first ON first.name = c.t
UNION SELECT 'module:' || file_path, 'module:' || to_file, 'references', 0.5 FROM imp
UNION SELECT 'type:' || d.file_path || '::' || d.name, 'type:' || first.to_file || '::' || first.name, CASE WHEN d.kind = 'interface' THEN 'extends' ELSE 'implements' END, 1.0 FROM (SELECT file_path, name, kind, unnest(bases) AS base FROM defined) d JOIN first ON first.name = d.base)"""


@query(rf"WITH {UNITS}, {_EDGES} SELECT kind, count(*) AS edges_n, count(DISTINCT src) AS sources, round(sum(weight), 3)::DOUBLE AS weight FROM edges GROUP BY kind")
def graph_edge_kinds(spark, sf_dir):
    """The whole knowledge graph by kind of edge: contains, calls, uses-type, references, extends, implements."""
    e = R.graph_edges(_units(spark, sf_dir), _modules(spark, sf_dir))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("edges_n"), F.count_distinct("src").alias("sources"), F.round(F.sum("weight"), 3).alias("weight"))


_SEED = "(SELECT 'module:' || min(file_path) FROM u)"


@query(rf"""WITH RECURSIVE {UNITS}, {_EDGES}, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), r(node, depth) AS (SELECT {_SEED}, 0 UNION SELECT b, depth + 1 FROM r JOIN both_ways ON a = node WHERE depth < 3), d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
SELECT 'node' AS part, node AS a, NULL AS b, NULL AS kind FROM d WHERE depth <= 2 UNION ALL SELECT 'boundary', node, NULL, NULL FROM d WHERE depth = 3
UNION ALL SELECT 'edge', src, dst, kind FROM edges WHERE src IN (SELECT node FROM d WHERE depth <= 2) OR dst IN (SELECT node FROM d WHERE depth <= 2)""")
def subgraph(spark, sf_dir):
    """Nodes, edges and boundary around the first module, two steps in both directions."""
    u = _units(spark, sf_dir)
    seed = u.agg(F.concat(F.lit("module:"), F.min("file_path")).alias("node"))
    return R.subgraph(R.graph_edges(u, _modules(spark, sf_dir)), seed, 2, "both")


@query(rf"""WITH RECURSIVE {UNITS}, {_EDGES}, r(node, depth) AS (SELECT {_SEED}, 0 UNION SELECT dst, depth + 1 FROM r JOIN edges ON src = node WHERE depth < 3), d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
SELECT 'node' AS part, node AS a, NULL AS b, NULL AS kind FROM d WHERE depth <= 2 UNION ALL SELECT 'boundary', node, NULL, NULL FROM d WHERE depth = 3
UNION ALL SELECT 'edge', src, dst, kind FROM edges WHERE src IN (SELECT node FROM d WHERE depth <= 2)""")
def subgraph_forward(spark, sf_dir):
    """The same along the edges alone."""
    u = _units(spark, sf_dir)
    seed = u.agg(F.concat(F.lit("module:"), F.min("file_path")).alias("node"))
    return R.subgraph(R.graph_edges(u, _modules(spark, sf_dir)), seed, 2, "forward")


@query(rf"""WITH {UNITS}, types AS (SELECT t.name AS type FROM (SELECT unnest(defined_types) AS t FROM extracted_modules) WHERE t.name IS NOT NULL UNION SELECT t.name FROM (SELECT unnest(imports) AS t FROM extracted_modules) WHERE t.is_type AND t.name IS NOT NULL UNION SELECT unnest(type_dependencies) FROM u),
s AS (SELECT file_path, start_line, type_dependencies AS d, regexp_extract_all(coalesce(input_signature, '') || ' ' || coalesce(output_signature, ''), '([A-Za-z_]\w*)', 1) AS i FROM u), e AS (SELECT file_path, start_line, unnest(list_distinct(list_concat(i, d))) AS name FROM s),
h AS (SELECT type, count(*) AS steps FROM e JOIN types ON e.name = type GROUP BY type) SELECT count(*) AS flows, CAST(floor(avg(steps) + 0.5) AS BIGINT) AS mean_steps, max(steps) AS most_steps FROM h""")
def type_flow_stats(spark, sf_dir):
    """Traced types, rounded mean and largest number of units a type passes."""
    from lodeworks.operators import codeintel as C

    u = _units(spark, sf_dir)
    flows = C.type_flows(u, C.known_types(u, _modules(spark, sf_dir))).groupBy("type").agg(F.count(F.lit(1)).alias("steps"))
    return flows.agg(F.count(F.lit(1)).alias("flows"), F.floor(F.avg("steps") + 0.5).alias("mean_steps"), F.max("steps").alias("most_steps"))
