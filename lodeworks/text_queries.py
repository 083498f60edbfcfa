"""Queries over text: terms, hashed vectors, scans, code features and edits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.operators.history import numbered
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


_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
WORDS = f"""words AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda w: length(w) > 2 AND w NOT IN {_STOP}) AS w FROM documents)"""
TERMS = f"""{WORDS}, grams AS (SELECT doc_id, unnest(w) AS term, 'word' AS kind FROM words
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), 'ngram' FROM words WHERE len(w) >= 2
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2])), 'ngram' FROM words WHERE len(w) > 20),
terms AS (SELECT doc_id, term, kind, count(*) AS n FROM grams GROUP BY ALL)"""
_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(term, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (a * 31 + b) & 4294967295)"
BUCKETS = f"""{TERMS}, hashed AS (SELECT term, CAST(abs(((h + 2147483648) & 4294967295) - 2147483648) % 384 AS INTEGER) AS bucket FROM (SELECT DISTINCT term, {_HASH} AS h FROM terms)),
raw AS (SELECT doc_id, bucket, sum(CASE WHEN kind = 'word' THEN n ELSE n * 1.5 END)::DOUBLE AS w FROM terms JOIN hashed USING (term) GROUP BY doc_id, bucket),
vectors AS (SELECT doc_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@query(f"WITH {WORDS} SELECT doc_id, len(w) AS words_n, len(list_distinct(w)) AS distinct_n FROM words")
def token_counts(spark, sf_dir):
    w = load(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("words_n"), F.size(F.array_distinct("w")).cast("long").alias("distinct_n"))


@query(f"WITH {TERMS} SELECT term, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS docs FROM terms WHERE kind = 'word' GROUP BY term")
def term_frequencies(spark, sf_dir):
    t = T.index_terms(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").filter("kind = 'word'")
    return t.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("docs"))


@query(f"WITH {TERMS} SELECT doc_id, count(*) AS ngrams_n, CAST(sum(n) AS BIGINT) AS total FROM terms WHERE kind = 'ngram' GROUP BY doc_id")
def ngram_counts(spark, sf_dir):
    t = T.index_terms(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").filter("kind = 'ngram'")
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("ngrams_n"), F.sum("n").alias("total"))


@query(f"WITH {BUCKETS} SELECT doc_id, bucket, round(weight, 6) AS weight FROM vectors")
def hashed_vectors(spark, sf_dir):
    return T.hashed_vectors(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query("""WITH d AS (SELECT doc_id, text, instr(lower(text), 'handoff') AS a, instr(lower(text), 'ledger') AS b FROM documents WHERE text IS NOT NULL), p AS (SELECT *, CASE WHEN a > 0 THEN a ELSE b END AS pos FROM d),
q AS (SELECT *, greatest(pos - 50, 1) AS s, least(pos - 1 + 150, length(text)) AS e FROM p)
SELECT doc_id, CASE WHEN pos > 0 THEN CASE WHEN s > 1 THEN '...' ELSE '' END || substring(text, s, e - s + 1) || CASE WHEN e < length(text) THEN '...' ELSE '' END ELSE substring(text, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END END AS snippet FROM q""")
def snippets(spark, sf_dir):
    return load(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", T.snippet(F.col("text"), ["handoff", "ledger"]).alias("snippet"))


_LANG = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGES.items()) + "}"


@query(f"SELECT coalesce(({_LANG})[lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1))], 'unknown') AS language, count(*) AS files FROM file_contents GROUP BY 1")
def language_distribution(spark, sf_dir):
    return load(spark, sf_dir, "file_contents").groupBy(T.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def _personal_sql(patterns) -> str:
    rows = " UNION ALL ".join("SELECT '{}' AS name, '{}' AS severity, '{}' AS p".format(n, s, p.replace("'", "''")) for n, p, s in patterns)
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL), r AS ({rows})
SELECT doc_id, line_no, name, severity, CAST(len(regexp_extract_all(line, p)) AS BIGINT) AS n FROM l, r WHERE regexp_matches(line, p)"""


@query(_personal_sql(T.PERSONAL))
def personal_data_lines(spark, sf_dir):
    return T.personal_data(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", "low")


@query("SELECT severity, CAST(sum(n) AS BIGINT) AS found FROM (" + _personal_sql([p for p in T.PERSONAL if p[2] != "low"]) + ") GROUP BY severity")
def personal_data_medium(spark, sf_dir):
    return T.personal_data(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", "medium").groupBy("severity").agg(F.sum("n").alias("found"))


def _secret_sql() -> str:
    rows = " UNION ALL ".join("SELECT '{}' AS name, '{}' AS severity, '{}' AS p".format(n, s, p.replace("'", "''")) for n, p, s in T.SECRETS)
    return f"""WITH v AS (SELECT DISTINCT id, content FROM versions WHERE content IS NOT NULL), l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM v), r AS ({rows})
SELECT id, line_no, name, severity, CAST(len(regexp_extract_all(line, p)) AS BIGINT) AS n FROM l, r WHERE regexp_matches(line, p)"""


@query(_secret_sql())
def secret_lines(spark, sf_dir):
    return T.scan_lines(load(spark, sf_dir, "versions").select("id", "content").filter("content IS NOT NULL").distinct(), "id", "content", T.SECRETS)


@query("SELECT name, CASE severity WHEN 'critical' THEN 0.95 WHEN 'high' THEN 0.85 WHEN 'medium' THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, count(DISTINCT id) AS records FROM (" + _secret_sql() + ") GROUP BY ALL")
def secret_confidence(spark, sf_dir):
    found = T.scan_lines(load(spark, sf_dir, "versions").select("id", "content").filter("content IS NOT NULL").distinct(), "id", "content", T.SECRETS)
    c = F.create_map(*[F.lit(x) for kv in T.CONFIDENCE.items() for x in kv])
    return found.groupBy("name", F.element_at(c, F.col("severity")).alias("confidence")).agg(F.count_distinct("id").alias("records"))


_TOKENS = """t AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, '[A-Za-z0-9+/_=-]{20,200}')) AS token FROM file_contents WHERE content IS NOT NULL),
k AS (SELECT * FROM t WHERE NOT regexp_matches(token, '^[0-9a-fA-F]+$|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-|^sha(256|384|512)-')),
c AS (SELECT path, token, unnest(string_split(token, '')) AS ch, length(token) AS n FROM k), p AS (SELECT path, token, ch, count(*) / any_value(n) AS p FROM c GROUP BY path, token, ch),
e AS (SELECT path, token, round(-sum(p * log2(p)), 6) AS bits FROM p GROUP BY path, token)"""


@query(f"WITH {_TOKENS} SELECT path, token, bits, substring(token, 1, 4) || '***' || right(token, 4) || '<len:' || length(token) || '>' AS masked FROM e WHERE bits >= 4.5")
def high_entropy_tokens(spark, sf_dir):
    return T.high_entropy(load(spark, sf_dir, "file_contents"), "path", "content").withColumn("masked", T.masked(F.col("token")))


#: Branching keywords of the line count, by family. Fixed values.
_BRANCHES = {"js": ["if", "else", "for", "while", "switch", "case", "catch"], "py": ["if", "elif", "else", "for", "while", "with", "try", "except", "finally"], "java": ["if", "else", "for", "while", "switch", "case", "catch", "try", "finally"]}
_CMP = {k: r"\b(" + "|".join(v) + r")\b" for k, v in _BRANCHES.items()}


@query("""WITH f AS (SELECT path, content, regexp_extract(path, '\\.([^./]+)$', 1) AS e FROM file_contents WHERE content IS NOT NULL)
SELECT path, 1 + len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, CASE WHEN e IN ('js', 'ts') THEN '""" + _CMP["js"] + """' WHEN e = 'py' THEN '""" + _CMP["py"] + """' ELSE '""" + _CMP["java"] + """' END))) AS complexity FROM f WHERE e IN ('js', 'ts', 'py', 'java')""")
def line_complexity(spark, sf_dir):
    f = load(spark, sf_dir, "file_contents").filter("content IS NOT NULL")
    ext = T.extension(F.col("path"))
    c = F.col("content")
    value = F.when(ext.isin("js", "ts"), T.line_complexity(c, _BRANCHES["js"])).when(ext == "py", T.line_complexity(c, _BRANCHES["py"])).when(ext == "java", T.line_complexity(c, _BRANCHES["java"]))
    return f.select("path", value.alias("complexity")).filter("complexity IS NOT NULL")


#: Imports by family. Fixed values.
_IMPORTS = {"js": r"""import\s+(?:\{[^}]+\}|\*\s+as\s+\w+|\w+)\s+from\s+['"]([^'"]+)['"]""", "py": r"(?:from|import)\s+([.\w]+)", "java": r"import\s+([^;]+);"}


@query("""WITH f AS (SELECT path, content, regexp_extract(path, '\\.([^./]+)$', 1) AS e FROM file_contents WHERE content IS NOT NULL)
SELECT path, unnest(list_distinct(CASE WHEN e IN ('js', 'ts') THEN regexp_extract_all(content, '""" + _IMPORTS["js"].replace("'", "''") + """', 1) WHEN e = 'java' THEN regexp_extract_all(content, '""" + _IMPORTS["java"] + """', 1) ELSE regexp_extract_all(content, '""" + _IMPORTS["py"] + """', 1) END)) AS imported FROM f WHERE e IN ('js', 'ts', 'java', 'py')""")
def imports_extracted(spark, sf_dir):
    f = load(spark, sf_dir, "file_contents").filter("content IS NOT NULL")
    ext = T.extension(F.col("path"))
    found = {k: F.regexp_extract_all("content", F.lit(p), F.lit(1)) for k, p in _IMPORTS.items()}
    each = F.when(ext == "java", found["java"]).when(ext == "py", found["py"]).otherwise(found["js"])
    return f.filter(ext.isin("js", "ts", "java", "py")).select("path", F.explode(F.array_distinct(each)).alias("imported"))


#: Exports of scripts. Fixed value.
_EXPORT = r"export\s+(?:default\s+)?(?:async\s+)?(class|function|const|let|var|interface|type|enum)\s+(\w+)"


@query(f"""WITH m AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, '{_EXPORT}')) AS s FROM file_contents WHERE regexp_matches(path, '\\.(js|ts)$'))
SELECT path, regexp_extract(s, '{_EXPORT}', 1) AS kind, regexp_extract(s, '{_EXPORT}', 2) AS name FROM m""")
def exports_extracted(spark, sf_dir):
    f = load(spark, sf_dir, "file_contents").filter(F.col("path").rlike(r"\.(js|ts)$") & F.col("content").isNotNull())
    s = f.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_EXPORT), F.lit(0)))).alias("s"))
    return s.select("path", F.regexp_extract("s", _EXPORT, 1).alias("kind"), F.regexp_extract("s", _EXPORT, 2).alias("name"))


#: What a text does besides returning a value: pattern and tag. Fixed values.
EFFECTS = (
    (r"\bconsole\.(log|error|warn|info|debug)\b", "console-output"),
    (r"\bfs\.(writeFile|appendFile|mkdir|unlink|rm|rename|copyFile|writeFileSync)\b", "filesystem-write"),
    (r"\bfs\.(readFile|stat|readdir|access|readFileSync|statSync|readdirSync)\b", "filesystem-read"),
    (r"\b(fetch|axios|XMLHttpRequest|http\.request|https\.request)\b", "network-request"),
    (r"\b(Math\.random|Date\.now|new Date\(\)|crypto\.randomUUID)\b", "non-deterministic"),
    (r"\b(setTimeout|setInterval|setImmediate|requestAnimationFrame)\b", "timer"),
    (r"\bthrow\s+", "throws"),
    (r"\bprocess\.(env|exit|stdout|stderr|stdin)\b", "process-io"),
)


@query("WITH r AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tag, '{p}' AS p" for p, t in EFFECTS) + ") SELECT path, tag FROM file_contents, r WHERE regexp_matches(content, p)")
def side_effects(spark, sf_dir):
    c = F.col("content")
    tags = T.tagged([(F.regexp_count(c, F.lit(T.ascii_bounds(p))) > 0, t) for p, t in EFFECTS])
    return load(spark, sf_dir, "file_contents").filter("content IS NOT NULL").select("path", F.explode(tags).alias("tag"))


#: What a whole module does, by the index's own tests. Fixed values.
MODULE_EFFECTS = (
    (r"console\.(log|warn|error|info)", "console-output"),
    (r"process\.exit", "process-exit"),
    (r"fs\.(write|unlink|mkdir|rmdir|rename|append)", "filesystem-write"),
    (r"fetch\(|axios\.|http\.request", "network-request"),
    (r"addEventListener|\.on\(", "event-listener"),
    (r"setInterval|setTimeout", "timer"),
    (r"new\s+Date\(\)", "datetime-dependency"),
    (r"Math\.random|crypto\.random", "non-deterministic"),
)


@query("WITH r AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tag, '{p}' AS p" for p, t in MODULE_EFFECTS) + ") SELECT path, tag FROM file_contents, r WHERE regexp_matches(path, '\\.(js|ts|jsx|tsx)$') AND regexp_matches(content, p)")
def module_effects(spark, sf_dir):
    """Effects of whole script modules; other languages have none."""
    c = F.col("content")
    rows = load(spark, sf_dir, "file_contents").filter(F.col("path").rlike(r"\.(js|ts|jsx|tsx)$") & c.isNotNull())
    return rows.select("path", F.explode(T.tagged([(c.rlike(p), t) for p, t in MODULE_EFFECTS])).alias("tag"))


#: Shapes of modules: text pattern, and tag. Fixed values.
MODULES = (
    (r"export\s+default\s+(?:function|class)", "default-export"),
    (r"router\.(get|post|put|delete|patch)", "route-handler"),
    (r"(?i)middleware|next\(\)", "middleware"),
    (r"\.on\(|\.emit\(|addEventListener", "event-handler"),
    (r"(?i)(create|read|update|delete|find|get|list)(?:ById|One|Many|All)?", "data-access"),
    (r"describe\(|it\(|test\(", "test-module"),
    (r"export\s+\{[^}]+\}", "re-export"),
)


#: More than five of the first make a barrel; the first of the others without the second, a module of types. Fixed values.
BARREL = r"(?i)export\s+(?:function|const|class)"
TYPES_ONLY = (r"export\s+(?:interface|type)\s+\w+", r"export\s+(?:function|class)")
#: Shapes of modules by the name of their file. Fixed values.
MODULE_NAMES = (("config|env|constant", "configuration"), ("util|helper|common", "utility"), ("service", "service"), ("controller", "controller"), ("model|entity|schema", "data-model"), ("middleware", "middleware"))


@query("WITH f AS (SELECT path, content, lower(regexp_extract(path, '([^/]+)$', 1)) AS name FROM file_contents WHERE regexp_matches(path, '\\.(js|ts)$')), r AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tag, '{p}' AS p" for p, t in MODULES) + "), n AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tag, '{p}' AS p" for p, t in MODULE_NAMES) + ") SELECT path, tag FROM f, r WHERE regexp_matches(content, p) UNION SELECT path, tag FROM f, n WHERE content IS NOT NULL AND regexp_matches(name, p) UNION SELECT path, 'barrel-module' FROM f WHERE len(regexp_extract_all(content, '" + BARREL + "')) > 5 UNION SELECT path, 'type-definition' FROM f WHERE regexp_matches(content, '" + TYPES_ONLY[0] + "') AND NOT regexp_matches(content, '" + TYPES_ONLY[1] + "')")
def module_shapes(spark, sf_dir):
    c, name = F.col("content"), F.lower(F.regexp_extract("path", "([^/]+)$", 1))
    counted = [(F.regexp_count(c, F.lit(BARREL)) > 5, "barrel-module"), (c.rlike(TYPES_ONLY[0]) & ~c.rlike(TYPES_ONLY[1]), "type-definition")]
    tags = T.tagged([(c.rlike(p), t) for p, t in MODULES] + [(name.rlike(p), t) for p, t in MODULE_NAMES] + counted)
    return load(spark, sf_dir, "file_contents").filter(F.col("path").rlike(r"\.(js|ts)$") & c.isNotNull()).select("path", F.explode(F.array_distinct(tags)).alias("tag"))


_EDITS = [("return", "yield"), ("limit", "{limit"), ("const", "`const`")]


@query("""WITH e AS (SELECT path, content, replace(content, 'return', 'yield') AS a FROM file_contents WHERE content IS NOT NULL), f AS (SELECT *, replace(a, 'limit', '{limit') AS b FROM e)
SELECT path, length(replace(b, 'const', '`const`')) AS length_after, CAST((length(content) - length(replace(content, 'return', ''))) / 6 + (length(a) - length(replace(a, 'limit', ''))) / 5 + (length(b) - length(replace(b, 'const', ''))) / 5 AS BIGINT) AS replaced FROM f""")
def edits_applied(spark, sf_dir):
    done, n = T.apply_edits(F.col("content"), _EDITS)
    return load(spark, sf_dir, "file_contents").filter("content IS NOT NULL").select("path", F.length(done).cast("long").alias("length_after"), n.alias("replaced"))


@query("""SELECT path, CASE WHEN regexp_matches(path, '\\.(js|ts|jsx|tsx|mjs|cjs)$') AND contains(content, '`') THEN 'high' ELSE 'medium' END AS risk FROM file_contents WHERE content IS NOT NULL""")
def edit_risks(spark, sf_dir):
    return load(spark, sf_dir, "file_contents").filter("content IS NOT NULL").select("path", T.edit_risk(F.col("path"), F.col("content"), [("const", "`const`"), ("a", "{"), ("b", "}")]).alias("risk"))


@query("""WITH f AS (SELECT path, content AS b, replace(replace(content, '`;', ';'), '});', ');') AS a, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS e FROM file_contents WHERE content IS NOT NULL),
n AS (SELECT *, len(string_split(a, '`')) - len(string_split(b, '`')) AS t, (len(string_split(a, '{')) - len(string_split(a, '}'))) - (len(string_split(b, '{')) - len(string_split(b, '}'))) AS s FROM f)
SELECT path, CASE WHEN e = 'json' AND NOT json_valid(a) THEN 'json' WHEN e IN ('js', 'ts') AND t % 2 <> 0 THEN 'ticks' WHEN s <> 0 THEN 'braces' END AS damage FROM n""")
def edit_damage(spark, sf_dir):
    after = F.replace(F.replace("content", F.lit("`;"), F.lit(";")), F.lit("});"), F.lit(");"))
    return load(spark, sf_dir, "file_contents").filter("content IS NOT NULL").select("path", T.edit_damage(F.col("path"), F.col("content"), after).alias("damage"))


@query(r"""WITH v AS (SELECT DISTINCT id, seq, file_path, timestamp, content FROM versions WHERE content IS NOT NULL), p AS (SELECT id, content AS b, lag(content) OVER (PARTITION BY file_path ORDER BY timestamp, seq, id) AS a FROM v),
s AS (SELECT id, a, b, string_split(a, chr(10)) AS x, string_split(b, chr(10)) AS y FROM p WHERE a IS NOT NULL AND a <> b),
d AS (SELECT id, a, b, x, y, list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i])[1] AS f, list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[-i] <> y[-i])[1] AS r FROM s),
e AS (SELECT *, coalesce(f, least(len(x), len(y)) + 1) AS first_changed, coalesce(r - 1, least(len(x), len(y))) AS tail FROM d)
SELECT id, octet_length(encode(b)) - octet_length(encode(a)) AS byte_delta, first_changed, greatest(len(y) - tail, first_changed) AS last_changed, greatest(0, len(y) - len(x)) AS lines_added, greatest(0, len(x) - len(y)) AS lines_removed FROM e""")
def edit_diffs(spark, sf_dir):
    """What each version changed against the version of its file before it that has content."""
    v = load(spark, sf_dir, "versions").filter("content IS NOT NULL").select("id", "seq", "file_path", "timestamp", "content").distinct()
    n = numbered(v, ["file_path"], "timestamp", ["seq", "id"])
    was = n.select(F.col("file_path").alias("_f"), (F.col("n") + 1).alias("_n"), F.col("content").alias("a"))
    p = n.join(was, F.col("file_path").eqNullSafe(F.col("_f")) & (F.col("n") == F.col("_n"))).select("id", F.col("content").alias("b"), "a").filter("a <> b")
    s = p.select("id", "a", "b", F.split("a", "\n").alias("x"), F.split("b", "\n").alias("y"))
    both = F.sequence(F.lit(1), F.least(F.size("x"), F.size("y")))
    head = F.get(F.filter(both, lambda i: F.element_at("x", i) != F.element_at("y", i)), F.lit(0))
    tail = F.get(F.filter(both, lambda i: F.element_at("x", -i) != F.element_at("y", -i)), F.lit(0)) - 1
    d = s.withColumn("first_changed", F.coalesce(head, F.least(F.size("x"), F.size("y")) + 1)).withColumn("_tail", F.coalesce(tail, F.least(F.size("x"), F.size("y"))))
    grown = F.size("y") - F.size("x")
    return d.select("id", (F.octet_length("b") - F.octet_length("a")).cast("long").alias("byte_delta"), F.col("first_changed").cast("long").alias("first_changed"), F.greatest(F.size("y") - F.col("_tail"), F.col("first_changed")).cast("long").alias("last_changed"), F.greatest(F.lit(0), grown).cast("long").alias("lines_added"), F.greatest(F.lit(0), -grown).cast("long").alias("lines_removed"))


#: Ordered categories of error messages. Fixed values.
_ERRORS = (
    ("no such file|not found", "file_not_found"),
    ("permission", "permission_denied"),
    ("no space|quota", "disk_full"),
    ("lock|in use", "file_locked"),
    ("is a directory", "is_directory"),
    ("not a directory", "not_directory"),
    ("unexpected token|invalid json|corrupt", "data_corruption"),
    ("encoding|decode|utf-8", "encoding_error"),
    (None, "cache_error"),  # by the component that met the error
    ("connect|network|timeout", "network_error"),
    ("circular|cycle", "circular_dependency"),
)


_COMPONENT = "regexp_extract(file_path, '/([^/]+)/[^/]+$', 1)"
CATEGORY = "CASE " + " ".join((f"WHEN regexp_matches(lower(error_message), '{p}')" if p else f"WHEN {_COMPONENT} = 'cache'") + f" THEN '{c}'" for p, c in _ERRORS) + " ELSE 'generic_error' END"


def error_category(message, component):
    """The category of an error: the first that its message, or for the cache its component, fits."""
    return T.first_label([(F.lower(message).rlike(p) if p else component == "cache", c) for p, c in _ERRORS], "generic_error")


@query(f"SELECT file_path, error_message, {CATEGORY} AS category FROM (SELECT DISTINCT file_path, error_message FROM extracted_modules WHERE error_message IS NOT NULL)")
def error_categories(spark, sf_dir):
    e = load(spark, sf_dir, "extracted_modules").filter("error_message IS NOT NULL").select("file_path", "error_message").distinct()
    return e.withColumn("category", error_category(F.col("error_message"), F.regexp_extract("file_path", "/([^/]+)/[^/]+$", 1)))


@query(f"""WITH e AS (SELECT DISTINCT file_path, {CATEGORY} AS category FROM extracted_modules WHERE error_message IS NOT NULL), ok AS (SELECT DISTINCT file_path FROM extracted_modules WHERE error_message IS NULL)
SELECT category, count(*) AS attempts, CAST(count(ok.file_path) AS BIGINT) AS successes, round(count(ok.file_path) / count(*), 6)::DOUBLE AS success_rate FROM e LEFT JOIN ok ON ok.file_path = e.file_path GROUP BY category""")
def recovery_stats(spark, sf_dir):
    """Per category of error the files that met it, and those that a later parse got through."""
    m = load(spark, sf_dir, "extracted_modules")
    ok = m.filter("error_message IS NULL").select(F.col("file_path").alias("_ok")).distinct()
    met = m.filter("error_message IS NOT NULL").select("file_path", error_category(F.col("error_message"), F.regexp_extract("file_path", "/([^/]+)/[^/]+$", 1)).alias("category")).distinct()
    g = met.join(ok, F.col("file_path") == F.col("_ok"), "left").groupBy("category").agg(F.count(F.lit(1)).alias("attempts"), F.count("_ok").alias("successes"))
    return g.withColumn("success_rate", F.round(F.col("successes") / F.col("attempts"), 6))


#: Languages of the index by extension; files of other kinds are not counted. Fixed values.
INDEX_LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "rb": "ruby", "php": "php",
    "swift": "swift", "kt": "kotlin", "scala": "scala", "c": "c", "cpp": "cpp", "html": "html", "css": "css", "scss": "scss", "sql": "sql", "json": "json",
    "yaml": "yaml", "yml": "yaml", "md": "markdown", "sh": "bash",
}
_INDEX_LANG = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in INDEX_LANGUAGES.items()) + "}"


@query(f"SELECT language, count(*) AS files FROM (SELECT ({_INDEX_LANG})[lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1))] AS language FROM file_contents) WHERE language IS NOT NULL GROUP BY language")
def index_languages(spark, sf_dir):
    """Files by language as the index counts them."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in INDEX_LANGUAGES.items() for x in kv]), T.extension(F.col("path")))
    return load(spark, sf_dir, "file_contents").select(name.alias("language")).filter("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("files"))
