"""References between units and modules: calls, types and imports resolved, pipelines, the knowledge graph and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.operators.graph import closure
from lodeworks.plans.lineage import cut

#: Modules that the runtime brings along. Fixed values.
BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "dns", "domain", "events", "fs", "http",
    "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream",
    "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)
#: Extensions tried behind a module's name. Fixed values.
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json")
#: What a step of a pipeline does, by the class of its unit. Fixed values.
OPERATIONS = (("validation", "validates"), ("transformer", "transforms"), ("command", "stores"), ("query", "produces"))
_TYPE_KINDS = ("interface", "type", "class", "enum")


def _first(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by, name): the least (file_path, start_line) of each group."""
    return rows.groupBy(*by).agg(F.min(F.struct("file_path", "start_line")).alias(name))


def call_cascade(u: DataFrame) -> DataFrame:
    """(file_path, start_line, target, step, to_file, to_line): what each call target stands for.

    First the first unit of that very name; else, for ``object.method``, the method of a class named like the object in
    any case; else that class, by its first method; else unresolved. Only a target's first two parts are read.
    """
    calls = u.select("file_path", "start_line", F.explode("call_targets").alias("target")).distinct()
    methods = u.filter(F.contains("name", F.lit("."))).withColumn("cls", F.lower(F.regexp_replace("name", r"\.[^.]*$", "")))
    dotted = F.contains("target", F.lit("."))
    calls = calls.withColumn("_o", F.when(dotted, F.lower(F.get(F.split("target", r"\."), F.lit(0))))).withColumn("_m", F.when(dotted, F.get(F.split("target", r"\."), F.lit(1))))
    joined = calls.join(_first(u, ["name"], "a"), F.col("target") == F.col("name"), "left").drop("name")
    joined = joined.join(_first(methods, ["cls", "short"], "b"), (F.col("_o") == F.col("cls")) & (F.col("_m") == F.col("short")), "left").drop("cls", "short")
    joined = joined.join(_first(methods, ["cls"], "d"), F.col("_o") == F.col("cls"), "left")
    step = T.first_label([(F.col("a").isNotNull(), "name"), (F.col("b").isNotNull(), "method"), (F.col("d").isNotNull(), "class")], "unresolved")
    k = F.coalesce("a", "b", "d")
    return joined.select("file_path", "start_line", "target", step.alias("step"), k["file_path"].alias("to_file"), k["start_line"].alias("to_line"))


def defined_types(modules: DataFrame) -> DataFrame:
    """(file_path, name, kind, bases) of the types that modules define, each once."""
    t = modules.select("file_path", F.explode("defined_types").alias("t"))
    return t.select("file_path", F.col("t.name").alias("name"), F.col("t.kind").alias("kind"), F.col("t.extends_types").alias("bases")).filter("name IS NOT NULL").distinct()


def _first_types(defined: DataFrame) -> DataFrame:
    return defined.filter(F.col("kind").isin(*_TYPE_KINDS)).groupBy(F.col("name").alias("_t")).agg(F.min("file_path").alias("to_file"))


def resolved_types(u: DataFrame, defined: DataFrame) -> DataFrame:
    """(file_path, start_line, type, to_file): each type reference with the first file that defines it, null where none does."""
    refs = u.select("file_path", "start_line", F.explode("type_dependencies").alias("type")).distinct()
    return refs.join(_first_types(defined), F.col("type") == F.col("_t"), "left").select("file_path", "start_line", "type", "to_file")


def imports_of(modules: DataFrame) -> DataFrame:
    """(file_path, spec) of the modules' imports, each once."""
    rows = modules.filter(F.col("file_path").isNotNull()).select("file_path", F.explode("imports").alias("i"))
    return rows.select("file_path", F.col("i.from_module").alias("spec")).filter("spec IS NOT NULL").distinct()


def suffix_imports(modules: DataFrame) -> DataFrame:
    """(file_path, spec, want, to_file): the least module whose path ends in the import, alone, with .ts or /index.ts.

    A suffix of whole path parts: the ends of every path by number of parts are joined by equality, so that no import
    meets a module it does not name. Leading dots are dropped, ``.js`` stands for ``.ts``.
    """
    want = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("spec", r"\.js$", ".ts"), r"\\", "/"), r"(^|/)(\.\.?/)+", "/"), "^/+", "")
    asked = imports_of(modules).withColumn("want", want)
    paths = modules.select("file_path").filter("file_path IS NOT NULL").distinct()
    parts = F.split(F.regexp_replace("file_path", "^/", ""), "/")
    ends = paths.select(F.col("file_path").alias("to"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))).alias("end"))
    forms = asked.filter("want <> ''").select("file_path", "spec", F.explode(F.array("want", F.concat("want", F.lit(".ts")), F.concat("want", F.lit("/index.ts")))).alias("form"))
    hit = forms.join(ends, F.col("form") == F.col("end")).groupBy(F.col("file_path").alias("_f"), F.col("spec").alias("_s")).agg(F.min("to").alias("to_file"))
    return asked.join(hit, (F.col("file_path") == F.col("_f")) & (F.col("spec") == F.col("_s")), "left").select("file_path", "spec", "want", "to_file")


def _joined_path(path):
    """A path without ``.`` and ``..`` parts, which are taken back from the left."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def import_cascade(modules: DataFrame, aliases: dict[str, str], root: str) -> DataFrame:
    """(file_path, spec, kind, to_file): builtin, relative, alias, fallback or unresolved.

    A relative import, and one that begins with an alias, is tried as it stands, with each extension, without ``.js``
    and as a folder's index; ``aliases`` maps a beginning to a folder below the importing file's root, the first group
    of ``root``. A relative import that finds nothing falls back to the path it names.
    """
    asked = imports_of(modules)
    base = F.regexp_replace("file_path", "/[^/]*$", "")
    raw = F.when(F.col("spec").startswith("."), F.concat(base, F.lit("/"), "spec"))
    for begin, folder in aliases.items():
        raw = raw.when(F.col("spec").startswith(begin), F.concat(F.regexp_extract("file_path", root, 1), F.lit("/" + folder), F.substring("spec", len(begin) + 1, 1 << 20)))
    at = asked.withColumn("_p", F.when(raw.isNotNull(), _joined_path(raw)))
    tails = F.array(F.lit(""), *[F.lit(e) for e in EXTENSIONS])
    tried = F.array_distinct(F.flatten(F.transform(tails, lambda e: F.array(F.concat("_p", e), F.concat(F.regexp_replace("_p", r"\.js$", ""), e), F.concat("_p", F.lit("/index"), e)))))
    known = modules.select(F.col("file_path").alias("_k")).filter("_k IS NOT NULL").distinct()
    hit = at.filter("_p IS NOT NULL").select(F.col("file_path").alias("_f"), F.col("spec").alias("_s"), F.explode(tried).alias("_c")).join(known, F.col("_c") == F.col("_k")).groupBy("_f", "_s").agg(F.min("_k").alias("hit"))
    joined = at.join(hit, (F.col("file_path") == F.col("_f")) & (F.col("spec") == F.col("_s")), "left")
    builtin = F.regexp_replace("spec", "^node:", "").isin(*BUILTINS)
    relative = F.col("spec").startswith(".")
    found = F.col("hit").isNotNull()
    kind = T.first_label([(F.col("spec") == "", "unresolved"), (builtin, "builtin"), (found & relative, "relative"), (found, "alias"), (relative, "fallback")], "unresolved")
    to = F.when(builtin, F.lit(None)).when(found, F.col("hit")).when(relative, F.col("_p"))
    return joined.select("file_path", "spec", kind.alias("kind"), to.alias("to_file"))


def entry_units(u: DataFrame) -> DataFrame:
    """The first unit of each file, by line and name, that can begin a pipeline: by its class, tags or name."""
    fits = F.col("class").isin("handler", "async-operation", "initializer") | F.array_contains("tags", "network-io") | F.col("name").rlike("(?i)^(main|init|start|bootstrap|setup|run|launch)")
    return u.filter(fits).groupBy("file_path").agg(F.min(F.struct("start_line", "name")).alias("e")).select("file_path", "e.name", "e.start_line")


def pipeline_steps(u: DataFrame, most: int = 10) -> DataFrame:
    """(entry, node, depth, operation, branching): the units that each file's entry leads to by the names it calls.

    A name stands for its first unit. Depth is the least number of calls; a unit with several targets branches.
    """
    u = cut(u.select("file_path", "start_line", "name", "class", "tags", "call_targets"))
    first = cut(u.groupBy("name").agg(F.min_by(F.struct("class", F.array_distinct("call_targets").alias("calls")), F.struct("file_path", "start_line")).alias("f")).select("name", "f.class", "f.calls"))
    names = first.select(F.col("name").alias("_n"))
    calls = first.select(F.col("name").alias("src"), F.explode("calls").alias("dst")).join(names, F.col("dst") == F.col("_n"), "left_semi")
    entries = entry_units(u).select(F.col("file_path").alias("entry"), F.col("name").alias("start"))
    reached = closure(calls, entries.select("start").distinct(), most).filter("start <> node").select("start", "node", "depth")
    every = reached.unionByName(entries.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    operation = T.first_label([(F.col("class") == c, o) for c, o in OPERATIONS], "consumes")
    steps = entries.join(every, "start").join(first, F.col("node") == F.col("name"))
    return steps.select("entry", "node", F.col("depth").cast("int").alias("depth"), operation.alias("operation"), (F.size("calls") > 1).alias("branching"))


def graph_edges(u: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst, kind, weight), each once: modules contain units and reference modules, units call units and use types, types extend types."""
    unit = F.concat("file_path", F.lit("#"), "name")
    row = lambda df, src, dst, kind, weight: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), F.lit(weight).alias("weight"))
    module = lambda c: F.concat(F.lit("module:"), c)
    contains = row(u, module("file_path"), unit, "contains", 1.0)
    first = u.groupBy(F.col("name").alias("_n")).agg(F.min("file_path").alias("_f"))
    called = u.select(unit.alias("from"), F.explode("call_targets").alias("t")).join(first, F.col("t") == F.col("_n"))
    calls = row(called, F.col("from"), F.concat("_f", F.lit("#"), "_n"), "calls", 1.0)
    defined = defined_types(modules)
    types = _first_types(defined)
    node = F.concat(F.lit("type:"), "to_file", F.lit("::"), "_t")
    used = u.select(unit.alias("from"), F.explode("type_dependencies").alias("t")).join(types, F.col("t") == F.col("_t"))
    uses = row(used, F.col("from"), node, "uses-type", 0.8)
    refers = row(suffix_imports(modules).filter("to_file IS NOT NULL"), module("file_path"), module("to_file"), "references", 0.5)
    based = defined.select(F.concat(F.lit("type:"), "file_path", F.lit("::"), "name").alias("from"), "kind", F.explode("bases").alias("base")).join(types, F.col("base") == F.col("_t"))
    extends = row(based, F.col("from"), node, F.when(F.col("kind") == "interface", "extends").otherwise("implements"), 1.0)
    every = contains.unionByName(calls).unionByName(uses).unionByName(refers).unionByName(extends)
    return every.groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 2, direction: str = "both") -> DataFrame:
    """(part, a, b, kind): nodes within ``depth`` steps of ``seeds`` (node), every edge followed from them, and the boundary.

    ``direction`` is forward, reverse or both. Depth is the least number of steps, so the result does not depend on
    the order of a walk. Boundary nodes are those one step further.
    """
    if direction not in ("forward", "reverse", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    e = cut(edges.select("src", "dst", "kind"))
    ways = [e.select(F.col("src").alias("a"), F.col("dst").alias("b"))] if direction != "reverse" else []
    ways += [e.select(F.col("dst").alias("a"), F.col("src").alias("b"))] if direction != "forward" else []
    step = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1]).distinct()
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for n in range(1, depth + 2):
        new = front.join(step, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        front = cut(new.join(seen.select(F.col("node").alias("_s")), F.col("node") == F.col("_s"), "left_anti").withColumn("depth", F.lit(n)))
        seen = seen.unionByName(front)
    inner = seen.filter(F.col("depth") <= depth)
    none = F.lit(None).cast("string")
    nodes = seen.select(F.when(F.col("depth") <= depth, "node").otherwise("boundary").alias("part"), F.col("node").alias("a"), none.alias("b"), none.alias("kind"))
    touched = []
    if direction != "reverse":
        touched.append(e.join(inner.select("node"), F.col("src") == F.col("node"), "left_semi"))
    if direction != "forward":
        touched.append(e.join(inner.select("node"), F.col("dst") == F.col("node"), "left_semi"))
    found = touched[0] if len(touched) == 1 else touched[0].unionByName(touched[1])
    return nodes.unionByName(found.distinct().select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), "kind"))


