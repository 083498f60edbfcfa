"""Code intelligence over extracted units and modules: classes, tags, mined patterns, type flows, resolution."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.functions import text as T
from lodeworks.plans.lineage import cut

#: Unit classes by the beginning of the name, in order. Fixed values.
NAME_CLASSES = (
    ("get|find|list|fetch|read|search|query|count|exists|has|is", "query"),
    ("create|add|insert|new|save|write|post", "command"),
    ("update|edit|modify|patch|put|set", "command"),
    ("delete|remove|destroy|erase", "command"),
    ("validate|check|verify|assert|ensure", "validation"),
    ("handle|on|process|execute|run|perform", "handler"),
    ("transform|convert|map|parse|serialize|format|encode|decode", "transformer"),
    ("init|setup|configure|bootstrap|start", "initializer"),
    ("teardown|cleanup|dispose|stop|shutdown", "finalizer"),
)
#: Tags by the beginning of the name, and by side effect. Fixed values.
NAME_TAGS = (("get|find|list|fetch", "data-retrieval"), ("create|add|insert", "data-creation"), ("update|edit|modify", "data-mutation"), ("delete|remove", "data-deletion"))
EFFECT_TAGS = (("network-request", "network-io"), ("filesystem-write", "disk-io"), ("console-output", "logging"), ("non-deterministic", "non-deterministic"), ("timer", "timer-dependent"))
#: Words that are no calls. Fixed values.
NO_CALLS = "if for while switch catch return throw new typeof instanceof async await const let var function class import export".split()
#: Mined pattern categories with their template texts. Fixed values.
TEMPLATES = {
    "crud": "CRUD<Entity> { create(data): Promise<Entity>; read(id): Promise<Entity>; update(id, data): Promise<Entity>; delete(id): Promise<void> }",
    "middleware": "Middleware { handle(req, next): Promise<void> }",
    "observer": "Observer { on(event, handler): void; emit(event, data): void }",
    "factory": "Factory { create(type): Product }",
    "singleton": "Singleton { getInstance(): Self }",
    "adapter": "Adapter { adapt(input): Output }",
    "strategy": "Strategy { execute(context): Result }",
    "repository": "Repository<Entity> { findById(id): Promise<Entity>; save(entity): Promise<void>; delete(id): Promise<void> }",
    "service": "Service { method(params): Promise<Result> }",
    "controller": "Controller { handleRequest(req, res): Promise<void> }",
    "utility": "Utility { fn(input): Output } // pure, no side effects",
}
#: Name patterns of the categories. Fixed values.
CATEGORY_NAMES = {
    "crud": r"(?i)^(create|add|insert|new|save|get|find|list|fetch|read|search|update|edit|modify|patch|delete|remove|destroy)(\w+)$",
    "middleware": "(?i)middleware",
    "observer": "(?i)^(on|emit|subscribe|unsubscribe|listen)",
    "factory": r"(?i)^(create|make|build|manufacture)(\w+)$",
    "singleton": "(?i)^(getInstance|getShared|getDefault|createDefault)",
    "adapter": "(?i)^(adapt|convert|transform|translate)",
    "strategy": "(?i)^(execute|run|apply|perform|process)",
    "repository": "(?i)^(find|get|list|search|save|delete|remove)",
}


#: Branching words and signs of a body, calls, and type names behind a colon or an opening angle. Fixed values.
BRANCH = r"\b(if|else|for|while|switch|case|catch|&&|\|\||\?\.|try)\b"
CALL = r"(?:(\w+)\s*\.\s*)?(\w+)\s*\("
TYPE_AFTER_COLON, TYPE_AFTER_ANGLE = r":\s*([A-Z]\w+)", r"<\s*([A-Z]\w+)"


def units(table: DataFrame) -> DataFrame:
    """Units once each, with the plain name after the class and empty arrays for null ones."""
    arrays = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("call_targets", "type_dependencies", "side_effects")}
    return table.distinct().withColumns(arrays).withColumn("short", F.regexp_replace("name", r"^.*\.", ""))


def unit_class(name: Column, effects: Column, is_async: Column) -> Column:
    """The class of a unit: the first rule of its name, else of its effects, else utility."""
    rules = [(name.rlike(f"(?i)^({p})"), c) for p, c in NAME_CLASSES]
    rules += [(F.array_contains(effects, "network-request"), "io-bound"), (F.array_contains(effects, "filesystem-write"), "io-bound"), (F.coalesce(is_async, F.lit(False)), "async-operation")]
    return T.first_label(rules, "utility")


def unit_tags(name: Column, effects: Column, calls: Column) -> Column:
    rules = [(name.rlike(f"(?i)^({p})"), t) for p, t in NAME_TAGS] + [(F.array_contains(effects, e), t) for e, t in EFFECT_TAGS]
    rules += [(F.exists(calls, lambda c: F.contains(c, F.lit("validate")) | F.contains(c, F.lit("check"))), "validation-chain"), (F.exists(calls, lambda c: F.contains(c, F.lit("emit"))), "event-emitter")]
    return T.tagged(rules)


def branch_count(body: Column) -> Column:
    """One more than the branching keywords and operators of a body."""
    return (F.regexp_count(body, F.lit(T.ascii_bounds(BRANCH))) + 1).cast("long")


def calls_in(body: Column, most: int = 30) -> Column:
    """The distinct call targets of a body in order of occurrence, at most ``most``: name or object.name."""
    raw = F.regexp_extract_all(body, F.lit(CALL), F.lit(0))
    clean = F.transform(raw, lambda c: F.regexp_replace(c, r"[\s(]", ""))
    stop = F.array(*[F.lit(w) for w in NO_CALLS])
    return F.slice(F.array_distinct(F.filter(clean, lambda c: ~F.array_contains(stop, F.regexp_replace(c, r"^.*\.", "")))), 1, most)


def types_in(body: Column) -> Column:
    """The distinct type names after a colon or an opening angle."""
    return F.array_distinct(F.concat(F.regexp_extract_all(body, F.lit(TYPE_AFTER_COLON), F.lit(1)), F.regexp_extract_all(body, F.lit(TYPE_AFTER_ANGLE), F.lit(1))))


def classified(table: DataFrame) -> DataFrame:
    u = units(table)
    return u.withColumn("class", unit_class(F.col("short"), F.col("side_effects"), F.col("is_async"))).withColumn("tags", unit_tags(F.col("short"), F.col("side_effects"), F.col("call_targets")))


def pattern_rules() -> list[tuple[Column, str]]:
    """Which units belong to each mined category; a unit may belong to several."""
    named = {k: F.col("short").rlike(p) for k, p in CATEGORY_NAMES.items()}
    kind, has = F.col("class"), lambda t: F.array_contains("tags", t)
    rules = [
        (named["crud"], "crud"),
        (named["middleware"] | has("validation-chain") | (kind == "handler") & F.contains(F.coalesce("input_signature", F.lit("")), F.lit("next")), "middleware"),
        (named["observer"] | has("event-emitter"), "observer"),
        (named["factory"] & (kind == "command") & ~F.array_contains("side_effects", "filesystem-write"), "factory"),
        (named["singleton"], "singleton"),
        (named["adapter"] & (kind == "transformer"), "adapter"),
        (named["strategy"] & (kind == "handler"), "strategy"),
        (named["repository"] & F.exists("side_effects", lambda e: F.contains(e, F.lit("disk-io")) | F.contains(e, F.lit("network-io"))), "repository"),
        ((kind == "handler") | F.coalesce("is_async", F.lit(False)) & ~kind.isin("utility", "query"), "service"),
        ((kind == "handler") & has("network-io"), "controller"),
        ((kind == "utility") & (F.size("side_effects") == 0), "utility"),
    ]
    return rules


def _deltas(category: Column) -> Column:
    """What sets a unit apart within its category, in order."""
    calls, effects, kind = F.col("call_targets"), F.col("side_effects"), F.col("class")
    has = lambda e: F.array_contains(effects, e)
    slow = F.when(F.coalesce(F.col("is_async"), F.lit(False)), "async")
    net, disk = F.when(has("network-request"), "network-io"), F.when(has("filesystem-write"), "disk-io")
    number = lambda label, n: F.concat(F.lit(label), n.cast("string"))
    passes = F.array(F.concat(F.coalesce("input_signature", F.lit("")), F.lit("\u2192"), F.coalesce("output_signature", F.lit(""))))
    by = {
        "crud": F.array(slow, net, disk, F.when(F.col("complexity") > 5, number("complexity:", F.col("complexity")))),
        "middleware": F.array(slow, net),
        "observer": F.array(kind),
        "factory": F.array(F.when(F.size("type_dependencies") > 0, F.concat(F.lit("creates:"), F.array_join("type_dependencies", ",")))),
        "adapter": passes,
        "strategy": F.array(slow, F.when(F.size(calls) > 3, number("delegates:", F.size(calls)))),
        "repository": F.array(F.when(has("network-request"), "remote-store"), F.when(has("filesystem-write"), "local-store")),
        "service": F.array(kind, F.when(F.size(calls) > 0, number("calls:", F.size(calls)))),
        "controller": F.array(F.when(F.exists(calls, lambda c: F.contains(c, F.lit("service")) | F.contains(c, F.lit("Service"))), "delegates-to-service")),
        "utility": passes,
    }
    out = F.array().cast("array<string>")
    for name, value in by.items():
        out = F.when(category == name, F.array_compact(value)).otherwise(out)
    return out


def pattern_instances(u: DataFrame) -> DataFrame:
    """(category, file_path, name, start_line, deltas, confidence, cost): each unit in each category it belongs to.

    Confidence is 0.8, and more where the class or a tag bears the category's name; cost is a quarter of the
    signs of signatures, effects, first five calls and type dependencies.
    """
    lengths = [F.length(F.coalesce(c, F.lit(""))) for c in ("signature", "input_signature", "output_signature")]
    lengths += [F.length(F.array_join(a, ",")) for a in (F.col("side_effects"), F.slice("call_targets", 1, 5), F.col("type_dependencies"))]
    cost = F.floor(sum(lengths[1:], lengths[0]) / 4 + 0.5).cast("long")
    each = u.withColumn("category", F.explode(T.tagged(pattern_rules()))).withColumn("deltas", _deltas(F.col("category")))
    tagged = F.exists("tags", lambda t: F.contains(t, F.col("category")))
    confidence = F.least(F.lit(1.0), F.lit(0.8) + F.when(F.col("class") == F.col("category"), 0.15).otherwise(0.0) + F.when(tagged, 0.05).otherwise(0.0))
    return each.select("category", "file_path", "name", "start_line", "deltas", F.round(confidence, 2).alias("confidence"), cost.alias("cost"))


def _fingerprints(instances: DataFrame) -> DataFrame:
    """(category, id): the SHA-1 over the sorted lines of a category's instances, its first twelve digits.

    The lines of a category are sorted, with spilling, and hashed one after the other; none are gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, None, []
        for b in batches:
            for category, part in b.groupby("category", sort=False):
                text = "\n".join(part["line"])
                if category == now:
                    state.update(b"\n")
                else:
                    if now is not None:
                        out.append((now, state.hexdigest()[:12]))
                    now, state = category, hashlib.sha1()
                state.update(text.encode())
        if now is not None:
            out.append((now, state.hexdigest()[:12]))
        yield pd.DataFrame(out, columns=["category", "hash"])

    line = F.concat("file_path", F.lit("::"), "name", F.lit("|"), F.array_join("deltas", ","))
    rows = instances.select("category", F.coalesce(line, F.lit("")).alias("line")).repartition("category").sortWithinPartitions("category", "line")
    return rows.mapInPandas(run, "category string, hash string").select("category", F.concat(F.lit("pattern:"), "category", F.lit(":"), "hash").alias("id"))


def mined_patterns(u: DataFrame) -> DataFrame:
    """(category, id, instances, original_tokens, compressed_tokens, ratio, savings): categories with two units or more.

    Tokens are a quarter of the signs; an instance costs eight besides its deltas, its category the template once. The
    id depends on the instances and their deltas alone.
    """
    instances = cut(pattern_instances(u))
    delta = F.floor(F.length(F.array_join("deltas", ",")) / 4 + 0.5).cast("long") + 8
    g = instances.groupBy("category").agg(F.count(F.lit(1)).alias("instances"), F.sum("cost").alias("original_tokens"), F.sum(delta).alias("_deltas")).filter("instances >= 2")
    template = F.element_at(F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv]), F.col("category"))
    packed = F.floor(F.length(template) / 4 + 0.5).cast("long") + F.col("_deltas")
    out = g.withColumn("compressed_tokens", packed).join(_fingerprints(instances).withColumnRenamed("category", "_c"), F.col("category") == F.col("_c"))
    ratio = F.when(F.col("original_tokens") > 0, F.round(F.col("compressed_tokens") / F.col("original_tokens"), 6)).otherwise(1.0)
    return out.select("category", "id", "instances", "original_tokens", "compressed_tokens", ratio.alias("ratio"), F.greatest(F.lit(0).cast("long"), F.col("original_tokens") - F.col("compressed_tokens")).alias("savings"))


def known_types(u: DataFrame, modules: DataFrame) -> DataFrame:
    """(type): the types that modules define or import and those that units depend on, each once."""
    own = modules.select(F.explode("defined_types").alias("t")).select(F.col("t.name").alias("type"))
    taken = modules.select(F.explode("imports").alias("t")).filter("t.is_type").select(F.col("t.name").alias("type"))
    return own.unionByName(taken).unionByName(u.select(F.explode("type_dependencies").alias("type"))).filter("type IS NOT NULL").distinct()


def type_flows(u: DataFrame, types: DataFrame) -> DataFrame:
    """(type, file_path, start_line, operation): what each unit does with each of ``types`` it names.

    A type is found as a whole identifier in the signatures or the dependencies, by an equi-join on the identifier.
    """
    names = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([A-Za-z_]\w*)"), F.lit(1))
    base = u.select("file_path", "start_line", "class", "tags", names("input_signature").alias("i"), names("output_signature").alias("o"), "type_dependencies")
    each = base.withColumn("name", F.explode(F.array_distinct(F.concat("i", "o", "type_dependencies"))))
    hit = each.join(types, F.col("name") == F.col("type"))
    i, o = F.array_contains("i", F.col("type")), F.array_contains("o", F.col("type"))
    op = T.first_label([
        (o & ~i, "produces"),
        (i & o & (F.col("class") == "transformer"), "transforms"),
        (i & (F.col("class") == "validation"), "validates"),
        (o & F.array_contains("tags", "network-io"), "serializes"),
        (i & ~o, "consumes"),
        (o, "produces"),
    ], "consumes")
    return hit.select("type", "file_path", "start_line", op.alias("operation"))


def resolved_calls(u: DataFrame) -> DataFrame:
    """(file_path, start_line, target, to_file, to_line): each call target with the first unit of its name.

    The name after the last dot counts; the first unit is that with the least path and line. Targets no unit bears
    stay with nulls.
    """
    first = u.groupBy("short").agg(F.min(F.struct("file_path", "start_line")).alias("f")).select(F.col("short").alias("_n"), F.col("f.file_path").alias("to_file"), F.col("f.start_line").alias("to_line"))
    calls = u.select("file_path", "start_line", F.explode("call_targets").alias("target")).distinct()
    return calls.join(first, F.regexp_replace("target", r"^.*\.", "") == F.col("_n"), "left").select("file_path", "start_line", "target", "to_file", "to_line")


def resolved_imports(modules: DataFrame) -> DataFrame:
    """(file_path, from_module, kind, to_file): imports resolved by the last part of their path.

    Relative imports meet the modules whose file name without extension is the same; the least path stands. What is
    neither relative nor found is external.
    """
    rows = modules.filter(F.col("file_path").isNotNull())
    base = F.regexp_replace(F.regexp_replace(F.col("file_path"), r"^.*/", ""), r"\.[^.]+$", "")
    known = rows.groupBy(base.alias("_b")).agg(F.min("file_path").alias("to_file"))
    imports = rows.select("file_path", F.explode("imports").alias("i")).select("file_path", F.col("i.from_module").alias("from_module")).filter("from_module IS NOT NULL").distinct()
    wanted = F.regexp_replace(F.regexp_replace("from_module", r"^.*[/.](?=[^/.]+(\.(js|ts))?$)", ""), r"\.(js|ts)$", "")
    joined = imports.withColumn("_w", wanted).join(known, F.col("_w") == F.col("_b"), "left")
    kind = F.when(F.col("to_file").isNotNull(), "resolved").when(F.col("from_module").startswith("."), "unresolved").otherwise("external")
    return joined.select("file_path", "from_module", kind.alias("kind"), "to_file")


def knowledge_edges(u: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst, kind, weight): what modules hold, what units call, which types they use; each edge once."""
    unit = F.concat("file_path", F.lit("#"), "name")
    holds = u.select(F.col("file_path").alias("src"), unit.alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("weight"))
    names = u.select("short", unit.alias("to"), "file_path", "start_line").groupBy("short").agg(F.min_by("to", F.struct("file_path", "start_line")).alias("to"))
    calls = u.select(unit.alias("src"), F.explode("call_targets").alias("t")).join(names, F.regexp_replace("t", r"^.*\.", "") == F.col("short")).select("src", F.col("to").alias("dst"), F.lit("calls").alias("kind"), F.lit(1.0).alias("weight"))
    types = modules.select(F.explode("defined_types").alias("t")).select(F.col("t.name").alias("type")).distinct()
    uses = u.select(unit.alias("src"), F.explode("type_dependencies").alias("t")).join(types, F.col("t") == F.col("type")).select("src", F.concat(F.lit("type:"), "t").alias("dst"), F.lit("uses-type").alias("kind"), F.lit(0.8).alias("weight"))
    return holds.unionByName(calls).unionByName(uses).groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))


def search_exports(modules: DataFrame, name: str) -> DataFrame:
    """(file_path, export, kind) of exports equal to a name or holding it in any case; the empty name takes all."""
    e = modules.select("file_path", F.explode("exports").alias("e")).select("file_path", F.col("e.name").alias("export"), "e.kind").distinct()
    return e.filter((F.col("export") == name) | F.contains(F.lower("export"), F.lit(name.lower())))


def ordered_first(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def ask(kind: str, table: DataFrame, modules: DataFrame, paths: list[str] | None = None, classes: list[str] | None = None, most: int | None = None, name: str = "") -> DataFrame:
    """One entry to the code index: units, modules, exports, patterns, flows, calls, imports or graph, under common filters.

    ``paths`` limits files, ``classes`` unit classes and ``most`` complexity; a bound of 0 counts as a bound.
    ``name`` limits exports to those that hold it.
    """
    u, m = classified(table), modules
    if paths is not None:
        u, m = u.filter(F.col("file_path").isin(paths)), m.filter(F.col("file_path").isin(paths))
    if classes is not None:
        u = u.filter(F.col("class").isin(classes))
    if most is not None:
        u = u.filter(F.col("complexity") <= most)
    answers = {
        "units": lambda: u,
        "modules": lambda: m,
        "exports": lambda: search_exports(m, name),
        "patterns": lambda: mined_patterns(u),
        "flows": lambda: type_flows(u, known_types(u, m)),
        "calls": lambda: resolved_calls(u),
        "imports": lambda: resolved_imports(m),
        "graph": lambda: knowledge_edges(u, m),
    }
    if kind not in answers:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(answers)}")
    return answers[kind]()
