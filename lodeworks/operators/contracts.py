"""What modules import, export and define, taken from their texts by pattern; stacks and architectures of repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import text as T

#: Imports by language. Fixed values.
NAMED = r"""import\s+(?:type\s+)?\{([^}]+)\}\s+from\s+['"]([^'"]+)['"]"""
DEFAULT = r"""import\s+(\w+)\s+from\s+['"]([^'"]+)['"]"""
NAMESPACE = r"""import\s+\*\s+as\s+(\w+)\s+from\s+['"]([^'"]+)['"]"""
PYTHON = r"(?:from\s+([.\w]+)\s+import\s+(?:\(([^)]+)\)|([^\n]+))|import\s+([.\w]+))"
JAVA = r"import\s+(?:static\s+)?([^;]+);"
GO = r"""import\s+(?:\(([^)]+)\)|"([^"]+)")"""
#: Exports of scripts by kind. Fixed values.
EXPORTS = (
    ("function", r"export\s+(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)"),
    ("class", r"export\s+(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("interface", r"export\s+interface\s+(\w+)\s*(?:<[^>]*>)?\s*(?:extends\s+[\w,\s]+)?\s*\{"),
    ("type", r"export\s+type\s+(\w+)\s*(?:<[^>]*>)?\s*="),
    ("enum", r"export\s+(?:const\s+)?enum\s+(\w+)"),
    ("constant", r"export\s+(?:default\s+)?(?:const|let|var)\s+(\w+)"),
)
PYTHON_EXPORT = r"(?:def|class)\s+(\w+)"
JAVA_EXPORT = r"(?:public|protected)\s+(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)"
#: Types of typed scripts by kind, with their bodies. Fixed values.
TYPES = (
    ("interface", r"(?:export\s+)?interface\s+(\w+)\s*(?:<([^>]+)>)?\s*(?:extends\s+([^{]+))?\s*\{([^}]*)\}"),
    ("type", r"(?:export\s+)?type\s+(\w+)\s*(?:<([^>]+)>)?\s*=\s*([^;]+)"),
    ("enum", r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)\s*\{([^}]*)\}"),
)
METHOD, PROPERTY = r"^(\w+)\s*\(([^)]*)\)\s*(?::\s*(.+?))?$", r"^(?:readonly\s+)?(\w+)(\??)\s*:\s*(.+)$"
_EDGE = r"^\s+|\s+$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def _last_name(c: Column) -> Column:
    return _trim(F.regexp_replace(c, r"^[\s\S]*\sas\s+", ""))


def imports(files: DataFrame) -> DataFrame:
    """(path, name, source, kind), each once: named, type, default, namespace, python, java and go imports of (path, content)."""
    ext = T.extension(F.col("path"))
    f = files.filter(F.col("content").isNotNull()).select("path", "content", ext.alias("e"))
    script = F.col("e").isin("ts", "tsx", "js", "jsx")
    hits = lambda rows, p: rows.select("path", F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(0))).alias("m"))
    group = lambda p, i: F.regexp_extract("m", p, i)
    rows = f.filter(script)
    named = hits(rows, NAMED).select("path", F.explode(F.split(group(NAMED, 1), ",")).alias("n"), group(NAMED, 2).alias("source"), F.when(F.contains("m", F.lit("import type")), "type").otherwise("named").alias("kind"))
    parts = [named.select("path", _last_name(F.concat(F.lit(" "), _trim(F.col("n")))).alias("name"), "source", "kind")]
    parts.append(hits(rows, DEFAULT).select("path", group(DEFAULT, 1).alias("name"), group(DEFAULT, 2).alias("source"), F.lit("default").alias("kind")).filter("name <> 'type'"))
    parts.append(hits(rows, NAMESPACE).select("path", group(NAMESPACE, 1).alias("name"), group(NAMESPACE, 2).alias("source"), F.lit("namespace").alias("kind")))
    py = hits(f.filter("e = 'py'"), PYTHON).select("path", F.concat(group(PYTHON, 1), group(PYTHON, 4)).alias("source"), F.concat(group(PYTHON, 2), group(PYTHON, 3)).alias("listed"))
    py = py.select("path", "source", F.explode(F.when(F.col("listed") != "", F.split("listed", ",")).otherwise(F.array("source"))).alias("n"))
    parts.append(py.select("path", _last_name(F.concat(F.lit(" "), _trim(F.col("n")))).alias("name"), "source", F.lit("python").alias("kind")))
    java = hits(f.filter("e = 'java'"), JAVA).select("path", _trim(group(JAVA, 1)).alias("source"))
    parts.append(java.select("path", F.regexp_replace("source", r"^.*\.", "").alias("name"), "source", F.lit("java").alias("kind")))
    go = hits(f.filter("e = 'go'"), GO).select("path", F.explode(F.split(F.concat(group(GO, 1), group(GO, 2)), "\n")).alias("l"))
    go = go.select("path", F.replace(_trim(F.col("l")), F.lit('"'), F.lit("")).alias("source")).filter("source <> '' AND NOT startswith(source, '//')")
    parts.append(go.select("path", F.regexp_replace("source", "^.*/", "").alias("name"), "source", F.lit("go").alias("kind")))
    return reduce(DataFrame.unionByName, parts).filter("name <> ''").distinct()


def exports(files: DataFrame) -> DataFrame:
    """(path, name, kind, is_async, is_default), each name and kind once; a constant only where no other kind has the name."""
    f = files.filter(F.col("content").isNotNull()).select("path", "content", T.extension(F.col("path")).alias("e"))
    script = f.filter(F.col("e").isin("ts", "tsx", "js", "jsx"))
    pick = lambda rows, p: rows.select("path", F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(0))).alias("m")).withColumn("name", F.regexp_extract("m", p, 1))
    has = lambda w: F.contains("m", F.lit(w))
    flags = [has("async").alias("is_async"), has("default").alias("is_default")]
    found = [pick(script, p).select("path", "name", F.lit(k).alias("kind"), F.lit(i).alias("rank"), *flags) for i, (k, p) in enumerate(EXPORTS)]
    py = pick(f.filter("e = 'py'"), PYTHON_EXPORT).filter(~F.col("name").startswith("_"))
    found.append(py.select("path", "name", F.when(F.col("m").startswith("class"), "class").otherwise("function").alias("kind"), F.lit(0).alias("rank"), F.lit(False).alias("is_async"), F.lit(False).alias("is_default")))
    java = pick(f.filter("e = 'java'"), JAVA_EXPORT)
    found.append(java.select("path", "name", T.first_label([(has("interface"), "interface"), (has("enum"), "enum")], "class").alias("kind"), F.lit(0).alias("rank"), F.lit(False).alias("is_async"), F.lit(False).alias("is_default")))
    every = reduce(DataFrame.unionByName, found).groupBy("path", "name", "kind").agg(F.min("rank").alias("rank"), F.bool_or("is_async").alias("is_async"), F.bool_or("is_default").alias("is_default"))
    other = every.filter("kind <> 'constant'").select(F.col("path").alias("_p"), F.col("name").alias("_n")).distinct()
    joined = every.join(other, (F.col("path") == F.col("_p")) & (F.col("name") == F.col("_n")), "left")
    return joined.filter("kind <> 'constant' OR _p IS NULL").select("path", "name", "kind", "is_async", "is_default")


def types(files: DataFrame) -> DataFrame:
    """(path, name, kind, bases, generics, properties, methods), each once: interfaces, aliases and enums of typed scripts with the sizes of their parts."""
    f = files.filter(F.col("content").isNotNull() & T.extension(F.col("path")).isin("ts", "tsx")).select("path", "content")
    count = lambda c: F.when(c != "", F.size(F.split(c, ","))).otherwise(0)
    parts = []
    for kind, p in TYPES:
        g = lambda i, p=p: F.regexp_extract("m", p, i)
        m = f.select("path", F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(0))).alias("m"))
        if kind == "interface":
            lines = F.transform(F.split(g(4), "\n"), lambda line: F.regexp_replace(_trim(line), "[,;]$", ""))
            kept = F.filter(lines, lambda line: (line != "") & ~line.startswith("//") & ~line.startswith("/*"))
            methods = F.size(F.filter(kept, lambda line: line.rlike(METHOD)))
            properties = F.size(F.filter(kept, lambda line: ~line.rlike(METHOD) & line.rlike(PROPERTY)))
            parts.append(m.select("path", g(1).alias("name"), F.lit(kind).alias("kind"), count(g(3)).alias("bases"), count(g(2)).alias("generics"), properties.alias("properties"), methods.alias("methods")))
        elif kind == "type":
            parts.append(m.select("path", g(1).alias("name"), F.lit(kind).alias("kind"), F.lit(0).alias("bases"), count(g(2)).alias("generics"), F.lit(0).alias("properties"), F.lit(0).alias("methods")))
        else:
            members = F.size(F.filter(F.split(g(2), ","), lambda x: _trim(F.regexp_replace(x, "=[\\s\\S]*$", "")) != ""))
            parts.append(m.select("path", g(1).alias("name"), F.lit(kind).alias("kind"), F.lit(0).alias("bases"), F.lit(0).alias("generics"), members.alias("properties"), F.lit(0).alias("methods")))
    return reduce(DataFrame.unionByName, parts).distinct()


def contracts(files: DataFrame) -> DataFrame:
    """(path, imports_n, exports_n, types_n): how much each file takes, gives and defines; files without any have zeros."""
    n = lambda df, name: df.groupBy(F.col("path").alias(f"_{name}")).agg(F.count(F.lit(1)).alias(name))
    out = files.select("path").distinct()
    for df, name in ((imports(files), "imports_n"), (exports(files), "exports_n"), (types(files), "types_n")):
        out = out.join(n(df, name), F.col("path") == F.col(f"_{name}"), "left").drop(f"_{name}")
    return out.na.fill(0, ["imports_n", "exports_n", "types_n"])


#: Architectures: path pattern, name, evidence, least pieces of evidence. Fixed values.
ARCHITECTURES = (
    (r"(?i)src/(controllers?|routes?)/", "MVC", ("controllers/", "routes/"), 1),
    (r"(?i)src/(models?|views?|controllers?)/", "MVC", ("models/", "views/", "controllers/"), 2),
    (r"(?i)src/(entities?|use-?cases?|adapters?)/", "Clean Architecture", ("entities/", "use-cases/", "adapters/"), 2),
    (r"(?i)src/(domain|application|infrastructure|presentation)/", "DDD", ("domain/", "application/", "infrastructure/"), 2),
    (r"(?i)src/pages/", "Next.js Pages", ("pages/", "api/", "components/"), 2),
    (r"(?i)src/app/", "Next.js App Router", ("app/", "components/"), 1),
    (r"(?i)(cmd|internal|pkg)/", "Go Standard", ("cmd/", "internal/", "pkg/"), 1),
    (r"(?i)(packages|libs)/", "Monorepo", ("packages/", "libs/"), 1),
    (r"(?i)(microservices?|services?/[\w-]+/src)/", "Microservices", ("services/",), 1),
    (r"(?i)src/(handlers?|server)\.ts", "MCP Server", ("server.ts", "handlers/", "registry.ts"), 1),
)


def architectures(nodes: DataFrame) -> DataFrame:
    """(repo, rule, name, evidence, confidence) of the directory nodes (repo, node): one row per rule that a repository fits.

    Confidence grows with the nodes that fit and the pieces of evidence, to 0.95. One pass, whatever the rules.
    """
    node = F.col("node")
    sums = [F.sum(node.rlike(p).cast("long")).alias(f"n{i}") for i, (p, *_) in enumerate(ARCHITECTURES)]
    seen = [F.bool_or(F.contains(node, F.lit(e))).cast("int").alias(f"e{i}_{k}") for i, (_, _, ev, _) in enumerate(ARCHITECTURES) for k, e in enumerate(ev)]
    g = nodes.groupBy("repo").agg(*sums, *seen)
    rows = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(name).alias("name"), F.col(f"n{i}").alias("fits"), sum([F.col(f"e{i}_{k}") for k in range(1, len(ev))], F.col(f"e{i}_0")).alias("evidence"), F.lit(least).alias("least")) for i, (_, name, ev, least) in enumerate(ARCHITECTURES)])
    each = g.select("repo", F.inline(rows)).filter("fits > 0 AND evidence >= least")
    return each.select("repo", "rule", "name", "evidence", F.round(F.least(F.lit(0.95), 0.5 + F.col("fits") * 0.05 + F.col("evidence") * 0.1), 2).alias("confidence"))


#: Technologies by what a manifest names: pattern, name, category. Fixed values.
TECHNOLOGIES = (
    ('(?i)"react"', "React", "framework"), ('(?i)"vue"', "Vue", "framework"), ('(?i)"angular"', "Angular", "framework"), ('(?i)"next"', "Next.js", "framework"),
    ('(?i)"express"', "Express", "framework"), ('(?i)"fastify"', "Fastify", "framework"), ('(?i)"nestjs"', "NestJS", "framework"), ('(?i)"svelte"', "Svelte", "framework"),
    ('(?i)"prisma"', "Prisma", "tool"), ('(?i)"typeorm"', "TypeORM", "tool"), ('(?i)"mongoose"', "Mongoose", "tool"), ('(?i)"sequelize"', "Sequelize", "tool"),
    ('(?i)"jest"', "Jest", "tool"), ('(?i)"vitest"', "Vitest", "tool"), ('(?i)"tailwindcss"', "TailwindCSS", "tool"), ('(?i)"zod"', "Zod", "library"),
    ('(?i)"axios"', "Axios", "library"), ('(?i)"pino"', "Pino", "library"), ('(?i)"ioredis"', "ioredis", "library"), ("(?i)@modelcontextprotocol", "MCP SDK", "library"),
    ("(?i)django", "Django", "framework"), ("(?i)flask", "Flask", "framework"), ("(?i)fastapi", "FastAPI", "framework"), ("(?i)pydantic", "Pydantic", "library"),
    ("(?i)sqlalchemy", "SQLAlchemy", "tool"), ("(?i)pytest", "pytest", "tool"), ("(?i)numpy", "NumPy", "library"), ("(?i)pandas", "Pandas", "library"),
    ("(?i)torch", "PyTorch", "library"), ("(?i)tensorflow", "TensorFlow", "library"),
)


def technologies(manifests: DataFrame) -> DataFrame:
    """(repo, name, category, confidence) of manifests (repo, file, content): package.json, requirements.txt, go.mod, Cargo.toml.

    A dependency of package.json counts where its name holds the technology's or fits its pattern (0.95), a line of
    requirements where it is the name (0.9), other manifests where their text fits the pattern (0.9); the surest stands.
    """
    m = manifests.filter(F.col("content").isNotNull())
    package = m.filter("file = 'package.json'")
    keys = F.concat(*[F.coalesce(F.json_object_keys(F.get_json_object("content", f"$.{k}")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies", "peerDependencies")])
    deps = package.select("repo", F.explode(keys).alias("dep"))
    lines = m.filter("file = 'requirements.txt'").select("repo", F.explode(F.split("content", "\n")).alias("l")).select("repo", F.lower(F.regexp_replace(F.regexp_replace("l", "#.*$", ""), r"\s|==.*$", "")).alias("dep"))
    texts = m.filter(F.col("file").isin("go.mod", "Cargo.toml"))
    what = lambda fits, sure: F.array_compact(F.array(*[F.when(fits(p, n), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(sure).alias("confidence"))) for p, n, c in TECHNOLOGIES]))
    a = deps.select("repo", F.inline(what(lambda p, n: F.contains(F.lower("dep"), F.lit(n.lower())) | F.col("dep").rlike(p), 0.95)))
    b = lines.select("repo", F.inline(what(lambda p, n: F.col("dep") == n.lower(), 0.9)))
    c = texts.select("repo", F.inline(what(lambda p, n: F.col("content").rlike(p), 0.9)))
    return a.unionByName(b).unionByName(c).groupBy("repo", "name", "category").agg(F.max("confidence").alias("confidence"))
