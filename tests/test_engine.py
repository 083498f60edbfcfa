"""Operators on small hand-worked cases: values that follow from the rules, not from the queries' SQL."""

from __future__ import annotations

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.operators import codeintel as C
from lodeworks.operators import contracts as K
from lodeworks.operators import documents as D
from lodeworks.operators import extract
from lodeworks.operators import graph as G
from lodeworks.operators import operations as O
from lodeworks.operators import resolution as R
from lodeworks.operators import store as S
from lodeworks.operators import writes as W
from lodeworks.operators.index_store import IndexStore
from lodeworks.sources import files, settings

UNIT = "file_path string, name string, kind string, start_line long, end_line long, complexity long, is_async boolean, is_exported boolean, signature string, input_signature string, output_signature string, call_targets array<string>, type_dependencies array<string>, side_effects array<string>, body string"


def unit(path, name, line=1, complexity=1, is_async=False, sig="s", i="", o="", calls=(), types=(), effects=()):
    return (path, name, "function", line, line + 1, complexity, is_async, True, sig, i, o, list(calls), list(types), list(effects), "")


def test_mined_patterns_by_hand(spark):
    rows = [
        unit("/a.ts", "createDose", complexity=7, is_async=True, sig="12345678", effects=["network-request"], calls=["a", "b"]),
        unit("/b.ts", "getDose", sig="1234"),
        unit("/b.ts", "getDose", sig="1234"),  # a repeated row
        unit("/c.ts", "helper", i="A", o="B"),
        unit("/d.ts", "other"),
    ]
    u = C.classified(spark.createDataFrame(rows, UNIT))
    got = {r.category: r for r in C.mined_patterns(u).collect()}
    lines = sorted(["/a.ts::createDose|async,network-io,complexity:7", "/b.ts::getDose|"])
    crud = got["crud"]
    assert crud.id == "pattern:crud:" + hashlib.sha1("\n".join(lines).encode()).hexdigest()[:12]
    # 8 + 15 + 3 signs are 26 / 4, rounded half up 7; 4 signs are 1
    assert (crud.instances, crud.original_tokens) == (2, 8)
    # the template has 135 signs, 34 tokens; the deltas 29 signs, 7 tokens; two instances at 8
    assert len(C.TEMPLATES["crud"]) == 135 and crud.compressed_tokens == 34 + 7 + 8 + 8
    assert crud.savings == 0 and crud.ratio == round(57 / 8, 6)
    lines = sorted(["/c.ts::helper|A\u2192B", "/d.ts::other|\u2192"])
    assert got["utility"].id == "pattern:utility:" + hashlib.sha1("\n".join(lines).encode()).hexdigest()[:12]
    sure = {(r.category, r.name): r.confidence for r in C.pattern_instances(u).collect()}
    assert sure["utility", "helper"] == 0.95 and sure["crud", "getDose"] == 0.8


def test_call_cascade(spark):
    rows = [unit("/a.ts", "Store.save", 3), unit("/a.ts", "Store.load", 9), unit("/b.ts", "run", 1, calls=["save", "store.save", "store.drop", "nothing.at", "run", "Store.load"])]
    got = {r.target: (r.step, r.to_line) for r in R.call_cascade(C.units(spark.createDataFrame(rows, UNIT))).collect()}
    assert got == {"save": ("unresolved", None), "store.save": ("method", 3), "store.drop": ("class", 3), "nothing.at": ("unresolved", None), "run": ("name", 1), "Store.load": ("name", 9)}


MODULE = "file_path string, module_name string, imports array<struct<name:string,from_module:string,is_type:boolean,is_default:boolean,is_namespace:boolean>>"


def modules(spark, *specs):
    paths = ["/srv/ws/r/src/a.ts", "/srv/ws/r/src/lib/b.ts", "/srv/ws/r/src/lib/index.ts", "/srv/ws/r/src/util.js"]
    rows = [(p, p, [(f"n{k}", s, False, False, False) for k, s in enumerate(specs)] if k == 0 else []) for k, p in enumerate(paths)]
    return spark.createDataFrame([*rows, (None, "x", [])], MODULE)


def test_import_cascade(spark):
    specs = ["node:fs", "path", "./lib/b", "./lib", "../src/./util.js", "@/lib/b", "./gone", "react", "", "../../../../../../x"]
    got = {r.spec: (r.kind, r.to_file) for r in R.import_cascade(modules(spark, *specs), {"@/": "src/"}, "^(/srv/ws/[^/]+)").collect()}
    assert got == {
        "node:fs": ("builtin", None), "path": ("builtin", None), "./lib/b": ("relative", "/srv/ws/r/src/lib/b.ts"), "./lib": ("relative", "/srv/ws/r/src/lib/index.ts"),
        "../src/./util.js": ("relative", "/srv/ws/r/src/util.js"), "@/lib/b": ("alias", "/srv/ws/r/src/lib/b.ts"), "./gone": ("fallback", "/srv/ws/r/src/gone"),
        "react": ("unresolved", None), "": ("unresolved", None), "../../../../../../x": ("fallback", "/x"),
    }


def test_suffix_imports(spark):
    got = {r.spec: r.to_file for r in R.suffix_imports(modules(spark, "./lib/b", "b", "./b.js", "lib", "ib/b", "..\\lib\\b")).collect()}
    b, index = "/srv/ws/r/src/lib/b.ts", "/srv/ws/r/src/lib/index.ts"
    assert got == {"./lib/b": b, "b": b, "./b.js": b, "lib": index, "ib/b": None, "..\\lib\\b": b}


def test_subgraph_directions(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x"), ("d", "a", "x"), ("z", "a", "x")], "src string, dst string, kind string")
    seed = spark.createDataFrame([("a",)], "node string")
    part = lambda way, p: {r.a for r in R.subgraph(e, seed, 2, way).collect() if r.part == p}
    assert part("forward", "node") == {"a", "b", "c"} and part("forward", "boundary") == {"d"}
    assert part("reverse", "node") == {"a", "d", "z", "c"} and part("reverse", "boundary") == {"b"}
    assert part("both", "node") == {"a", "b", "c", "d", "z"} and part("both", "boundary") == set()
    with pytest.raises(ValueError):
        R.subgraph(e, seed, 2, "up")


def test_cycle_nodes_against_brute_force(spark):
    rng = random.Random(5)
    for n in (6, 14):
        edges = {(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(n + 3)}
        reach = {v: {b for a, b in edges if a == v} for v in map(str, range(n))}
        for _ in range(n):
            reach = {v: r | {y for x in r for y in reach[x]} for v, r in reach.items()}
        want = {v for v in reach if v in reach[v]}
        df = spark.createDataFrame(sorted(edges), "src string, dst string")
        assert {r.node for r in G.on_cycles(df).collect()} == want
    assert G.on_cycles(df.limit(0)).count() == 0


def test_document_outcomes_in_order(spark):
    docs = spark.createDataFrame([("k", '{"id":"k"}')], "key string, doc string")
    ops = [(1, "k", "read", None), (2, "k", "delete", None), (3, "k", "read", None), (4, "k", "create", '{"n":1}'), (5, "k", "update", '{"id":"k","n":2}'), (6, "k", "read", None), (7, "m", "delete", None), (8, "m", "fold", None), (9, "m", "create", '{"id":"m"}')]
    o = W.document_outcomes(docs, spark.createDataFrame(ops, "seq int, key string, op string, doc string"))
    assert {r.seq: r.error for r in o.collect()} == {1: None, 2: None, 3: "not found", 4: "no id", 5: None, 6: None, 7: None, 8: "unknown op", 9: None}
    assert {(r.key, r.doc) for r in W.store_after(docs, o).collect()} == {("k", '{"id":"k","n":2}'), ("m", '{"id":"m"}')}
    assert {(r.seq, r.message) for r in W.document_versions(o).collect()} == {(2, "File deleted"), (5, "update"), (9, "create")}


def test_writes_and_appends(spark):
    current = spark.createDataFrame([("/a", "old"), ("/b", None), ("/c", "same")], "path string, content string")
    key = "AKIA" + "ABCDEFGH12345678"
    batch = spark.createDataFrame([("/a", "new"), ("/b", f"k = {key}"), ("/c", "same"), ("/d", "x" * 50), ("/e", None)], "path string, content string")
    got = {r.path: (r.outcome, r.versioned) for r in W.written(current, batch, 40).collect()}
    assert got == {"/a": ("changed", True), "/b": ("secret", False), "/c": ("unchanged", False), "/d": ("too large", False), "/e": ("created", False)}
    more = {r.path: (r.outcome, r.content) for r in W.appended(current, batch, True).collect()}
    assert more["/a"] == ("appended", "oldnew") and more["/b"][0] == "secret" and more["/d"] == ("created", "x" * 50)
    secret = spark.createDataFrame([("/new", f"k = {key}")], "path string, content string")
    assert W.appended(current, secret, True).first().outcome == "created" and W.appended(current, secret, False).first().outcome == "not found"


def test_nested_search(spark):
    docs = spark.createDataFrame([(1, '{"a":["x",null,{"k":1}],"b":{"k":1}}'), (2, '{"a":null,"_a":"x,,[object Object]","b":"{k}"}'), (3, '{"a":7}'), (4, "broken")], "id int, doc string")
    ids = lambda **p: {r.id for r in D.search(docs, "doc", p).collect()}
    assert ids(a="x,,[object Object]") == {1, 2} and ids(b="[object Object]") == {1} and ids(a="7") == {3} and ids() == {1, 2, 3, 4}


def test_two_level_bucket(spark):
    rows = [("m", "a", f"2024-01-01 00:00:{s:02d}", i) for i, s in enumerate([0, 0, 0, 0, 5])] + [("m", "b", "2024-01-01 00:00:00", 9)]
    df = spark.createDataFrame(rows, "lim string, tool string, ts string, i int").withColumn("ts", F.to_timestamp("ts"))
    got = {r.tool: (r.allowed, r.blocked, r.refunded) for r in O.two_level_bucket(df, "lim", "tool", "ts", (10, 0), (2, 0.2), {"b": 9}).collect()}
    # a: two at once, two blocked after the common bucket had paid; after five seconds one more; b costs more than it holds
    assert got == {"a": (3, 2, 2), "b": (0, 1, 0)}


def test_cache_replay(spark):
    seq = [("a", 0), ("a", 5), ("b", 6), ("c", 7), ("a", 8), ("d", 9), ("b", 10), ("a", 12), ("a", 30)]
    df = spark.createDataFrame([("u", k, f"2024-01-01 00:00:{t:02d}", t) for k, t in seq], "c string, k string, ts string, i int").withColumn("ts", F.to_timestamp("ts"))
    r = O.cache_replay(df, "c", "k", "ts", "i", 11, 3).first()
    # a hits at 5 and 8; d puts out b; b puts out c; a is too old at 12 and at 30
    assert (r.hits, r.misses, r.expired, r.evicted) == (2, 7, 2, 2)


def test_index_store_keeps_other_files(spark, tmp_path):
    s = IndexStore(spark, str(tmp_path / "i"), "path", 4)
    assert s.read() is None
    rows = lambda *r: spark.createDataFrame(list(r), "path string, n int")
    s.replace(rows(("a", 1), ("a", 2), ("b", 1), ("c", 1)))
    s.replace(rows(("a", 9)), rows(("c", 0)))
    assert sorted(map(tuple, s.read().collect())) == [("a", 9), ("b", 1)]
    s.replace(rows(("c", 5)))
    assert sorted(map(tuple, s.read().collect())) == [("a", 9), ("b", 1), ("c", 5)]


def test_settings_and_policies(spark, tmp_path):
    got = settings.merged({"a": {"b": 1}, "safe.on": True}, {"a": {"c": 2}}, {"X_A_B": "[3]", "X_SAFE_ON": "false", "X_NEW": "1"}, "X_", ("safe.on",))
    assert got == {"a.b": ([3], "environment"), "safe.on": (True, "default"), "a.c": (2, "file")}
    default = [("**", "user", ["read"])]
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "good.json").write_text('[{"pattern": "/x/**", "role": "admin", "permissions": ["read", "write"]}]')
    for name, want in (("none.json", "user"), ("bad.json", "user"), ("good.json", "admin")):
        assert [r.role for r in settings.policies(spark, str(tmp_path / name), default).collect()] == [want]


def test_children_of_a_folder(spark):
    rows = [("/r/a/x.py", 1, 1), ("/r/a/b/y.py", 2, 5), ("/r/z.ts", 3, 2), ("/r/.env", 4, 2), ("/q/m.py", 5, 2)]
    got = [(r.name, r.kind, r["size"], r.language, r.place) for r in files.children(spark.createDataFrame(rows, "path string, size int, modified int"), "/r").orderBy("place").collect()]
    assert got == [("a", "directory", 3, None, 1), ("z.ts", "file", 3, "typescript", 2)]


def test_contracts(spark):
    ts = "import type { A, B as C } from './a';\nimport D from 'd';\nimport * as E from \"e\";\nexport async function f(x: A) {}\nexport const f = 1, g = 2;\nexport const h = 3;\nexport interface I<T> extends J, K {\n  a: T;\n  readonly b?: string;\n  m(x: T): void;\n  // note\n}\nexport enum Q { X = 1, Y }\n"
    py = "from a.b import (c, d as e)\nimport os\nclass K:\n    def _p(self): pass\n    def q(self): pass\n"
    go = 'import (\n\t"fmt"\n\t// no\n\t"x/y"\n)\n'
    df = spark.createDataFrame([("/a.ts", ts), ("/b.py", py), ("/c.go", go), ("/d.java", "import static a.B.c;\nprotected abstract class Z {}"), ("/e.ts", None)], "path string, content string")
    i = {(r.path, r.name, r.source, r.kind) for r in K.imports(df).collect()}
    assert i == {("/a.ts", "A", "./a", "type"), ("/a.ts", "C", "./a", "type"), ("/a.ts", "D", "d", "default"), ("/a.ts", "E", "e", "namespace"), ("/b.py", "c", "a.b", "python"), ("/b.py", "e", "a.b", "python"), ("/b.py", "os", "os", "python"), ("/c.go", "fmt", "fmt", "go"), ("/c.go", "y", "x/y", "go"), ("/d.java", "c", "a.B.c", "java")}
    x = {(r.path, r.name, r.kind) for r in K.exports(df).collect()}
    assert x == {("/a.ts", "f", "function"), ("/a.ts", "h", "constant"), ("/a.ts", "I", "interface"), ("/a.ts", "Q", "enum"), ("/b.py", "K", "class"), ("/b.py", "q", "function"), ("/d.java", "Z", "class")}
    t = {(r.name, r.bases, r.generics, r.properties, r.methods) for r in K.types(df).collect()}
    assert t == {("I", 2, 1, 2, 1), ("Q", 0, 0, 2, 0)}
    assert K.contracts(df).count() == 5


def test_technologies(spark):
    rows = [("r", "package.json", '{"dependencies": {"react": "^18"}, "devDependencies": {"vitest": "1"}}'), ("r", "requirements.txt", "numpy==2.0 # x\npandas\nrequests\n"), ("r", "go.mod", "module x\nrequire tensorflow v1\n"), ("q", "package.json", "broken")]
    got = {(r.name, r.confidence) for r in K.technologies(spark.createDataFrame(rows, "repo string, file string, content string")).collect()}
    assert got == {("React", 0.95), ("Vitest", 0.95), ("NumPy", 0.9), ("Pandas", 0.9), ("TensorFlow", 0.9)}


def test_measures_of_scripts():
    n, calls, types = extract.measures("if (a && b) { for (const x of y) x?.go(a ?? b); } switch (c) { case 1: f(g()); case 2: return d ? e : new H(); } let v: Map<K, V> = z as W;")
    assert n == 1 + 2 + 1 + 2 + 2 + 1  # if and &&, for, ?. and ??, two cases, the conditional
    assert calls == ["x?.go", "f", "g", "H"] and types == ["Map", "K", "V", "W"]


def test_hashes_of_ngrams_follow_from_words():
    words = ["dose", "x" * 3_000, "\U0001f600a", "ledger"] * 6
    h = T.Hashed([words, [], ["one"]])
    plain = lambda t: __import__("functools").reduce(lambda a, c: (a * 31 + ord(c)) & 0xFFFFFFFF, t, 0)
    assert all(int(x) == plain(h.term(k)) for k, x in enumerate(h.hashes))
    assert (h.size == 3).sum() == 22 and abs((h.rows[0] ** 2).sum() - 1) < 1e-9 and not h.rows[1].any()


def test_tokens_keep_their_first_revocation(spark):
    t = spark.sql("SELECT 1 AS user_id, 'guest' AS role, timestamp_ntz'2024-01-01' AS revoked_at UNION ALL SELECT 2, 'guest', NULL UNION ALL SELECT 3, 'user', NULL")
    got = {r.user_id: str(r.revoked_at) for r in S.revoked(t, F.col("role") == "guest", F.lit("2024-02-02").cast("timestamp_ntz")).collect()}
    assert got == {1: "2024-01-01 00:00:00", 2: "2024-02-02 00:00:00", 3: "None"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_units_taken_from_texts_agree_with_the_parser(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/extracted_units.parquet").select("file_path", "name", "start_line", "end_line").distinct()
    have = given.select(F.col("file_path").alias("_f")).distinct()
    mine = extract.units(spark.read.parquet("/root/testdata/sf0.01/file_contents.parquet")).join(have, F.col("file_path") == F.col("_f"), "left_semi").select(*given.columns)
    assert mine.exceptAll(given).count() == 0 and given.exceptAll(mine).count() == 0


def test_rolling_means_in_blocks(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aaab"), rng.randrange(60), i, rng.random() if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at int, i int, v double")
    whole, cut_up = ({r.i: (r.rolling_mean and round(r.rolling_mean, 9), r.rolling_n) for r in O.rolling(df, "k", "v", "at", "i", 7, c).collect()} for c in (10_000, 20))
    assert whole == cut_up and len(whole) == 400
