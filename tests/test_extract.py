from __future__ import annotations

import pytest

from lodeworks.operators import extract
from lodeworks.sources import generated


@pytest.mark.parametrize(
    "path,text,want",
    [
        ("a.py", "class A:\n    async def f(self):\n        return '}'\n\n    def g(self): pass\n\ndef h(\n    a,\n):\n    x\n", [("A.f", "method", 2, 3, True), ("A.g", "method", 5, 5, False), ("h", "function", 7, 10, False)]),
        ("a.ts", "export class A {\r\n  m(a: B): C {\r\n    if (a) {\r\n      b('{');\r\n    }\r\n  }\r\n}\r\nexport const f = async (x) => {\r\n  return 1;\r\n};\r\n", [("A.m", "method", 2, 6, False), ("f", "function", 8, 10, True)]),
        ("a.go", "package a\n\nfunc (t *T) F(a int) int {\n\treturn 1\n}\n", [("F", "function", 3, 5, False)]),
        ("A.java", "class A {\n  public static <T> List<T> f(int a) {\n    return null;\n  }\n}\n", [("A.f", "method", 2, 4, False)]),
        ("a.md", "def f(): pass", []),
        ("a.js", "", []),
        ("a.js", "function f( {", []),
    ],
)
def test_units(path, text, want):
    assert sorted(extract.units_of(path, text), key=lambda u: u[2]) == want


def test_tables(spark):
    df = spark.createDataFrame([("/s/a.py", "def f(): pass\n"), (None, "def f(): pass"), ("/s/b.py", None)], "path string, content string")
    assert [r.name for r in extract.units(df).collect()] == ["f"]
    t = {(r.node, r.kind): r.files for r in extract.tree(df.filter("path IS NOT NULL").select("path"), 1).collect()}
    assert t == {("s", "directory"): 2}


def test_generated_rows_repeat_with_their_seed(spark):
    a, b, c = (generated.patients(spark, 20, s).collect() for s in (1, 1, 2))
    assert a == b and a != c and all(18 <= r.age <= 90 for r in a)


def test_embedding_failures_give_null(spark):
    t = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, text string")

    def embed(texts):
        if "bad" in texts:
            raise RuntimeError
        return [[1.0, float(len(x))] for x in texts]

    got = {r.key: r.vector for r in generated.embedded(t, "id", "text", embed, 2, batch=1).collect()}
    assert got == {1: [1.0, 1.0], 2: None, 3: [1.0, 0.0]}
