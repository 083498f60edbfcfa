from __future__ import annotations

import pytest

from lodeworks.llm import docpairs as D


def words(path, text, line, name):
    kind, doc = D.Source(path, text).documentation(line)
    return (kind, D.word_count(doc, name)) if kind else ("", 0)


CASES = [
    ("a.py", "@d(1)\ndef f(a,\n      b={'x': ':'}):\n    # note\n    '''Adds every row of the table once.\n\n    Args:\n        a: first thing of many words here\n    '''\n    return 1\n", 2, "f", ("docstring", 7)),
    ("a.py", "# Adds every row of the table once.\n@d\n# noqa: E501\ndef f(): pass\n", 4, "f", ("comment", 7)),
    ("a.py", "# Adds every row of the table once.\n\ndef f(): pass\n", 3, "f", ("", 0)),
    ("a.py", "def f():\n    x = '''Adds every row of the table once.'''\n", 1, "f", ("", 0)),
    ("a.ts", "/** Adds every row.\n * @param x many words of a parameter\n *   and more of them\n * @returns the sum of all of them\n */\nfunction f() {}\n", 6, "f", ("comment", 3)),
    ("a.ts", "// Adds every row of the table.\n// eslint-disable-next-line max-len\nexport const f = () => 1;\n", 3, "f", ("comment", 6)),
    ("a.js", "const t = `\n// Adds every row of the table.\n`;\nfunction f() {}\n", 4, "f", ("", 0)),
    ("a.js", "let x = 1; // Adds every row of the table once.\nfunction f() {}\n", 2, "f", ("", 0)),
    ("a.js", "// const x = f(rows, 3); return x;\nfunction f() {}\n", 2, "f", ("comment", 0)),
    ("A.java", "class A {\n  // TODO describe all of this at length\n  @Deprecated\n  @S({\"a\",\n    \"b\"})\n  public int f(int a) { return a; }\n}\n", 6, "A.f", ("comment", 0)),
    ("a.go", "// Route_all routes every row to the ward.\n//go:noinline\nfunc RouteAll() {}\n", 3, "RouteAll", ("comment", 6)),
]


@pytest.mark.parametrize("path,text,line,name,want", CASES)
def test_documentation(path, text, line, name, want):
    assert words(path, text, line, name) == want
    assert words(path, text.replace("\n", "\r\n"), line, name) == want


def test_extent_follows_braces_and_indents():
    s = D.Source("a.ts", "function f(a: { b: string } = { b: '}' }) {\n  if (a) { g('{'); }\n}\nlet x = 1;\n")
    a, _, b = s.extent(1)
    assert s.text[a:b].endswith("g('{'); }\n}")
    p = D.Source("a.py", "def f(x):\n    if x:\n        y\n\n    return 1\nz = 2\n")
    a, _, b = p.extent(1)
    assert p.text[a:b].strip().endswith("return 1")


def test_table(spark):
    text = "def f():\n    '''Adds every row of the table once.'''\n"
    contents = spark.createDataFrame([("/a.py", text, 1), ("/b.py", None, 1), ("/c.py", "", 1), ("/d.py", "x = 1\n" * 30_000 + text, 1)], "path string, content string, name int")
    units = spark.createDataFrame([("/a.py", 1, "f", 0), ("/a.py", 1, None, 0), ("/a.py", None, "f", 0), (None, 1, "f", 0), ("/a.py", 99, "f", 0), ("/b.py", 1, "f", 0), ("/x.py", 1, "f", 0), ("/d.py", 30_001, "f", 0)], "file_path string, start_line long, name string, path int")
    assert sorted((r.file_path, r.start_line) for r in D.pairs(units, contents).collect()) == [("/a.py", 1), ("/d.py", 30_001)]
    assert D.pairs(units.limit(0), contents).count() == 0 and D.pairs(units, contents.limit(0)).count() == 0


def test_long_annotations_stand_between():
    listed = "".join(f"    name{i} = {{\"a\", \"b\"}},\n" for i in range(90))
    text = f"class A {{\n  // Adds the given dose to the running total of the ward.\n  @Rule(\n{listed}  )\n  void add(int dose) {{\n  }}\n\n  // Some words that belong to a call and to nothing else.\n  int x = f(\n    1\n  );\n  void sub(int dose) {{\n  }}\n}}\n"
    source = D.Source("/a.java", text)
    lines = text.split("\n")
    at = next(i for i, r in enumerate(lines) if "void add" in r) + 1
    assert source.documentation(at)[0] == "comment" and D.word_count(source.documentation(at)[1], "A.add") >= 5
    assert source.documentation(next(i for i, r in enumerate(lines) if "void sub" in r) + 1) == ("", [])
