from __future__ import annotations

import pytest

from lodeworks.llm import handwritten as H

OWN = r"copyright [\w\- ]*workspace contributors"
BODY = "import x from 'y';\n\nexport function f(a) {\n  return a + 1;\n}\n" * 4
MIN = "".join(f"function a{i}(b){{for(var c=0;c<b.length;c++)d=b[c]^{i};return d}}" for i in range(12))


@pytest.mark.parametrize(
    "path,text,kind",
    [
        ("/s/w/r/a.ts", "// AUTO-GENERATED FILE - revision 1.2 - do not modify by hand\n" + BODY, "generated"),
        ("/s/w/r/a.go", "// Code generated by schemagen 1.1. DO NOT EDIT.\npackage a\n", "generated"),
        ("/s/w/r/a.ts", "// own\n\n// source: triage.proto, plugin ts-stub 6.14\n" + BODY, "generated"),
        ("/s/w/r/a.py", "# This helper writes the generated audit stubs; it is maintained by hand.\nx = 1\n", ""),
        ("/s/w/r/a.ts", "// Do not edit the order of these guards without the vital guild.\n" + BODY, ""),
        ("/s/w/r/a.js", "/*!\n * kv v1.2.3\n * (c) the kv authors, released under the MIT licence\n */\n" + BODY, "vendored"),
        ("/s/w/r/a.js", "// Copyright CareHub workspace contributors.\n" + BODY, ""),
        ("/s/w/r/a.js", MIN, "minified"),
        ("/s/w/r/a.ts", "// " + "word " * 200 + "\n" + BODY, ""),
        ("/s/w/r/t.py", "T = [\n" + "  0x12ab, 0x34cd, 77, 8123,\n" * 40 + "]\n", "data"),
        ("/s/w/r/t.py", 'T = {' + ",".join(f'"{i:06x}":[{i},{i * 7}]' for i in range(80)) + "}\n", "data"),
        ("/s/w/r/t.py", "STATES = [" + ", ".join(f'"state_{c}"' for c in "abcdefgh" * 8) + "]\n", ""),
        ("/s/w/r/a.js", '"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\n' + BODY, "compiled"),
        ("/s/w/r/deps.lock.json", '{"lockfileVersion": 3}', "lock"),
        ("/s/w/r/a.md", "# Generated by hand\n", ""),
        ("/s/w/r/a.js", "", ""),
    ],
)
def test_evidence(path, text, kind):
    assert H.evidence(path, text, OWN) == kind


LONG = "Licence terms of the own workspace, in full. " * 200


@pytest.mark.parametrize(
    "path,text,kind",
    [
        ("/s/w/r/a.js", f"/*\n{LONG}\n */\n// AUTO-GENERATED FILE - do not modify by hand\n" + BODY, "generated"),
        ("/s/w/r/a.js", f"/*\n{LONG}\n * Licensed under the kv licence\n */\n" + BODY, "vendored"),
        ("/s/w/r/a.py", f'"""{LONG}\nCode generated by schemagen.\n"""\nx = 1\n', "generated"),
        ("/s/w/r/deps.json", '{"dependencies": {' + ", ".join(f'"p{i}": "{i}"' for i in range(900)) + '}, "lockfileVersion": 3}', "lock"),
        ("/s/w/r/deps.yaml", "dependencies:\n" + "  a: 1\n" * 900 + "lockfileVersion: 5.4\n", "lock"),
        ("/s/w/r/a.go", "package a\n\n// Code generated by schemagen 1.1. DO NOT EDIT.\n\nfunc F() {}\n", "generated"),
        ("/s/w/r/a.go", 'package a\n\nvar s = "code generated by hand"\n\n// F writes files; it is maintained by hand, not generated by a tool.\nfunc F() {}\n', ""),
        ("/s/w/r/a.js", f"/* {LONG} */\n" + BODY, ""),
    ],
)
def test_evidence_far_into_the_text(path, text, kind):
    assert H.evidence(path, text) == kind


def test_globs():
    import re

    for glob, yes, no in [("*.min.js", ["a.min.js", "x/a.min.js"], ["amin.js"]), ("lib/*.js", ["lib/a.js"], ["lib/x/a.js", "q/lib/a.js"]), ("/gen/**", ["gen/a/b"], ["x/gen/a"]), ("**/v/**", ["v/a", "x/v/a/b"], ["xv/a"]), ("a?[bc].py", ["axb.py"], ["a/b.py", "axd.py"])]:
        rx = re.compile(H.glob_regex(glob))
        assert all(rx.match(p) for p in yes) and not any(rx.match(p) for p in no), glob


def test_declarations_win_by_depth_and_order(spark):
    rows = [
        ("/srv/ws/r/.gitattributes", "# note\n*.ts linguist-generated\nsrc/own.ts -linguist-generated\nsub/** linguist-vendored=true\n"),
        ("/srv/ws/r/sub/.gitattributes", "mine.js linguist-vendored=false text eol=lf\n"),
        ("/srv/ws/r/src/a.ts", BODY),
        ("/srv/ws/r/src/own.ts", "// AUTO-GENERATED FILE - do not modify by hand\n"),
        ("/srv/ws/r/sub/mine.js", BODY),
        ("/srv/ws/r/sub/b.js", BODY),
        ("/srv/ws/q/src/a.ts", BODY),
        ("/srv/ws/q/node_modules/z/a.js", BODY),
        (None, BODY),
        ("/srv/ws/q/e.js", None),
        ("/srv/ws/q/e.js", None),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "path string, content string, kind string, repo int")
    files = spark.createDataFrame([("/srv/ws/q/only/vendor/p.go", 1), (None, 2)], "path string, kind int")
    got = {r.path: (r.kind, r.reason) for r in H.classify(df, files).collect()}
    assert got["/srv/ws/r/src/a.ts"] == ("generated", "declared")
    assert got["/srv/ws/r/src/own.ts"] == ("", "declared")
    assert got["/srv/ws/r/sub/mine.js"] == ("", "declared") and got["/srv/ws/r/sub/b.js"] == ("vendored", "declared")
    assert got["/srv/ws/q/src/a.ts"] == ("", "") and got["/srv/ws/q/node_modules/z/a.js"] == ("vendored", "convention")
    assert got["/srv/ws/q/only/vendor/p.go"] == ("vendored", "convention") and got["/srv/ws/q/e.js"] == ("", "")
    assert H.classify(df.limit(0)).count() == 0


def test_patterns_are_mined(spark):
    rows = [(f"/srv/ws/r{i % 3}/src/made/f{i}.ts", ("// @generated by tool\n" if i % 2 else "") + BODY) for i in range(24)] + [(f"/srv/ws/r{i % 3}/src/f{i}.ts", BODY) for i in range(200)]
    got = {r.path: r.kind for r in H.classify(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert all(got[p] == "generated" for p, _ in rows[:24]) and not any(got[p] for p, _ in rows[24:])


def test_patterns_of_declaring_repositories_reach_the_others(spark):
    rows = [(f"/srv/ws/d{r}/.gitattributes", "stubs/** linguist-generated\n*_wire.ts linguist-vendored\nsrc/** -linguist-generated\n") for r in (1, 2)]
    rows += [(f"/srv/ws/d{r}/stubs/f{i}.ts", BODY) for r in (1, 2) for i in range(3)] + [(f"/srv/ws/d{r}/lib/g{i}_wire.ts", BODY) for r in (1, 2) for i in range(2)]
    rows += [(f"/srv/ws/d{r}/{d}/h{i}.ts", BODY) for r in (1, 2) for d in ("src", "lib") for i in range(5)]
    rows += [("/srv/ws/u/stubs/x.ts", BODY), ("/srv/ws/u/lib/y_wire.ts", BODY), ("/srv/ws/u/lib/z.ts", BODY), ("/srv/ws/u/src/w.ts", BODY), ("/srv/ws/u/stubs/readme.md", "# x\n")]
    got = {r.path: (r.kind, r.reason) for r in H.classify(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got["/srv/ws/u/stubs/x.ts"] == ("generated", "mined") and got["/srv/ws/u/lib/y_wire.ts"] == ("vendored", "mined")
    assert got["/srv/ws/u/lib/z.ts"] == got["/srv/ws/u/src/w.ts"] == got["/srv/ws/u/stubs/readme.md"] == ("", "")
    assert got["/srv/ws/d1/stubs/f0.ts"] == ("generated", "declared") and got["/srv/ws/d2/src/h0.ts"] == ("", "declared")
