from __future__ import annotations

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from lodeworks.llm import termcounts as C

SCHEMA = "path string, ngrams_json string, key int, json int, term int"


def rows(items):
    return [(k, j, 1, 2, 3) for k, j in items]


def state(df):
    return {r.term: (r.occurrences, r.records) for r in df.collect()}


def brute(items):
    once = {}
    for k, j in items:
        if k is not None and j is not None:
            try:
                once[k] = json.loads(j)
            except ValueError:
                pass
    occ, rec = Counter(), Counter()
    for m in once.values():
        for t, n in m.items():
            try:
                occ[t] += max(0, int(n))
            except (TypeError, ValueError):
                occ[t] += 0
            rec[t] += 1
    return {t: (occ[t], rec[t]) for t in rec} | ({None: (0, len(once))} if once else {})


ITEMS = [("a", '{"x": 1, "y": "3"}'), ("a", '{"x": 1, "y": "3"}'), ("b", "{}"), ("c", '{"x": 2'), ("d", None), (None, '{"q": 1}'), ("e", '{"x": "many", "z_\\u00e9": 2}'), ("f", ""), ("g", '{"x": -4}')]


def test_counts(spark):
    df = spark.createDataFrame(rows(ITEMS), SCHEMA)
    assert state(C.count_terms(df)) == brute(ITEMS)
    assert state(C.count_terms(df.limit(0))) == {}


def test_deltas_equal_counting_anew(spark, tmp_path):
    rng = random.Random(3)
    make = lambda: json.dumps({f"t{rng.randrange(12)}": rng.randrange(1, 4) for _ in range(4)})
    old = [(f"p{i}", make()) for i in range(40)]
    new = [(k, make() if i % 3 == 0 else j) for i, (k, j) in enumerate(old) if i % 7] + [(f"n{i}", make()) for i in range(9)]
    b, a = (C.records(spark.createDataFrame(rows(x), SCHEMA), "path", "ngrams_json") for x in (old, new))
    store = C.Store(spark, str(tmp_path / "s"), 4)
    store.merge(C.deltas(C.changes(None, b)))
    assert state(store.read()) == brute(old)
    store.merge(C.deltas(C.changes(b, a)))
    assert state(store.read()) == brute(new)


def test_a_merge_touches_only_its_buckets(spark, tmp_path):
    store = C.Store(spark, str(tmp_path / "s"), 16)
    delta = lambda *r: spark.createDataFrame(list(r), "term string, occurrences long, records long")
    store.merge(delta(*[(f"t{i}", 1, 1) for i in range(60)], (None, 0, 5)))
    store.merge(delta(("t3", -1, -1), ("new", 2, 1)))
    assert 1 <= len(list((tmp_path / "s" / "version=2").glob("bucket=*"))) <= 2
    got = state(store.read())
    assert "t3" not in got and got["new"] == (2, 1) and got[None] == (0, 5) and len(got) == 61
    (tmp_path / "s" / "version=3" / "bucket=1").mkdir(parents=True)  # a write that was lost
    assert state(store.read()) == got
    store.merge(delta(("t4", 1, 0)))
    assert state(store.read())["t4"] == (2, 1)
    empty = C.Store(spark, str(tmp_path / "e"))
    empty.merge(delta(("a", 1, 1)).limit(0))
    assert state(empty.read()) == {}
    empty.merge(delta(("a", 1, 1)))
    assert state(empty.read()) == {"a": (1, 1)}


def test_marks(spark):
    items = [(f"p{i}", json.dumps({"all": 1, **({"one": 1} if i == 0 else {}), **({"two": 1} if i < 2 else {})})) for i in range(20)]
    got = {(r.term, r.mark) for r in C.marked(C.count_terms(spark.createDataFrame(rows(items), SCHEMA))).filter(F.col("mark").isNotNull()).collect()}
    assert got == {("all", "common"), ("one", "rare")}
