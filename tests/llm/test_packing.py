from __future__ import annotations

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeworks.llm import packing as P


def fill(counts, capacity):
    placed, n = P.plan(counts, capacity)
    used, seen = Counter(), Counter()
    for size, first, number, container in placed:
        for k in range(number):
            used[container + k] += size
            seen[size, first + k] += 1
    return used, seen, n


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            g = min(fit)
            gaps.remove(g)
            gaps.append(g - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_plan_places_each_piece_once_and_overfills_nothing(sizes):
    used, seen, n = fill(Counter(sizes), 20)
    assert all(v <= 20 for v in used.values()) and len(used) == n
    assert seen == Counter({(s, r): 1 for s, c in Counter(sizes).items() for r in range(c)})
    assert n <= best_fit_decreasing(sizes, 20) + 1


def test_table(spark):
    rng = random.Random(5)
    items = [(i % 300, i // 300, 0, 7 if rng.random() < 0.4 else rng.randrange(1, 33)) for i in range(900)]
    df = spark.createDataFrame(items, "id long, part int, start long, size int")
    got = P.pack(spark, df, 32, chunk=50).collect()
    assert sorted((r.id, r.part, r.size) for r in got) == sorted((a, b, d) for a, b, _, d in items)
    used = Counter()
    for r in got:
        used[r.container] += r["size"]
    assert max(used.values()) <= 32 and len(used) <= best_fit_decreasing([d for *_, d in items], 32) + 1
    assert P.pack(spark, df.limit(0), 32).count() == 0


def test_pieces(spark):
    df = spark.createDataFrame([(1, 10), (2, 25), (3, 0), (4, 20)], "id long, tokens long")
    got = sorted((r.id, r.part, r.start, r["size"]) for r in P.pieces(df, 10).collect())
    assert got == [(1, 0, 0, 10), (2, 0, 0, 10), (2, 1, 10, 10), (2, 2, 20, 5), (4, 0, 0, 10), (4, 1, 10, 10)]


def test_documents(spark):
    import os

    if not os.path.exists(P.TOKENIZER):
        pytest.skip("no tokenizer")
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (None, "q", "x"), (4, "word " * 30_000, "x"), (5, "<|endoftext|> é", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    enc = P.encoding(P.TOKENIZER)
    got = P.pack_documents(df, capacity=1000).groupBy("id").sum("size").collect()
    assert {r.id: r["sum(size)"] for r in got} == {k: len(enc.encode_ordinary(t or "")) for k, t, _ in rows if k}
