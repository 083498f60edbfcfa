from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodeworks.llm import neighbours as N


def make(n=900, d=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, 60, 2):
        x[i + 1] = x[i] + rng.normal(size=d) * 0.03
    return [(f"p{i:04d}", [float(v) for v in row], "v1" if i % 9 else "v2", "junk", 5) for i, row in enumerate(x)]


SCHEMA = "path string, vec array<float>, ver string, rep string, similarity int"


def pairs(spark, rows, least=0.95, **kw):
    df = spark.createDataFrame(rows, SCHEMA).filter(N.sound(F.col("vec"), 16))
    v = N.distinct_vectors(df, "path", "vec", F.col("ver")).cache()
    return {p for r in N.pairs_within(spark, v, least, **kw).collect() for p in ((r.rep, r.other), (r.other, r.rep))}, v


def brute(rows, least=0.95):
    ok = [(p, np.array(v), g) for p, v, g, *_ in rows]
    x = np.array([v / np.linalg.norm(v) for _, v, _ in ok])
    s = x @ x.T
    return {(ok[i][0], ok[j][0]) for i, j in np.argwhere(s >= least) if i != j and ok[i][2] == ok[j][2]}


def test_all_near_pairs_are_found(spark, monkeypatch):
    rows = make()
    assert pairs(spark, rows)[0] == brute(rows)
    monkeypatch.setattr(N, "BLOCK", 20)  # hot cells in parts
    assert pairs(spark, rows)[0] == brute(rows)


def test_recall_of_search(spark):
    rows = make()
    v = pairs(spark, rows)[1]
    got = N.nearest(spark, v, v.filter("rep < 'p0040'"), 10).collect()
    names = [r[0] for r in rows]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = total = 0
    for q in sorted({r.rep for r in got}):
        i = names.index(q)
        s = x @ x[i]
        s[[k for k in range(len(rows)) if rows[k][2] != rows[i][2] or k == i]] = -9
        best = {names[k] for k in np.argsort(-s)[:10]}
        hit += len(best & {r.other for r in got if r.rep == q})
        total += 10
    assert hit / total >= 0.9 and max(r.rank for r in got) == 10


def test_unsound_repeated_and_empty(spark):
    base = [1.0] + [0.0] * 15
    nan = [float("nan")] + base[1:]
    rows = [("a", base, "v1", "", 0), ("a", base, "v1", "", 0), ("b", [2.0] + [0.0] * 15, "v1", "", 0), ("c", base, "v2", "", 0), ("d", base, None, "", 0), ("e", nan, "v1", "", 0), ("f", [0.0] * 16, "v1", "", 0), ("g", base[:5], "v1", "", 0), ("h", None, "v1", "", 0), (None, base, "v1", "", 0), ("i", base, "v1", "", 0)]
    got, v = pairs(spark, rows)
    assert got == {("a", "b"), ("b", "a")}
    assert {(r.rep, r.copies) for r in v.collect()} == {("a", 2), ("b", 1), ("c", 1)}
    m = N.members(spark.createDataFrame(rows, SCHEMA).filter(N.sound(F.col("vec"), 16)), "path", "vec", F.col("ver"), v)
    assert {(r.key, r.rep) for r in m.collect()} == {("a", "a"), ("i", "a"), ("b", "b"), ("c", "c")}
    assert pairs(spark, rows[:0])[0] == set()


def test_encoding_sums_codewords():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    b = N.fit(x, 8, 16, 3)
    codes, norms = b.encode(x)
    back = sum(book[codes[:, m]] for m, book in enumerate(b.books))
    assert np.allclose((back**2).sum(1), norms, atol=1e-3)
    assert ((x - back) ** 2).sum() < 0.5 * (x**2).sum()
    s = N.scores(b.tables(x[:5]), codes, norms)
    assert np.allclose(s, x[:5] @ back.T / np.sqrt(norms), atol=1e-3)


def test_a_dense_cluster_loses_no_pair(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    rows = [(f"c{i:03d}", [float(v) for v in centre + rng.normal(size=16) * 0.02], "v1", "junk", 5) for i in range(200)] + make(300)
    assert len(brute(rows[:200])) == 39_800
    assert pairs(spark, rows)[0] == brute(rows)


def test_cells_of_two_books_find_the_same(spark):
    rows = make(1_200)
    x = np.array([np.array(r[1]) / np.linalg.norm(r[1]) for r in rows], np.float32)
    assert pairs(spark, rows, books=N.fit(x, 12, words=16, books=6, deep=3))[0] == brute(rows)


def test_the_bound_of_candidates_holds():
    rng = np.random.default_rng(4)
    x = N._unit(__import__("pandas").Series(list(rng.normal(size=(500, 24)))))
    books = N.fit(x, 10, words=8, books=4)
    codes, _ = books.encode(x)
    floor = N.reachable(x, books.decode(codes), 0.9)
    for _ in range(20):
        w = rng.normal(size=x.shape)
        w -= np.einsum("nd,nd->n", w, x)[:, None] * x
        w /= np.linalg.norm(w, axis=1)[:, None]
        c = rng.uniform(0.9, 1, len(x))[:, None]
        q = (c * x + np.sqrt(1 - c**2) * w).astype(np.float32)
        assert (np.diagonal(N.products(books, q, codes)) >= floor).all()
