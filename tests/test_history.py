from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest

from lodeworks.operators import history as H

SCHEMA = "id string, seq long, file_path string, timestamp timestamp_ntz, hash string, content string, _piece int, n string"
T0 = dt.datetime(2024, 1, 1)


def row(i, seq, path, minute, h, content=None):
    return (i, seq, path, None if minute is None else T0 + dt.timedelta(minutes=minute), h, content, 7, "x")


def brute(rows):
    once = {}
    for r in sorted(rows, key=lambda r: (r[1] if r[1] is not None else -1)):
        if r[0] is not None:
            once.setdefault(r[0], r)
    by = {}
    for r in once.values():
        p = r[2]
        if p is not None:
            p = p.replace("\\", "/")
            while "//" in p:
                p = p.replace("//", "/")
            p = p[1:] if p.startswith("./") or p == "." else p
        h = (r[4] or "").strip().lower() or (hashlib.sha256(r[5].encode()).hexdigest() if r[5] is not None else None)
        key = (p, r[3])
        if key not in by or (r[1] or -1) > by[key][1]:
            by[key] = (r[0], r[1] or -1, h)
    out, last = set(), {}
    for (p, at), (i, _, h) in sorted(by.items(), key=lambda x: (x[0][0] or "", x[0][1] or dt.datetime.min)):
        if p not in last or last[p] != h:
            out.add(i)
        last[p] = h
    return out


def test_brute_force_with_hot_file(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        path = rng.choice(["/a/b", "\\a\\b", "/a//b", "./c", "/c", None]) if rng.random() < 0.7 else f"/p{rng.randrange(9)}"
        content = rng.choice(["u", "v", "", None])
        h = rng.choice(["", None, hashlib.sha256(b"u").hexdigest(), hashlib.sha256(b"u").hexdigest().upper(), "short"])
        rows.append(row(f"i{k}", k, path, rng.randrange(150), h, content))
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk in (10_000, 7):
        assert {r.id for r in H.version_changes(df, chunk).collect()} == brute(rows)


def test_numbers_are_consecutive_when_pieces_are_cut(spark):
    rows = [("k", T0 + dt.timedelta(seconds=i // 3), i) for i in range(500)] + [(None, T0, 1), (None, None, 2), ("z", None, 1)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, i int")
    got = {(r.k, r.i): r.n for r in H.numbered(df, ["k"], "at", ["i"], chunk=20).collect()}
    assert [got["k", i] for i in range(500)] == list(range(1, 501))
    assert got[None, 2] == 1 and got[None, 1] == 2 and got["z", 1] == 1


def test_validity_closes_periods(spark):
    rows = [row("a", 1, "/f", 1, "A" * 64), row("b", 2, "/f", 2, "a" * 64), row("c", 3, "/f", 3, "odd"), row("d", 4, "/f", 4, "a" * 64)]
    h = {r.id: r for r in H.version_history(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(h) == {"a", "c", "d"} and h["c"].hash == "odd" and h["a"].hash == "a" * 64
    assert h["a"].valid_to == h["c"].valid_from and h["d"].valid_to is None and h["d"].period == 3


def test_empty_table(spark):
    assert H.version_history(spark.createDataFrame([], SCHEMA)).count() == 0


def test_snapshot_difference_is_null_safe(spark):
    old = spark.createDataFrame([(1, "a"), (None, "x"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (None, "x"), (2, None), (4, "d")], "k int, v string")
    got = {(r.k, r.op) for r in H.diff_snapshots(old, new, ["k"], ["v"]).collect()}
    assert got == {(1, "update"), (3, "delete"), (4, "insert")}


def test_history_from_snapshots(spark):
    d = [dt.date(2024, 1, x) for x in (1, 2, 3, 4)]
    snaps = spark.createDataFrame([("k", d[0], 1), ("k", d[1], 1), ("k", d[3], 1), ("m", d[0], 5), ("m", d[1], 6), ("m", d[2], 6), ("m", d[3], 6)], "k string, at date, v int")
    got = sorted((r.k, r.valid_from, r.valid_to, r.v) for r in H.history_from_snapshots(snaps, ["k"], "at", ["v"], d).collect())
    assert got == sorted([("k", d[0], d[2], 1), ("k", d[3], None, 1), ("m", d[0], d[1], 5), ("m", d[1], None, 6)], key=lambda x: (x[0], x[1]))


@pytest.mark.parametrize("path,clean", [("\\a\\b", "/a/b"), ("/a//b", "/a/b"), ("./a", "/a"), (".hidden", ".hidden"), ("/a/./b", "/a/./b")])
def test_clean_path(spark, path, clean):
    assert spark.createDataFrame([(path,)], "p string").select(H.clean_path(H.F.col("p")).alias("c")).first().c == clean
