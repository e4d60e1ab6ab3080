"""Clustering and search of integer vectors against plain loops, on rows of every odd kind."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from precinct.llm import centroids, topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, chunk string, row string, score string, cluster string"


def table(spark, pairs):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z", "w") for i, v in pairs], SCHEMA).repartition(5)


def odd_rows(rng, n, size):
    rows = [(i, rng.normal(0, 0.2, size).astype(np.float32).tolist()) for i in range(n)]
    # copies, ties, repeated ids, a missing id, and what takes no part
    rows += [(n + i, rows[3][1]) for i in range(12)] + [rows[5], rows[5], (None, rows[7][1])]
    rows += [(900, None), (901, [None] * size), (902, [math.nan] * size), (903, [math.inf] + [0.0] * (size - 1)), (904, [])]
    return rows + [(905, [0.5] * (size - 1)), (906, [0.0] * size), (907, [1e30] * size)]


def plain(rows, scale, size=None):
    def fits(v):
        return v is not None and all(x is not None and math.isfinite(x) and abs(x) < 2**27 / scale for x in v)

    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if fits(v)]
    return [r for r in kept if size is None or len(r[1]) == size]


def plain_lloyd(rows, k, rounds):
    def key(r):
        return hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]

    cents = [list(v) for _, v in sorted(rows, key=key)[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        marks = [near(v)[1] for _, v in rows]
        for c in range(len(cents)):
            mine = [v for m, (_, v) in zip(marks, rows, strict=True) if m == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in rows], cents


def order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("blocks", [1, 3])
def test_lloyd_equals_plain_loops(spark, blocks):
    rows = odd_rows(np.random.default_rng(1), 150, 10)
    got, cents = centroids.lloyd(table(spark, rows), k=5, rounds=4, size=10, blocks=blocks, chunk=16)
    want, wanted = plain_lloyd(plain(rows, 1024, 10), 5, 4)
    assert order(got.collect()) == order(want) and cents == wanted


def test_lloyd_with_few_large_or_no_vectors(spark):
    rows = [(1, [-100000.0, 3.0]), (2, [100000.0, 3.0]), (3, [100000.0, 3.0])]
    got, cents = centroids.lloyd(table(spark, rows), k=8, rounds=2, size=2, blocks=2)
    want, wanted = plain_lloyd(plain(rows, 1024), 8, 2)
    assert order(got.collect()) == order(want) and cents == wanted
    got, cents = centroids.lloyd(table(spark, [(1, None)]), size=2)
    assert got.collect() == [] and cents == []


def plain_top(rows, k, every):
    out = []
    for n, (i, v) in enumerate(rows):
        if i is None or i % every:
            continue
        others = [(sum(x * y for x, y in zip(v, w, strict=True)), j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v)]
        best = sorted(others, key=lambda o: (-o[0], o[1] is None, o[1]))[:k]
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("shard", [64, 1 << 14])
def test_top_k_equals_plain_loops(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "QUERY_BYTES", 2000)
    rows = odd_rows(np.random.default_rng(2), 300, 12)
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 5 == 0).collect()
    assert order(got) == order(plain_top(plain(rows, 256), 5, 5))


def test_top_k_with_few_large_or_no_vectors(spark):
    rows = [(0, [-5e5, 3.0]), (5, [5e5, 3.0]), (7, [4e5, -3.5]), (10, [0.0, 0.0]), (12, []), (15, []), (20, [1.0])]
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 5 == 0).collect()
    assert order(got) == order(plain_top(plain(rows, 256), 5, 5))
    assert topk.top_k(table(spark, [(5, None)]), F.col("vec_id") % 5 == 0).collect() == []


def test_the_walk_stops_early_and_stays_exact():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.normal(0, 0.125, (5000, 64))).astype(np.int64)
    vectors[4000:4010] = vectors[17]
    shard = topk.Shard(np.arange(5000), np.arange(5000), vectors)
    walked = []
    walk = topk.Shard._walk
    shard._walk = lambda done, ends, *rest: walked.append((ends - done).sum()) or walk(shard, done, ends, *rest)
    scores, ids = np.full((1, 5), topk.NONE), np.full((1, 5), topk.NO_ID)
    shard.search(np.array([17]), vectors[17:18], scores, ids)
    assert ids[0].tolist() == [4000, 4001, 4002, 4003, 4004] and (scores == (vectors[17] ** 2).sum()).all()
    assert sum(walked) < 0.6 * 5000 * 64
