"""SimHash classes against all pairs."""

import numpy as np
import pytest
import xxhash

from precinct.llm import simhash


def _brute(ids, fps, distance):
    points = np.array(fps, np.int64).view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= distance)
    root = simhash.smallest_reached(len(points), i, j)
    known = {}
    for r, d in zip(root, ids, strict=True):
        if d is not None:
            known[r] = min(known.get(r, d), d)
    return [known.get(r) for r in root]


def _plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_documents(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(f"W{x}" for x in rng.integers(0, 50, n)) for n in (1, 2, 3, 40, 400, 3000)]
    texts = [None, "", " \t"] + base + base + [base[5] + " tail", base[5].lower(), "É é"]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)] + [(None, base[3], "x", 0), (None, "alone here", "x", 0), (3, base[0], "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_classes(docs).collect()), key=str)
    fps = [_plain_fingerprint(t) for _, t, *_ in rows]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = sorted(zip([r[0] for r in rows], signed, _brute([r[0] for r in rows], signed, 2), strict=True), key=str)
    assert got == want
    assert simhash.near_classes(docs.where("false")).count() == 0


@pytest.mark.parametrize("leaf,guests,rounds", [(2048, 1 << 14, 8), (40, 64, 8), (40, 30, 1), (30, 50, 0)])
def test_links_lose_nothing(spark, monkeypatch, leaf, guests, rounds):
    """Random fingerprints, dense balls and chains, with limits low enough to split and block."""
    for name, value in (("LEAF", leaf), ("GUESTS", guests), ("ROUNDS", rounds), ("SAMPLE", 300)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(2)
    points = list(rng.integers(-(2**63), 2**63 - 1, 900))
    for centre in points[:3]:
        for _ in range(80):  # a ball in which nearly all are linked
            points.append(np.int64(centre) ^ np.int64(1 << int(rng.integers(0, 40))) ^ np.int64(1 << int(rng.integers(0, 40))))
    for k in range(40):  # a chain
        points.append(points[-1] ^ np.int64(1 << k) ^ np.int64(1 << (k + 1)))
    points = sorted({int(p) for p in points})
    fps = spark.createDataFrame([(p,) for p in points], "fp bigint")
    edges = simhash.links(fps).toPandas()
    place = {p: i for i, p in enumerate(points)}
    got = simhash.smallest_reached(len(points), edges.u.map(place).to_numpy(), edges.v.map(place).to_numpy())
    arr = np.array(points).view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 2)
    assert np.array_equal(got, simhash.smallest_reached(len(points), i, j))
