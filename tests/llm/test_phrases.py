"""Removed passages against brute force."""

import hashlib
import re

import numpy as np
import pytest

from precinct.llm import phrases
from precinct.runtime import attach


def brute(rows, window=13):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    first = {}
    for (doc_id, *_), words in zip(rows, split, strict=True):
        for i in range(len(words) - window + 1):
            if doc_id is not None:
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for (doc_id, *_), words in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if doc_id is not None and first[tuple(words[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def _rows():
    rng = np.random.default_rng(3)
    words = lambda n, v=400: " ".join(f"w{x}" for x in rng.integers(0, v, n))
    common, passage, tiny = words(30), words(60), words(12)
    rows = [(0, None), (1, ""), (2, "\n\t "), (3, tiny), (4, tiny), (5, common), (6, common)]
    for i in range(7, 60):
        rows.append((i, words(int(rng.integers(0, 120)), 8 if i % 5 == 0 else 400) + "\n" + (common if i % 3 == 0 else passage[: i * 6])))
    rows += [(60, words(3000) + " " + passage), (61, passage + " " + words(5) + " " + passage), (62, "same " * 200), (63, "same " * 40)]
    rows += [(5, common), (64, passage), (64, common + " other"), (None, passage), (70, words(13)), (71, "é" * 5000 + " " + passage)]
    return [(*r, "x", 1) for r in rows]


@pytest.mark.parametrize("shard,hot", [(1000, 10_000), (3, 2)])
def test_removed(spark, monkeypatch, shard, hot):
    monkeypatch.setattr(phrases, "SHARD_PIECES", shard)
    monkeypatch.setattr(phrases, "HOT_PIECES", hot)
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, h int").repartition(3)
    got = [tuple(r) for r in phrases.without_repeats(docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_text_and_empty_table(spark):
    docs = spark.createDataFrame(_rows(), "doc_id bigint, text string, n_words string, h int")
    for r in phrases.without_repeats(docs, with_text=True).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert phrases.without_repeats(docs.where("false")).count() == 0


def test_no_anchor_in_one_task(spark, monkeypatch):
    """Anchors are counted by partial sums, never gathered by key, and found alike when their keys are too many to send."""
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, h int").repartition(3)
    found = phrases.anchors(phrases._keyed(docs).where("doc_id IS NOT NULL"))
    plan = phrases.shared(found)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Window" not in plan
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(phrases, "attach", lambda *a: attach(*a, hot_rows=20))
    assert sorted((tuple(r) for r in phrases.without_repeats(docs).collect()), key=str) == brute(rows)
