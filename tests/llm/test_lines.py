"""Near-duplicate lines against all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from precinct.llm import lines, queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _edited(rng, line, times):
    for _ in range(times):
        at, what = rng.randrange(len(line) + 1), rng.choice("rid")
        line = line[:at] + (rng.choice("abé ") if what != "d" else "") + line[at + (what != "i") :]
    return line


def _rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(18, 60))) for _ in range(25)]
    pool = base + [_edited(rng, rng.choice(base), rng.randrange(0, 4)) for _ in range(120)] + ["short", "", "x" * 5000, "x" * 4999, "é" * 20]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 8)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, base[0]), (42, base[0]), (None, base[1] + "\nonly here, and nowhere else")]
    # rows that share an id or have none, some of them equal
    rows += [(i, "\n".join(rng.choice(pool) for _ in range(4))) for i in (None, None, None, 7, 7, 3)]
    rows += [(None, None), (-5, base[2]), (None, rows[-1][1]), (7, rows[-2][1]), (7, rows[-2][1]), ((1 << 63) - 1, base[3] + "!")]
    return [(*r, "x", 0) for r in rows]


def expected(rows, edits=2, min_chars=20):
    """Row by row: rows of one id, or without any, are told apart by a hash of their text and then by their order."""

    def hashed(text):
        number = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        return number - (1 << 64) if number >> 63 else number

    rows = [(r, (r[0] is None, r[0] or 0, hashed(r[1]), at)) for at, r in enumerate(rows)]
    places = {}
    for (_, text, *_), row in rows:
        for no, line in enumerate(text.split("\n") if text is not None else []):
            if len(line) >= min_chars:
                places[line] = min(places.get(line, (row, no)), (row, no))
    near = {a: [b for b in places if b != a and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits] for a in places}
    out = []
    for (doc_id, text, *_), row in rows:
        all_lines = text.split("\n") if text is not None else []
        gone = [
            no for no, x in enumerate(all_lines)
            if x in places and (any(places[b] < places[x] for b in near[x]) or (row, no) > places[x])
        ]
        out.append((doc_id, len(all_lines), gone, sum(bool(near.get(x)) for x in all_lines)))
    return out


def test_report(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, line string, id int").repartition(3)
    got = [(r.doc_id, r.n_lines, r.removed, r.n_linked) for r in lines.report(docs).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)
    assert all(r.n_removed == len(r.removed) for r in lines.report(docs).collect())
    assert lines.report(docs.where("false")).count() == 0
    kept = lines.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() >= 2


def test_no_row_takes_lines_from_another(spark):
    rows = [(None, "a\nb"), (None, "c\nd"), (7, "a\ne"), (7, "f\nd")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, dup string, gone string")
    kept = lines.without_repeats(docs, short_copies=True)
    assert sorted("".join(r.text for r in kept.collect())) == ["\n"] * 2 + list("abcdef") and kept.columns == docs.columns
    twice = lines.without_repeats(docs.unionByName(docs), short_copies=True)
    assert sorted(r.text for r in twice.collect()) == sorted(r.text for r in kept.collect())


def test_copies_of_short_lines(spark, tmp_path):
    """Short lines with a word go as exact copies only, and a copy of a whole document goes."""
    whole = "Les.\n\nA line that is long enough to compare\nLes.\nYes."
    rows = [(1, whole), (2, whole), (3, "Les\n \nYes.\nA line that is long enough to compere"), (4, "\n "), (5, "\n "), (6, None), (None, "Les\nnew")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.removed, r.n_linked) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: ([3], 1), 2: ([0, 2, 3, 4], 1), 3: ([2, 3], 1), 4: ([], 0), 5: ([], 0), 6: ([], 0), None: ([0], 0)}
    kept = corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id: r.text for r in kept.collect()} == {1: whole.replace("Les.\nYes", "Yes"), 3: "Les\n ", 4: "\n ", 5: "\n ", 6: None, None: "new"}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_automaton(spark, edits):
    rng = random.Random(edits)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("abcd", "abcd"), ("é" * 30, "é" * 31)]
    for _ in range(200):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 25)))
        pairs.append((a, _edited(rng, a, rng.randrange(0, 6))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("near", lines.within(F.col("a"), F.col("b"), edits)).collect():
        assert r.near == (distance(r.a, r.b) <= edits), (r.a, r.b)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(_rows(), "doc_id bigint, text string, line string, id int")
    plan = lines.candidates(lines.distinct_lines(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_variants_of_one_line(spark):
    """Variants that share segments make few candidates, and no link between them is lost."""
    rng = random.Random(8)
    base = " ".join("".join(rng.choice("abcdefgé") for _ in range(6)) for _ in range(30))
    far = {base}
    for _ in range(200):
        at = rng.randrange(len(base))
        far.add(base[:at] + "".join(rng.choice("hijklmnopqrs") for _ in range(5)) + base[at:])
    pool = sorted(far) + sorted({_edited(rng, x, rng.randrange(1, 3)) for x in rng.sample(sorted(far), 40)} - far)
    found = lines.distinct_lines(spark.createDataFrame(enumerate(pool), "doc_id bigint, text string").repartition(3))
    text = {r.id: r.line for r in found.collect()}
    # lines of very different content cannot be near: only the others are worth the slow check
    want = {frozenset((a, b)) for i, a in enumerate(pool) for b in pool[:i] if abs(len(a) - len(b)) <= 2 and _close(a, b)}
    got = [frozenset((text[r.a], text[r.b])) for r in lines.links(found).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 30
    assert lines.candidates(found).count() < 0.3 * len(pool) ** 2 / 2


def _close(a, b):
    """Distance at most 2 by trying the edits at the first difference."""

    def at_most(i, j, left):
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        if i == len(a) or j == len(b):
            return len(a) - i + len(b) - j <= left
        return left > 0 and (at_most(i + 1, j + 1, left - 1) or at_most(i + 1, j, left - 1) or at_most(i, j + 1, left - 1))

    return at_most(0, 0, 2)
