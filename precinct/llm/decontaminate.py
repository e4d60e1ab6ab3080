"""Benchmark passages in training text, found by spaced seeds.

A seed hashes the tokens of a short window at the places that a fixed mask keeps and ignores the
others, so a passage is still hit when words at ignored places were replaced. Hits of test and
training seeds give a document, an item and a shift between them; along that shift the tokens
are compared one by one, and the stretch with most equal tokens among those that agree well
enough is an overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.phrases import mixed, word_hashes
from precinct.llm.text import free_names, steps
from precinct.runtime import cut, send_to_workers

# 1: the token counts, 0: any token will do. Wherever the replaced tokens lie, four equal ones in a
# row or two pairs around a replaced one are left in every overlap of an item of 6 tokens or more;
# items of 5 tokens have masks of their own (tested for all sets of replaced places).
MASKS = ("1111", "11011")
SHORT_MASKS = ("10111", "11101")

# An overlap counts when it has this share of equal tokens (IDENTITY) and at least MIN_TOKENS of
# them, or, in a shorter item, all but a fifth of the item. Items of fewer tokens than
# SHORTEST say too little and are not searched.
IDENTITY = 0.8
MIN_TOKENS = 13
SHORTEST = 5

# Hits compared at a time.
STEP_HITS = 1 << 20

# Items searched for in one pass over the documents; more items take more passes.
SLICE_ITEMS = 20_000

# Scripts written without spaces; each of their characters is a token.
_UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]")

_KEEP = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in bytes(range(256)).lower())

send_to_workers(__name__)


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all other characters, scripts without spaces cut into characters."""
    if not text:
        return []
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.encode().translate(_KEEP).split()


def _seeds(hashes: np.ndarray, owner: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every window of one owner under a mask, owners laid end to end."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.flatnonzero(owner[:n] == owner[len(mask) - 1 :])
    out = np.full(len(place), int(mask, 2) * len(mask), np.uint64)
    for k, kept in enumerate(mask):
        if kept == "1":
            out += hashes[place + k] * np.uint64((2 * k + 3) ** 11)
    return mixed(out), place


class Items:
    """The seeds of one slice of benchmark items, sorted by hash for each mask, with the low bits of their hashes."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        tokens = [tokens_of(t) for _, t in items]
        sizes = np.array([len(t) for t in tokens], np.int64)
        self.hashes = word_hashes(list(chain.from_iterable(tokens))) if sizes.sum() else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(items)), sizes)
        self.start = sizes.cumsum() - sizes
        self.sizes = sizes
        self.tables = []
        for mask in (*MASKS, *(SHORT_MASKS if (sizes == SHORTEST).any() else ())):
            h, place = _seeds(self.hashes, self.owner, mask)
            own = sizes[self.owner[place]] == SHORTEST if mask in SHORT_MASKS else sizes[self.owner[place]] >= SHORTEST
            h, place = h[own], place[own]
            order = np.argsort(h, kind="stable")
            # most seeds of a document are in no item: a table of the hashes' low bits tells at once
            low = np.zeros(1 << max(16, int(len(h)).bit_length() + 4), bool)
            low[h & np.uint64(len(low) - 1)] = True
            self.tables.append((mask, h[order], place[order], low))

    def overlaps(self, hashes: np.ndarray, owner: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> list[tuple]:
        """(document, item, start, end, equal) of the best overlap of each document, item and shift."""
        found = []
        for mask, table, place, low in self.tables:
            h, at = _seeds(hashes, owner, mask)
            likely = np.flatnonzero(low[h & np.uint64(len(low) - 1)])
            h, at = h[likely], at[likely]
            left, right = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            hit = np.flatnonzero(right > left)
            for part in _parts(right[hit] - left[hit], STEP_HITS):
                counts = right[hit[part]] - left[hit[part]]
                begin = np.repeat(at[hit[part]], counts)
                of = place[_ranges(left[hit[part]], counts)]
                item = self.owner[of]
                shift = (begin - first[owner[begin]]) - (of - self.start[item])
                found.append(self._likely(_unique(owner[begin], item, shift), hashes, first, sizes))
        spots = _unique(*np.concatenate(found, axis=1)) if found else np.zeros((3, 0), np.int64)
        out = []
        for doc, item, shift in spots.T.tolist():
            a, b = max(0, -shift), min(self.sizes[item], sizes[doc] - shift)
            at = first[doc] + shift
            equal = self.hashes[self.start[item] + a : self.start[item] + b] == hashes[at + a : at + b]
            start, end, same = _best(equal)
            if same >= _needed(self.sizes[item]):
                out.append((doc, item, int(shift + a + start), int(shift + a + end), int(same)))
        return out

    def _likely(self, spots: np.ndarray, hashes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Those (document, item, shift) along which enough tokens are equal at all."""
        doc, item, shift = spots
        begin = np.maximum(0, -shift)
        counts = np.minimum(self.sizes[item], sizes[doc] - shift) - begin
        kept = [np.zeros((3, 0), np.int64)]
        for part in _parts(counts, STEP_HITS):
            equal = self.hashes[_ranges(self.start[item[part]] + begin[part], counts[part])]
            equal = equal == hashes[_ranges(first[doc[part]] + shift[part] + begin[part], counts[part])]
            same = np.add.reduceat(equal, counts[part].cumsum() - counts[part], dtype=np.int64)
            kept.append(spots[:, part][:, same >= _needed(self.sizes[item[part]])])
        return np.concatenate(kept, axis=1)


def _needed(tokens: np.ndarray) -> np.ndarray:
    """Equal tokens that an overlap needs, by the number of tokens of the item."""
    return np.minimum(MIN_TOKENS, -(-round(1000 * IDENTITY) * tokens // 1000))


def _ranges(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    return np.repeat(start - (counts.cumsum() - counts), counts) + np.arange(counts.sum())


def _parts(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows with `most` in all, or of one row."""
    total, a = counts.cumsum(), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def _unique(*columns: np.ndarray) -> np.ndarray:
    """The distinct rows of integer columns, as columns in order."""
    rows = np.stack(columns)[:, np.lexsort(columns[::-1])]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
    return rows[:, new]


def _best(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal) of the stretch with most equal tokens of those that have IDENTITY, the shortest of these.

    A stretch has that share when the gain over it is not negative; the earliest start with no
    higher gain before it than at the end is the one that holds most equal tokens.
    """
    gain = np.r_[0, np.where(equal, round(1000 * (1 - IDENTITY)), -round(1000 * IDENTITY)).cumsum()]
    same = np.r_[0, equal.cumsum()]
    start = np.searchsorted(-np.minimum.accumulate(gain), -gain, "left")
    held = same - same[start]
    most = int(held.max())
    at = np.flatnonzero(held == most)
    # an unequal token at an end adds nothing
    end = int(at[(at - start[at]).argmin()])
    inside = np.flatnonzero(equal[start[end] : end]) + start[end]
    return (int(inside[0]), int(inside[-1]) + 1, most) if most else (0, 0, 0)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, start, end, equal): token ranges of `docs` that hold benchmark text.

    One row per document, item and shift; `row` is a hash of the document's text, so that rows
    sharing a doc_id stay apart. Whole texts are searched. Null and empty texts or items have no
    overlap; other columns are ignored. The benchmark is read in slices of SLICE_ITEMS items by
    the hash of the item, each of which is sent to the tasks; its size does not depend on the
    documents.
    """
    items = cut(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL"))
    slices = max(1, -(-items.count() // SLICE_ITEMS))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.xxhash64(text).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    whole = None
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k).collect()
        part = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in part])

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            known = Items(part.value)
            for batch in steps(batches):
                tokens = [tokens_of(t) for t in batch.column(2).to_pylist()]
                sizes = np.array([len(t) for t in tokens], np.int64)
                if not sizes.sum() or not known.ids:
                    continue
                hashes = word_hashes(list(chain.from_iterable(tokens)))
                owner = np.repeat(np.arange(len(tokens)), sizes)
                found = known.overlaps(hashes, owner, sizes.cumsum() - sizes, sizes)
                if found:
                    doc, item, start, end, equal = (list(x) for x in zip(*found, strict=True))
                    rows = pa.array(doc)
                    columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([known.ids[i] for i in item], pa.int64())]
                    columns += [pa.array(x, pa.int32()) for x in (start, end, equal)]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "item_id", "start", "end", "equal"])

        found = docs.mapInArrow(run, "row bigint, doc_id bigint, item_id bigint, start int, end int, equal int")
        whole = found if whole is None else whole.unionByName(found)
    return whole


def flags(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per text with an overlap: row, doc_id, the items found and the longest overlap."""
    found = overlaps(docs, benchmark).groupBy("row", "doc_id")
    return found.agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("equal").alias("most_equal"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items (sorted), most_equal."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"))
    marked = cut(flags(docs, benchmark)).withColumn("hit", F.lit(True))
    same = (rows["row"] == marked["row"]) & rows["doc_id"].eqNullSafe(marked["doc_id"])
    whole = rows.join(marked, same, "left").select(rows["doc_id"], "items", "most_equal", "hit")
    return whole.select(
        "doc_id",
        F.coalesce("hit", F.lit(False)).alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("most_equal", F.lit(0)).alias("most_equal"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no benchmark passage.

    Null and empty texts stay, rows that repeat a text share its verdict, rows without a doc_id are
    judged like others, empty tables are fine, and other columns may have any names.
    """
    row, of = free_names(docs.columns, "row", "of")
    marked = cut(flags(docs, benchmark)).select(F.col("row").alias(row), F.col("doc_id").alias(of))
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(marked, (text == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(of)), "left_anti")
