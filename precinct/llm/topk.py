"""Exact top-k search by inner product over an impact-ordered index, score at a time.

The vectors are written once and cut into shards, each in one task. A shard's postings (vectors
with a component in a dimension, apart by sign) are ordered by quantised impact, largest first. A
query walks segments of postings by descending contribution over all dimensions and adds them up as
upper bounds. After each stage a vector's score is at most its sum plus, for every posting
not yet seen that could raise it, the largest contribution left. The walk stops only when this
proves all but a few vectors to lie below the k-th best exact score known; those few are
scored exactly. Every vector is indexed, and nothing is decided by a sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precinct.llm.vectors import integers, usable
from precinct.runtime import BRIEF_SHUFFLES, cut, scratch, send_to_workers, settings

# Vectors of one shard at most; its index is some ten bytes a posting.
SHARD = 1 << 14

# Quantised impacts of postings.
LEVELS = 48

# Query weights are cut to so many steps, so that sums of bounds stay exact.
WEIGHT = 1 << 16

# First stage: postings whose contribution is at least this part of the largest; each next stage halves it.
FIRST = 16

# The walk may stop when at most this share of a shard could still be members.
FEW = 1 / 64

# Bytes of queries sent to all tasks at a time; further ones follow in rounds of their own.
QUERY_BYTES = 16 << 20

# Stands for a missing id, behind all others.
NO_ID = np.iinfo(np.int64).max

# The score of a place not taken yet.
NONE = -np.iinfo(np.int64).max

send_to_workers(__name__)


def indexed(rows: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, size, ints) of the vectors that take part, written once so that row numbers stay."""
    whole = rows.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("v"))
    whole = whole.where(usable("v", scale)).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("size"), "v"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            ints = integers(batch.column(3), 1, scale).astype("<i4").tobytes()
            ends = np.cumsum(sizes, dtype=np.int64) * 4
            packed = [ints[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(packed, pa.binary())], ["row", "vec_id", "size", "ints"]
            )

    return cut(whole.mapInArrow(run, "row bigint, vec_id bigint, size int, ints binary"))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query by integer inner product.

    Components become floor(scale * x). Queries are the rows where `is_query` (a condition on
    vec_id) holds; candidates are all rows but the query's own. Equal scores go by the smaller
    vec_id, rows without one last. Vectors that are null, hold null or non-finite components, or
    2^27 and more after scaling, take no part; vectors of another size than the query's are not
    comparable and no candidates, and empty ones score 0 with each other. Repeated rows are rows of
    their own. Other columns are ignored.
    """
    spark = rows.sparkSession
    with scratch(spark), settings(spark, BRIEF_SHUFFLES):
        vectors = indexed(rows, scale)
        queries = cut(vectors.where(is_query))
        held = queries.agg(F.sum(F.length("ints") + 32)).first()[0] or 0
        rounds = max(1, -(-held // QUERY_BYTES))
        found = None
        for r in range(rounds):
            # a bounded share of the queries at a time, chosen by hash
            mine = queries.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r).collect()
            part = vectors.mapInArrow(
                _searcher(spark.sparkContext.broadcast(_by_size(mine)), k),
                "query bigint, query_id bigint, vec_id bigint, score bigint",
            )
            # the best of each task, so as many rows for a query as there are tasks, times k
            best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
            part = cut(
                part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"),
                keep=True,
            )
            found = part if found is None else found.unionByName(part)
        return found


def _by_size(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    """Query rows by size: row numbers, vectors, ids, all in order of the row numbers."""
    out = {}
    for size in {r["size"] for r in rows}:
        mine = sorted((r for r in rows if r["size"] == size), key=lambda r: r["row"])
        flat = np.frombuffer(b"".join(bytes(r["ints"]) for r in mine), "<i4")
        out[size] = (np.array([r["row"] for r in mine], np.int64), flat.reshape(len(mine), size), [r["vec_id"] for r in mine])
    return out


def _searcher(queries: object, k: int) -> Callable:
    """Search of one task's vectors, shard by shard; the best so far bound what the next shard must beat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        best = {s: (np.full((len(q[0]), k), NONE), np.full((len(q[0]), k), NO_ID)) for s, q in asked.items()}
        waiting: dict[int, list] = {s: [] for s in asked}
        held = dict.fromkeys(asked, 0)

        def flush(size: int) -> None:
            rows, ids, raw = zip(*waiting[size], strict=True)
            vectors = np.frombuffer(b"".join(b for part in raw for b in part), "<i4").reshape(held[size], size)
            shard = Shard(np.concatenate(rows), np.concatenate(ids), vectors)
            shard.search(asked[size][0], asked[size][1], *best[size])
            waiting[size], held[size] = [], 0

        for batch in batches:
            sizes = batch.column(2).to_numpy()
            row, raw = batch.column(0).to_numpy(), batch.column(3)
            ids = batch.column(1).fill_null(int(NO_ID)).to_numpy()
            for size in asked.keys() & set(sizes.tolist()):
                at = np.flatnonzero(sizes == size)
                while len(at):
                    take, at = np.split(at, [SHARD - held[size]])
                    waiting[size].append((row[take], ids[take], raw.take(pa.array(take)).to_pylist()))
                    held[size] += len(take)
                    if held[size] == SHARD:
                        flush(size)
        for size in asked:
            if held[size]:
                flush(size)
            scores, ids = best[size]
            there = scores > NONE
            n = there.sum(1)
            names = pa.array(asked[size][2], pa.int64())
            which = np.repeat(np.arange(len(n)), n)
            shown = ids[there]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(asked[size][0][which]),
                    names.take(pa.array(which)),
                    pa.array(shown, mask=shown == NO_ID),
                    pa.array(scores[there]),
                ],
                ["query", "query_id", "vec_id", "score"],
            )

    return run


class Shard:
    """Impact-ordered postings of at most SHARD vectors of one size, with the vectors for exact scores."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.order = np.argsort(rows, kind="stable")
        self.rows, self.ids = rows[self.order], ids
        n, size = vectors.shape
        self.vectors = vectors.astype(np.int64)
        self.floats = vectors.astype(np.float64)
        self.signs = np.sign(vectors).astype(np.float32)
        sizes = np.abs(self.vectors)
        self.largest = int(sizes.max(initial=0))
        # a posting of level l has l * step <= |component| < (l + 1) * step
        self.step = self.largest // LEVELS + 1
        levels = sizes // self.step
        # postings[d][s]: vectors with that sign in dimension d by descending level; reach[d][s][l]: those of level l or more
        self.postings, self.levels = [], []
        self.reach = np.zeros((size, 2, LEVELS + 1), np.int64)
        self.top = np.zeros((size, 2), np.int64)
        for d in range(size):
            level = levels[:, d]
            ordered = np.argsort(-level, kind="stable")
            for s, mine in enumerate((vectors[ordered, d] > 0, vectors[ordered, d] < 0)):
                ids_, held = ordered[mine], level[ordered[mine]]
                self.postings.append(ids_.astype(np.int32))
                self.levels.append(held.astype(np.float64))
                counts = np.bincount(held, minlength=LEVELS + 1)
                self.reach[d, s] = counts[::-1].cumsum()[::-1]
                self.top[d, s] = held[0] + 1 if len(held) else 0

    def search(self, rows: np.ndarray, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge this shard's members into the best `scores` and `ids` of each query."""
        for at in range(0, len(rows), 256):
            part = slice(at, at + 256)
            signs = np.sign(queries[part]).astype(np.float32)
            # postings of each vector that raise the score of each query
            agree = self.signs @ signs.T
            both = np.abs(self.signs) @ np.abs(signs).T
            raising = ((agree + both) / 2).round().astype(np.int64)
            for i, row in enumerate(rows[part]):
                self._search(int(row), queries[at + i].astype(np.int64), raising[:, i], scores[at + i], ids[at + i])

    def _search(self, row: int, query: np.ndarray, raising: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        weights = np.abs(query)
        unit = max(1, -(-int(weights.max(initial=0)) // WEIGHT))
        more, less = -(-weights // unit), weights // unit
        place = np.searchsorted(self.rows, row)
        own = self.order[place] if place < len(self.rows) and self.rows[place] == row else -1
        k, n = len(scores), len(self.vectors)
        # for sign s of the component: whether the posting raises the score
        raises = np.stack([query > 0, query < 0], 1)
        impact = int((more[:, None] * self.top).max(initial=0))
        # one sum carries the bound and, above it, the number of raising postings seen
        above = 1 << int(2 * len(query) * WEIGHT * (LEVELS + 1)).bit_length()
        total = np.zeros(n)
        done = np.zeros((len(query), 2), np.int64)
        least = max(1, impact // FIRST)
        floor = scores[-1]
        while True:
            # segments of level l whose contribution more * (l + 1) reaches `least`
            with np.errstate(divide="ignore"):
                low = np.where(more > 0, np.ceil(least / np.maximum(more, 1)) - 1, LEVELS)
            ends = np.take_along_axis(self.reach, np.clip(low, 0, LEVELS).astype(np.int64)[:, None, None], 2)[:, :, 0]
            ends = np.where(more[:, None] > 0, np.maximum(ends, done), 0)
            total += self._walk(done, ends, raises, more, less, above, n)
            done = ends
            seen = np.floor(total / above + 0.5)
            bound = total - seen * above + (raising - seen) * (least - 1)
            real = bound * (unit * self.step)
            if own >= 0:
                real[own] = -1e300
            if floor == NONE:
                # no k-th best known: the exact scores of the most promising give a first one
                first = np.argpartition(-real, min(n - 1, 4 * k))[: 4 * k + 1]
                known = np.concatenate([scores, self._exact(query, first[first != own])])
                floor = np.partition(known, -k)[-k]
            # a float bound may be off by its last digits, the exact score is not
            members = np.flatnonzero(real + np.abs(real) * 1e-9 + 1e-6 >= floor)
            if len(members) <= max(4 * k, n * FEW) or least == 1:
                break
            least = max(1, least // 2)
        members = members[members != own]
        self._merge(self._exact(query, members), self.ids[members], scores, ids)

    def _walk(
        self, done: np.ndarray, ends: np.ndarray, raises: np.ndarray, more: np.ndarray, less: np.ndarray, above: int, n: int
    ) -> np.ndarray:
        """What the next segments add to each vector's bound and count."""
        took, levels, slope, start = [], [], [], []
        lengths = (ends - done).ravel()
        for j in np.flatnonzero(lengths):
            d, s = divmod(int(j), 2)
            a, b = done[d, s], ends[d, s]
            took.append(self.postings[j][a:b])
            levels.append(self.levels[j][a:b])
            # a raising posting counts its upper edge, a lowering one its lower edge
            slope.append(more[d] if raises[d, s] else -less[d])
            start.append(more[d] + above if raises[d, s] else 0)
        if not took:
            return np.zeros(n)
        held = lengths[lengths > 0]
        weight = np.concatenate(levels)
        weight *= np.repeat(np.array(slope, np.float64), held)
        weight += np.repeat(np.array(start, np.float64), held)
        return np.bincount(np.concatenate(took), weight, n)

    def _exact(self, query: np.ndarray, members: np.ndarray) -> np.ndarray:
        if self.largest * int(np.abs(query).max(initial=0)) * max(1, len(query)) < 1 << 53:
            return (self.floats[members] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[members] @ query

    @staticmethod
    def _merge(exact: np.ndarray, names: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Put those with an equal or better score among the best, by score and then id."""
        enter = exact >= scores[-1]
        exact, names = np.concatenate([scores, exact[enter]]), np.concatenate([ids, names[enter]])
        best = np.lexsort((names, -exact))[: len(scores)]
        scores[:], ids[:] = exact[best], names[best]
