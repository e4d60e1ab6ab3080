"""K-means by the filtering algorithm over tiles.

A run of neighbouring tiles whose box lies closer to one centre than to any other adds its stored
sums as a whole; other runs are halved, and only single tiles on the border of two clusters are
read point by point. So a round costs as many steps as the borders cross tiles, however many rows
and centres there are.

While the centres move little, most points cannot change sides. Their sums are then kept, and rounds read only
a written table of the others, until some centre has moved further than was allowed for; and so on
with ever smaller tables as the centres come to rest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.operators import tiles as T
from precinct.operators.curve import keyed_along, tile_ends
from precinct.operators.neighbours import nearest_sets
from precinct.runtime import attach, cut, scratch, send_to_workers

ROUNDS = 100
# Fixed value: a round that moves the centres by less in all (squared) is the last.
TOLERANCE = 1e-4
# Locations drawn for each centre to pick the first centres from.
DRAWN_PER_CENTRE = 20
# Bytes of centres that every task may hold; more are met through tiles of their own.
CENTRE_BYTES = 32 << 20
# Steps of the present size that centres may go before settled points are looked at again, and how much
# smaller these must have become for another table of unsettled points.
STEPS_AHEAD = 8
FINER = 4
# Distances that one step works out for neighbouring tiles at once.
TOGETHER = 1 << 16
# Locations of a tile at most.
CAPACITY = T.CAPACITY

send_to_workers(__name__)


@dataclass(frozen=True)
class Centres:
    """Cluster centres over named features."""

    names: list[str]
    values: list[list[float]]

    def table(self, spark) -> DataFrame:
        schema = ", ".join(["centre int", *[f"`{n}` double" for n in self.names]])
        return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(self.values)], schema)

    def nearest(self, df: DataFrame, label: str = "kmeans_label") -> DataFrame:
        """Rows plus the number of the nearest centre, for tables with few rows or few centres."""
        shared = df.sparkSession.sparkContext.broadcast(np.array(self.values, float))

        def near(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                points = np.column_stack([c.to_numpy(dtype=float) for c in columns])
                found = [_distances2(part, shared.value).argmin(1) for part in np.array_split(points, len(points) // 1024 + 1)]
                yield pd.Series(np.concatenate(found).astype(np.int32))

        return df.withColumn(label, F.pandas_udf(near, "int")(*self.names))


def kmeans(
    df: DataFrame,
    names: list[str],
    k: int,
    seed: int = 42,
    start: list[list[float]] | None = None,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
    label: str = "kmeans_label",
) -> tuple[DataFrame, Centres]:
    """Rows plus `kmeans_label`, each row once, and the centres.

    A missing feature counts as its mean, 0 when scaled. Ties go to the smaller number; a centre
    without rows stays where it is. With fewer distinct locations than `k` each is a centre.
    """
    dims = [f"_k{i}" for i in range(len(names))]
    filled = df.withColumns({d: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for d, n in zip(dims, names, strict=True)})
    locs, root = T.keyed(T.locations(filled.withColumn("_none", F.lit(None).cast("string")), "_none", dims), dims)
    # no level of a tree is walked here, so none is built
    tree = T.Tiles(dims, locs, None, [], [], root)
    if not root["n"]:
        return df.withColumn(label, F.lit(None).cast("int")), Centres(names, [])
    centres = np.array(start if start is not None else _first_centres(tree, k, seed), float)
    stored = _stored(tree)
    piles = [_Pile(stored, np.zeros((len(centres), len(names) + 1)), centres, math.inf, math.inf)]
    try:
        for _ in range(rounds):
            totals = piles[-1].settled + _totals(piles[-1].rows, tree, centres)
            moved = np.where(totals[:, :1] > 0, totals[:, 1:] / np.maximum(totals[:, :1], 1), centres)
            shift, step = float(((moved - centres) ** 2).sum()), _furthest(moved, centres)
            centres = moved
            if shift <= tolerance:
                break
            while _furthest(centres, piles[-1].base) > piles[-1].slack:
                piles.pop().scope.close()
            _go_on(piles, centres, step)
    finally:
        while piles:
            piles.pop().scope.close()
    located = tree.locs.join(_labels(stored, tree, centres), "pid").select(*dims, "w", F.col("label").alias(label))
    return attach(filled, cut(located), dims, "w").select(*df.columns, label), Centres(names, centres.tolist())


def _first_centres(tree: T.Tiles, k: int, seed: int) -> np.ndarray:
    """Centres far from each other among a seeded draw of DRAWN_PER_CENTRE * k locations, weighed by rows.

    Each location draws by its own coordinates, so the draw is the same however the table is split.
    """
    draw = F.xxhash64(*tree.dims, F.lit(seed))
    drawn = tree.locs.select(draw.alias("draw"), "w", *tree.dims).orderBy("draw", *tree.dims).limit(DRAWN_PER_CENTRE * k)
    rows = drawn.collect()
    points = np.array([[r[d] for d in tree.dims] for r in rows])
    weights = np.array([r["w"] for r in rows], float)
    random = np.random.default_rng(seed)
    picked = [int(random.choice(len(points), p=weights / weights.sum()))]
    gaps = ((points - points[picked[0]]) ** 2).sum(1)
    while len(picked) < min(k, len(points)):
        mass = gaps * weights
        # some of several draws comes closest to what the centres leave over
        tries = random.choice(len(points), size=2 + int(math.log(k)), p=mass / mass.sum()) if mass.sum() > 0 else []
        if not len(tries):
            break
        after = np.minimum(gaps, ((points[None] - points[tries][:, None]) ** 2).sum(2))
        best = int((after * weights).sum(1).argmin())
        picked.append(int(tries[best]))
        gaps = after[best]
    return points[picked]


def _tile_ends(keys: np.ndarray) -> list[int]:
    """Where tiles of sorted keys end: boxes are halved until one holds CAPACITY locations at most."""
    return tile_ends(keys, CAPACITY)


def _stored(tree: T.Tiles) -> DataFrame:
    """Tiles along the curve, so that a task's tiles are neighbours; points packed as numbers."""
    size = len(tree.dims)
    parts = int(tree.locs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["tile", "pids", "numbers", *[f"{e}_{d}" for e in ("lo", "hi") for d in tree.dims]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.array([0, *_tile_ends(np.asarray(batch.column(0)))], np.int64)
            if len(ends) > 1:
                starts = ends[:-1]
                points = np.column_stack([np.asarray(c).astype(float) for c in batch.columns[2:]])
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends * wide, pa.int32()), x)
                    for x, wide in ((batch.column(1), 1), (pa.array(points.ravel()), size + 1))
                ]
                edges = [pa.array(f.reduceat(points[:, 1 + d], starts)) for f in (np.minimum, np.maximum) for d in range(size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), *lists, *edges], names)

    rows = keyed_along(tree.locs, tree.root, tree.dims).repartitionByRange(parts, "tile", *tree.dims).sortWithinPartitions("tile", *tree.dims)
    schema = ", ".join(["tile bigint, pids array<bigint>, numbers array<double>", *[f"{n} double" for n in names[3:]]])
    return cut(rows.mapInArrow(run, schema))


@dataclass
class _Pile:
    """Tiles with the points that may change sides while no centre is further than `slack` from its place in `base`."""

    rows: DataFrame
    settled: np.ndarray  # per centre the rows and sums of all other points
    base: np.ndarray
    slack: float
    tried: float  # the slack from which the next pile was last split off
    scope: ExitStack = field(default_factory=ExitStack)


def _furthest(a: np.ndarray, b: np.ndarray) -> float:
    """How far the centre that moved most has moved."""
    return float(np.sqrt(((a - b) ** 2).sum(1)).max(initial=0.0))


def _go_on(piles: list[_Pile], centres: np.ndarray, step: float) -> None:
    """Split another pile off the last one, if the centres' steps have become small enough since the last try."""
    last, slack = piles[-1], STEPS_AHEAD * step
    if last.tried == math.inf:
        last.tried = slack
    # a pile must not outlast the one it is taken from
    if centres.nbytes > CENTRE_BYTES or not 0 < slack <= last.tried / FINER or _furthest(centres, last.base) + slack > last.slack:
        return
    last.tried = slack
    scope = ExitStack()
    scope.enter_context(scratch(last.rows.sparkSession))
    pile = _Pile(last.rows, last.settled, centres, slack, slack, scope)
    piles.append(pile)
    split = _split(last.rows, centres, slack)
    pile.rows = split.where("tile IS NOT NULL")
    # the sums of settled points stand in rows without a tile, a row for each task and centre
    found = split.where("tile IS NULL").select(F.element_at("pids", 1).cast("int").alias("centre"), F.posexplode("numbers").alias("place", "total"))
    pile.settled = last.settled + _summed(found, centres.shape)


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sums of `total` by centre and place, added in the order of size.

    Equal parts thus give equal sums in every round, and rounds end when no point changes sides.
    """
    out = np.zeros((shape[0], shape[1] + 1))
    total = F.aggregate(F.sort_array(F.collect_list("total")), F.lit(0.0), lambda a, x: a + x)
    for r in parts.groupBy("centre", "place").agg(total.alias("total")).collect():
        out[r["centre"], r["place"]] = r["total"]
    return out


def _split(rows: DataFrame, centres: np.ndarray, slack: float) -> DataFrame:
    """Tiles of the points that may get another nearest centre while none goes further than `slack`, and the sums of the others."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    k, size = centres.shape
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((k, size + 1))
        for batch in batches:
            flat, ends = _points(batch, size)
            pids, left = np.asarray(batch.column(1).flatten()), np.zeros(len(flat), bool)

            def whole(a: int, b: int, c: int, flat: np.ndarray = flat, ends: np.ndarray = ends) -> None:
                part = flat[ends[a] : ends[b]]
                totals[c] += np.concatenate([[part[:, 0].sum()], part[:, 0] @ part[:, 1:]])

            def single(a: int, b: int, points: np.ndarray, near: np.ndarray, left: np.ndarray = left, ends: np.ndarray = ends) -> None:
                gaps = np.sqrt(_distances2(points[:, 1:], shared.value[near]))
                two = np.partition(gaps, 1, axis=1)
                may = two[:, 1] * (1 - 1e-9) <= two[:, 0] + 2 * slack
                left[ends[a] : ends[b]] = may
                _add(totals, near[gaps.argmin(1)][~may], points[~may])

            _walk(batch, shared.value, whole, single, TOGETHER, slack)
            before = np.concatenate([[0], left.cumsum()])[ends]
            some = np.flatnonzero(np.diff(before))
            if len(some):
                points, starts = flat[left], before[some]
                edges = [f.reduceat(points[:, 1 + d], starts) for f in (np.minimum, np.maximum) for d in range(size)]
                offsets = np.append(starts, len(points))
                lists = [
                    pa.ListArray.from_arrays(pa.array(offsets * wide, pa.int32()), pa.array(x))
                    for x, wide in ((pids[left], 1), (points.ravel(), size + 1))
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), *lists, *map(pa.array, edges)], names)
        found = np.flatnonzero(totals[:, 0])
        nulls = [pa.nulls(len(found), pa.float64())] * (2 * size)
        columns = [
            pa.nulls(len(found), pa.int64()), pa.array([[c] for c in found.tolist()], pa.list_(pa.int64())),
            pa.array(totals[found].tolist(), pa.list_(pa.float64())), *nulls,
        ]
        yield pa.RecordBatch.from_arrays(columns, names)

    return cut(rows.mapInArrow(run, rows.schema))


def _points(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and coordinates of all points of a batch, and where each tile's points begin and end."""
    numbers = batch.column(2)
    flat = np.asarray(numbers.flatten()).reshape(-1, size + 1)
    return flat, np.concatenate([[0], np.asarray(numbers.value_lengths()).cumsum() // (size + 1)])


def _add(totals: np.ndarray, labels: np.ndarray, points: np.ndarray) -> None:
    """Add the rows and the weighed coordinates of points to their centres' totals."""
    totals[:, 0] += np.bincount(labels, points[:, 0], len(totals))
    for d in range(1, totals.shape[1]):
        totals[:, d] += np.bincount(labels, points[:, 0] * points[:, d], len(totals))


def _distances2(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(centres)))
    for d in range(points.shape[1]):
        gap = points[:, d, None] - centres[None, :, d]
        out += gap * gap
    return out


def _walk(
    batch: pa.RecordBatch, centres: np.ndarray, whole: Callable, single: Callable, together: int = 0, slack: float = 0.0
) -> None:
    """Go through a batch of neighbouring tiles.

    Calls `whole(first, last, centre)` for runs of tiles that have one nearest centre, however each centre
    moves by up to `slack`, and `single(first, last, points, candidates)` for the other tiles: one by one, or
    runs of them that take up to `together` distances.
    """
    size = centres.shape[1]
    columns = [np.asarray(c) for c in batch.columns[3:]]
    low, high = np.column_stack(columns[:size]), np.column_stack(columns[size:])
    flat, ends = _points(batch, size)
    waiting = [(0, batch.num_rows, np.arange(len(centres)))] if batch.num_rows else []
    while waiting:
        a, b, near = waiting.pop()
        lo, hi = low[a:b].min(0), high[a:b].max(0)
        some = centres[near]
        least = (np.maximum(np.maximum(lo - some, some - hi), 0) ** 2).sum(1)
        most = (np.maximum(np.abs(some - lo), np.abs(some - hi)) ** 2).sum(1)
        # the margin keeps a centre that only rounding would rule out
        reach = (math.sqrt(most.min()) + 2 * slack) ** 2
        near = near[least <= reach * (1 + 1e-9)]
        if len(near) == 1:
            whole(a, b, int(near[0]))
        elif b - a == 1 or (ends[b] - ends[a]) * len(near) <= together:
            single(a, b, flat[ends[a] : ends[b]], near)
        else:
            middle = (a + b) // 2
            waiting += [(a, middle, near), (middle, b, near)]


def _totals(stored: DataFrame, tree: T.Tiles, centres: np.ndarray) -> np.ndarray:
    """Per centre its rows and the sums of their coordinates."""
    k, size = centres.shape
    if centres.nbytes > CENTRE_BYTES:
        found = tree.locs.join(_searched(tree, centres), "pid").groupBy("label")
        sums = found.agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(d)).alias(d) for d in tree.dims]).collect()
        out = np.zeros((k, size + 1))
        for r in sums:
            out[r["label"]] = [r["w"], *[r[d] for d in tree.dims]]
        return out
    shared = stored.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((k, size + 1))
        for batch in batches:
            flat, ends = _points(batch, size)
            weighed = np.column_stack([flat[:, 0], flat[:, 1:] * flat[:, :1]])
            before = np.vstack([np.zeros(size + 1), weighed.cumsum(0)])[ends]

            def whole(a: int, b: int, c: int, before: np.ndarray = before) -> None:
                totals[c] += before[b] - before[a]

            def single(a: int, b: int, points: np.ndarray, near: np.ndarray) -> None:
                _add(totals, near[_distances2(points[:, 1:], shared.value[near]).argmin(1)], points)

            _walk(batch, shared.value, whole, single, TOGETHER)
        found = np.flatnonzero(totals[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array(totals[found].tolist(), pa.list_(pa.float64()))], ["centre", "totals"]
        )

    # a row per task and centre; their sums are as many numbers as the centres have
    part = stored.mapInArrow(run, "centre int, totals array<double>")
    return _summed(part.select("centre", F.posexplode("totals").alias("place", "total")), centres.shape)


def _labels(stored: DataFrame, tree: T.Tiles, centres: np.ndarray) -> DataFrame:
    """(pid, label): the nearest centre of each location."""
    if centres.nbytes > CENTRE_BYTES:
        return _searched(tree, centres)
    shared = stored.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pids = batch.column(1)
            labels = np.zeros(len(pids.flatten()), np.int32)
            ends = np.concatenate([[0], np.asarray(pids.value_lengths()).cumsum()])

            def whole(a: int, b: int, c: int, labels: np.ndarray = labels, ends: np.ndarray = ends) -> None:
                labels[ends[a] : ends[b]] = c

            def single(
                a: int, b: int, points: np.ndarray, near: np.ndarray, labels: np.ndarray = labels, ends: np.ndarray = ends
            ) -> None:
                labels[ends[a] : ends[b]] = near[_distances2(points[:, 1:], shared.value[near]).argmin(1)]

            _walk(batch, shared.value, whole, single, TOGETHER)
            yield pa.RecordBatch.from_arrays([pids.flatten(), pa.array(labels)], ["pid", "label"])

    return stored.mapInArrow(run, "pid bigint, label int")


def _searched(tree: T.Tiles, centres: np.ndarray) -> DataFrame:
    """(pid, label) by a search over tiles of the centres, for more of them than a task should hold."""
    dims = tree.dims
    spark = tree.locs.sparkSession
    table = Centres(dims, centres.tolist()).table(spark)
    # the search orders equal distances by text, so the numbers are padded
    named = table.select(F.lpad(F.col("centre").cast("string"), 12, "0").alias("first"), F.lit(1).cast("bigint").alias("w"), *dims)
    distinct = cut(named.groupBy(*dims).agg(F.min("first").alias("first"), F.sum("w").alias("w")))
    best, _ = nearest_sets(tree.locs, distinct, dims, 1)
    return tree.locs.join(best.select(*dims, F.col("best")[0]["first"].cast("int").alias("label")), dims).select("pid", "label")
