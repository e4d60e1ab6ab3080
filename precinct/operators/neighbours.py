"""Nearest-point and radius operators over adaptive tiles (see `tiles`)."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.operators import blocks
from precinct.operators import tiles as T
from precinct.runtime import HOT_ROWS, attach, cut, send_to_workers, spread

# Tiles that a task meets for a block of neighbouring tiles.
MET_TILES = 20_000
# Distances that are worked out at a time: more would leave the processor's cache.
DISTANCES = 1 << 16

send_to_workers(__name__)


def knn_distance(
    left: DataFrame,
    right: DataFrame,
    k: int,
    left_id: str,
    right_id: str,
    left_xy: tuple[str, str],
    right_xy: tuple[str, str],
) -> DataFrame:
    """Left rows plus `mean_distance` to their k nearest right rows, in coordinate units.

    k shrinks to the number of right rows; a right row at the same place is a neighbour
    at distance 0. The distance is null for left rows without a location, and when there
    is no right row at all.
    """
    dims = ["knn_x", "knn_y"]
    rows = left.withColumns({d: F.col(c) for d, c in zip(dims, left_xy)})
    others = right.select(right_id, *[F.col(c).alias(d) for d, c in zip(dims, right_xy)])
    best, k = nearest_sets(T.locations(rows, left_id, dims), T.locations(others, right_id, dims), dims, k, named=False)
    if best is None:
        return rows.withColumn("mean_distance", F.lit(None).cast("double")).drop(*dims)
    weighted = cut(best.selectExpr(*dims, "w", f"{_mean_of_nearest('best', k)} AS mean_distance"))
    lost = rows.where("knn_x IS NULL OR knn_y IS NULL").withColumn("mean_distance", F.lit(None).cast("double"))
    return attach(rows, weighted, dims, "w").unionByName(lost).drop(*dims)


def nearest_sets(
    left: DataFrame, right: DataFrame, dims: list[str], k: int, named: bool = True
) -> tuple[DataFrame | None, int]:
    """(pid, w, dims…, best) of left locations: `best` lists (d2, w, first) of their nearest right
    locations, closest first, holding at least k rows; without `first` unless `named`. Both sides have first, w, dims.

    Also gives the k used, at most the number of right rows; None when a side is empty.
    """
    # the two sides are independent, so their jobs run side by side
    with ThreadPoolExecutor(2) as pool:
        # narrow right tiles bound the k-th distance well and leave few points to sort
        tree, mine = pool.map(lambda side: T.build(side[0], dims, side[1]), ((right, max(16, 4 * k)), (left, T.CAPACITY)))
    if tree is None or mine is None:
        return None, 0

    k = min(k, tree.root["w"])
    near = T.nearest(mine.tiles, tree, k)
    # a tile's nodes stand in its row, so that no pair of a point and a node is shuffled to find its bound
    node = F.struct("b", "bw", "bound", "box.*")
    nodes = near.groupBy(F.col("a").alias("tile")).agg(F.collect_list(node).alias("nodes"))
    here = ", ".join(f"p.{d} AS {e}_{d}" for d in dims for e in ("lo", "hi"))
    spots = mine.tiles.join(nodes, "tile").selectExpr("explode(pts) AS p", "nodes").selectExpr("p", "nodes", f"struct({here}) AS here")
    # the same bound again, now for the single point instead of its whole tile
    far = f"transform(nodes, n -> CASE WHEN n.bw >= {k} THEN {T._reach2(dims, 'here.', 'n.b')} END)"
    kept = f"filter(nodes, n -> {T._gap2(dims, 'here.', 'n.b')} <= least(n.bound, sure))"
    chosen = (
        spots.selectExpr("p", "nodes", "here", f"array_min({far}) AS sure")
        .selectExpr("p", f"explode(transform({kept}, n -> struct(n.b AS tile, least(n.bound, sure) AS bound))) AS n")
        .select("p.pid", "p.w", *[f"p.{d}" for d in dims], "n.bound", "n.tile")
    )

    arrays = tree.tiles.select("tile", "pts")
    if mine.root["n"] > HOT_ROWS:
        # many left points may share one right tile
        chosen = cut(chosen)
        share = chosen.groupBy("tile").agg(F.count("*").alias("asked"))
        met = attach(chosen, cut(arrays.join(share, "tile")), ["tile"], "asked")
    else:
        met = spread(chosen, "tile").join(spread(arrays, "tile"), "tile")

    gaps = f"transform(pts, q -> struct({T.distance2(dims, 'here', 'q')} AS d2, q.w AS w{', q.first AS first' if named else ''}))"
    found = f"filter({gaps}, c -> c.d2 <= bound)"
    best = (
        met.withColumn("here", F.struct(*dims))
        .selectExpr("pid", "w", *dims, f"slice(array_sort({found}), 1, {k}) AS best")
        .groupBy("pid", "w", *dims)
        .agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("best"))
    )
    return best, k


def _mean_of_nearest(best: str, k: int) -> str:
    """SQL of the mean distance of the first k rows of a sorted (d2, w) array, w rows per entry."""
    start = f"struct(CAST({k} AS BIGINT) AS open, 0D AS total)"
    add = "struct(acc.open - least(acc.open, e.w) AS open, acc.total + least(acc.open, e.w) * sqrt(e.d2) AS total)"
    return f"aggregate({best}, {start}, (acc, e) -> {add}, acc -> acc.total / {float(k)}D)"


def nearest_distance(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    left_xy: tuple[str, str],
    right_xy: tuple[str, str],
) -> DataFrame:
    """Left rows plus `min_distance` to the closest right row."""
    return knn_distance(left, right, 1, left_id, right_id, left_xy, right_xy).withColumnRenamed(
        "mean_distance", "min_distance"
    )


def eps_neighbours(rows: DataFrame, row_id: str, dims: list[str], eps: float) -> DataFrame:
    """Rows plus `n_neighbours`, the rows within `eps` in the space of `dims`, itself included.

    Rows lacking a coordinate have no neighbours, not even themselves.
    """
    unplaced = " OR ".join(f"{d} IS NULL" for d in dims)
    lost = rows.where(unplaced).withColumn("n_neighbours", F.lit(0).cast("bigint"))
    locs, root, plain = places(rows, row_id, dims)
    if not root["n"]:
        return lost
    tiles = blocks.counted(blocks.lay(locs, root, plain, eps, MET_TILES), eps, DISTANCES)
    wide = len(dims) + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.asarray(batch.column(0).flatten()).reshape(-1, wide)
            columns = [*(pa.array(points[:, d + 1]) for d in range(wide - 1)), pa.array(points[:, 0].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1).flatten()], [*plain, "w", "n_neighbours"])

    schema = ", ".join([*[f"{d} double" for d in plain], "w bigint, n_neighbours bigint"])
    counted = cut(tiles.select("numbers", "counts").mapInArrow(each, schema).withColumnsRenamed(dict(zip(plain, dims))))
    return attach(rows, counted, dims, "w").unionByName(lost)


def places(rows: DataFrame, row_id: str, dims: list[str]) -> tuple[DataFrame, dict, list[str]]:
    """The locations with a key and plain names of their dimensions, written once, the figures of all, and those names."""
    plain = [f"_d{i}" for i in range(len(dims))]
    named = T.locations(rows, row_id, dims).select("w", "first", *[F.col(d).cast("double").alias(p) for d, p in zip(dims, plain)])
    return *T.keyed(named, plain), plain
