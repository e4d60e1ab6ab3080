"""Points within a radius of each other, by blocks of neighbouring points.

Locations are sorted along a curve once and cut into tiles, and runs of tiles into blocks. The table of the
blocks' boxes is small and known to every task. A block that lies within the radius as a whole counts as one
number; of the others a block gets only the points that its own may reach or miss, and one numpy step per tile
meets them. So a pair of blocks is a row of arrays, and no pair of tiles or points is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.operators import tiles as T
from precinct.operators.curve import keyed_along, tile_ends
from precinct.runtime import cut, send_to_workers, spread

CAPACITY = T.CAPACITY
# As many blocks as this if they then hold no fewer and no more locations than the others say.
BLOCKS = 256
LEAST = 4_096
MOST = 65_536
# Tiles after which the groups of linked nodes are worked out anew.
OFTEN = 32

send_to_workers(__name__)


@dataclass(frozen=True)
class Table:
    """The boxes of all blocks, their rows, and into how many parts the work of each is dealt."""

    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    weight: np.ndarray
    tiles: np.ndarray
    parts: np.ndarray

    def place(self, block: int) -> int:
        return int(np.searchsorted(self.ids, block))

    def near(self, i: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that may hold points within reach of block i, and which of them lie within reach as a whole."""
        gap2, reach2 = _box_gaps(self.low[i], self.high[i], self.low, self.high)
        some = np.flatnonzero(gap2 <= limit)
        return some, reach2[some] <= limit


@dataclass(frozen=True)
class Laid:
    """Locations as tiles of blocks: block, w, pids, numbers (rows and coordinates of each point), lo_…, hi_…."""

    tiles: DataFrame
    dims: list[str]
    table: Table


def _box_gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared smallest and largest distances of a box to others, added in the order of the dimensions.

    Rounding is monotone, so they bound the squared distances of points as these are worked out here.
    """
    gap2, reach2 = np.zeros(len(lows)), np.zeros(len(lows))
    for d in range(len(low)):
        below, above = low[d] - highs[:, d], lows[:, d] - high[d]
        gap = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(-below, -above)
        gap2 += gap * gap
        reach2 += far * far
    return gap2, reach2


def lay(locs: DataFrame, root: dict, dims: list[str], eps: float, met_tiles: int) -> Laid:
    """Tiles of blocks of the locations, written once. The work of a block is dealt so that none meets many more than `met_tiles`."""
    wide = len(dims) + 1
    parts = int(locs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(max(root["n"] // BLOCKS, LEAST), MOST)
    boxes = [f"{e}_{i}" for e in ("lo", "hi") for i in range(len(dims))]
    names = ["block", "w", "pids", "numbers", *boxes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []

        def whole() -> Iterator[pa.RecordBatch]:
            nonlocal block
            rows = pa.Table.from_batches(waiting)
            waiting.clear()
            keys, pids = (rows.column(i).combine_chunks() for i in range(2))
            keys = np.asarray(keys)
            points = np.column_stack([np.asarray(c).astype(float) for c in rows.columns[2:]])
            at = 0
            for end in tile_ends(keys, most):
                ends = np.array([0, *tile_ends(keys[at:end], CAPACITY)], np.int32)
                some, starts = points[at:end], ends[:-1]
                edges = [pa.array(f.reduceat(some[:, 1 + d], starts)) for f in (np.minimum, np.maximum) for d in range(wide - 1)]
                rows_of = np.add.reduceat(some[:, 0], starts).astype(np.int64)
                columns = [
                    pa.array(np.full(len(starts), block)), pa.array(rows_of),
                    _lists(ends, pids[at:end]), _lists(ends * wide, some.ravel()),
                ]
                yield pa.RecordBatch.from_arrays([*columns, *edges], names)
                at, block = end, block + 1

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= 2 * most:
                yield from whole()
        if waiting:
            yield from whole()

    rows = keyed_along(locs, root, dims).repartitionByRange(parts, "tile", *dims).sortWithinPartitions("tile", *dims)
    schema = ", ".join(["block bigint, w bigint, pids array<bigint>, numbers array<double>", *[f"{n} double" for n in boxes]])
    tiles = cut(rows.mapInArrow(run, schema))
    figures = [F.min(b) if b.startswith("lo") else F.max(b) for b in boxes]
    figures = sorted(tuple(r) for r in tiles.groupBy("block").agg(F.sum("w"), F.count("*"), *figures).collect())
    ids, weights, sizes = (np.array([r[i] for r in figures], np.int64) for i in range(3))
    edges = np.array([r[3:] for r in figures], float).reshape(len(ids), -1)
    low, high = edges[:, : len(dims)], edges[:, len(dims) :]
    table = Table(ids, low, high, weights, sizes, np.ones(len(ids), np.int64))
    for i in range(len(ids)):
        some, inside = table.near(i, eps * eps)
        table.parts[i] = max(1, -(-int(sizes[some[~inside]].sum()) // met_tiles))
    return Laid(tiles, dims, table)


def _lists(ends: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _flat(table: pa.Table | pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and where each list begins and ends."""
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten()), np.concatenate([[0], np.asarray(column.value_lengths()).cumsum()]).astype(np.int64)


class _Tiles:
    """Points of tiles as one array a dimension, with the tiles' boxes."""

    def __init__(self, points: np.ndarray, starts: np.ndarray) -> None:
        sizes = np.diff(starts)
        self.starts = np.concatenate([[0], sizes[sizes > 0].cumsum()]).astype(np.int64)
        self.weight = np.ascontiguousarray(points[:, 0])
        self.at = [np.ascontiguousarray(points[:, d]) for d in range(1, points.shape[1])]
        begins = self.starts[:-1]
        bounds = [[f.reduceat(c, begins) if len(begins) else np.zeros(0) for c in self.at] for f in (np.minimum, np.maximum)]
        self.low, self.high = (np.column_stack(b) for b in bounds)
        self.rows = np.add.reduceat(self.weight, begins) if len(begins) else np.zeros(0)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def points(self, tiles: np.ndarray) -> np.ndarray:
        """Places of all points of some tiles."""
        lengths = self.starts[tiles + 1] - self.starts[tiles]
        offsets = lengths.cumsum() - lengths
        return np.repeat(self.starts[tiles] - offsets, lengths) + np.arange(lengths.sum())


def _point_gaps(low: np.ndarray, high: np.ndarray, at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Squared smallest and largest distances of a box to points."""
    gap2, reach2 = np.zeros(len(at[0])), np.zeros(len(at[0]))
    for d, x in enumerate(at):
        below, above = low[d] - x, x - high[d]
        gap = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(-below, -above)
        gap2 += gap * gap
        reach2 += far * far
    return gap2, reach2


def _close(mine: list[np.ndarray], theirs: list[np.ndarray], limit: float, step: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Which of my points are within reach of theirs, some of theirs at a time."""
    size = max(1, step // max(1, len(mine[0])))
    for a in range(0, len(theirs[0]), size):
        some = slice(a, min(a + size, len(theirs[0])))
        total = None
        for x, y in zip(mine, theirs, strict=True):
            gap = x[:, None] - y[None, some]
            gap *= gap
            total = gap if total is None else np.add(total, gap, out=total)
        yield some, total <= limit


_SENT = "block bigint, part int, own boolean, sure double, sizes array<int>, pids array<bigint>, numbers array<double>"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of `_SENT`: (block, part, own, sure, sizes, pids, numbers) with arrays."""
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.bool_(), pa.float64()))]
    for i, kind in ((4, np.int32), (5, np.int64), (6, np.float64)):
        ends = np.concatenate([[0], np.cumsum([np.size(r[i]) for r in rows])])
        columns.append(_lists(ends, np.concatenate([np.asarray(r[i], kind).ravel() for r in rows]) if rows else np.zeros(0, kind)))
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SENT.split(", ")])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    """(block, first, last) of the runs of a batch's tiles that are of one block."""
    blocks = np.asarray(batch.column(0))
    edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(blocks[a]), a, b


def counted(laid: Laid, eps: float, step: int) -> DataFrame:
    """The tiles plus `counts`: for each point the rows within `eps` of it, itself included."""
    shared = laid.tiles.sparkSession.sparkContext.broadcast(laid.table)
    wide, limit = len(laid.dims) + 1, eps * eps

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            (flat, at), (pids, ends) = _flat(batch, "numbers"), _flat(batch, "pids")
            flat = flat.reshape(-1, wide)
            boxes = np.column_stack([np.asarray(c) for c in batch.columns[4:]])
            for block, a, b in _runs(batch):
                i = table.place(block)
                points, sizes = flat[ends[a] : ends[b]], np.diff(ends[a : b + 1])
                rows = [(block, p, True, 0.0, sizes, pids[ends[a] : ends[b]], points) for p in range(table.parts[i])]
                of = np.repeat(np.arange(b - a), sizes)
                for j, inside in zip(*table.near(i, limit)):
                    # what lies within reach as a whole is added where the block is worked on
                    if inside or (i == j and table.parts[j] == 1):
                        continue
                    low, high = table.low[j], table.high[j]
                    gap2, reach2 = _box_gaps(low, high, boxes[a:b, : wide - 1], boxes[a:b, wide - 1 :])
                    near = np.flatnonzero((gap2 <= limit)[of])
                    gap2, reach2 = _point_gaps(low, high, [points[near, d] for d in range(1, wide)])
                    sure = points[near[reach2 <= limit], 0].sum()
                    near = near[(gap2 <= limit) & (reach2 > limit)]
                    rows += _dealt(int(table.ids[j]), int(table.parts[j]), points[near], of[near], sure)
                yield _sent(rows)

    def run(sent: pa.Table) -> pa.Table:
        table = shared.value
        block, part = sent.column("block")[0].as_py(), sent.column("part")[0].as_py()
        i = table.place(block)
        near, inside = table.near(i, limit)
        # a block as narrow as that is among those within its reach
        own, others, keys = _sides(sent, wide, table.parts[i] == 1 and i not in near[inside])
        pids = keys[0]
        sure = sum(sent.column("sure").to_pylist()) + (table.weight[near[inside]].sum() if part == 0 else 0)
        counts = np.full(len(pids), sure)
        for t in range(len(own)):
            a, b = own.starts[t], own.starts[t + 1]
            whole, some = _reached(own, t, others, limit)
            counts[a:b] += whole
            mine = [c[a:b] for c in own.at]
            theirs = [c[some] for c in others.at]
            weight = others.weight[some]
            for which, close in _close(mine, theirs, limit, step):
                counts[a:b] += close @ weight[which]
        points = np.column_stack([own.weight, *own.at])
        columns = [
            pa.array(np.full(len(own), block)), _lists(own.starts, pids), _lists(own.starts * wide, points.ravel()),
            _lists(own.starts, counts.astype(np.int64)),
        ]
        return pa.table(columns, names=["block", "pids", "numbers", "counts"])

    schema = "block bigint, pids array<bigint>, numbers array<double>, counts array<bigint>"
    found = spread(laid.tiles.mapInArrow(send, _SENT), "block", "part").groupBy("block", "part").applyInArrow(run, schema)
    if (laid.table.parts > 1).any():
        add = "aggregate(slice(parts, 2, size(parts)), parts[0], (a, x) -> zip_with(a, x, (p, q) -> p + q))"
        found = found.groupBy("block", F.expr("pids[0]")).agg(
            F.first("pids").alias("pids"), F.first("numbers").alias("numbers"), F.collect_list("counts").alias("parts")
        ).selectExpr("block", "pids", "numbers", f"{add} AS counts")
    return cut(found)


def _dealt(block: int, parts: int, points: np.ndarray, of: np.ndarray, sure: float, pids: np.ndarray | None = None) -> list[tuple]:
    """Rows of `_SENT` that bring points of some tiles to a block, its tiles dealt to the parts."""
    rows = [(block, 0, False, float(sure), [], [], [])] if sure else []
    for p in range(parts):
        mine = of % parts == p if parts > 1 else slice(None)
        some = of[mine]
        if len(some):
            sizes = np.unique(some, return_counts=True)[1]
            rows.append((block, p, False, 0.0, sizes, [] if pids is None else pids[mine], points[mine]))
    return rows


def _pieces(sent: pa.Table, wide: int, own: bool | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points and sizes of tiles of the block's own rows, of the others, or of all."""
    rows = sent if own is None else sent.filter(pc.equal(sent.column("own"), own))
    if rows.num_rows:
        yield _flat(rows, "numbers")[0].reshape(-1, wide), _flat(rows, "sizes")[0]


def _joined(pieces: list[tuple[np.ndarray, np.ndarray]], wide: int) -> tuple[np.ndarray, np.ndarray]:
    if not pieces:
        return np.zeros((0, wide)), np.zeros(1, np.int64)
    points, sizes = (np.concatenate(x) for x in zip(*pieces))
    return points, np.concatenate([[0], sizes.cumsum()]).astype(np.int64)


def _sides(sent: pa.Table, wide: int, among: bool, keys: int = 1) -> tuple[_Tiles, _Tiles, list[np.ndarray]]:
    """The block's own tiles, the tiles it meets (its own `among` them), and what the own rows list as keys of the points."""
    own = _Tiles(*_joined([*_pieces(sent, wide, True)], wide))
    others = _Tiles(*_joined([*_pieces(sent, wide, None if among else False)], wide))
    flat, at = _flat(sent.filter(sent.column("own")), "pids")
    parts = [np.split(flat[a:b], keys) for a, b in zip(at, at[1:])]
    return own, others, [np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]) for k in range(keys)]


def _reached(own: _Tiles, t: int, others: _Tiles, limit: float) -> tuple[float, np.ndarray]:
    """Rows of other tiles and points that are within reach of all points of tile t, and the places of points that may be."""
    low, high = own.low[t], own.high[t]
    gap2, reach2 = _box_gaps(low, high, others.low, others.high)
    inside = reach2 <= limit
    whole = others.rows[inside].sum()
    some = others.points(np.flatnonzero((gap2 <= limit) & ~inside))
    gap2, reach2 = _point_gaps(low, high, [c[some] for c in others.at])
    inside = reach2 <= limit
    return whole + others.weight[some[inside]].sum(), some[(gap2 <= limit) & ~inside]


def linked(laid: Laid, tiles: DataFrame, eps: float, min_samples: int, step: int) -> tuple[DataFrame, DataFrame] | None:
    """What dense points there are: (pid, node, core, many) and (u, v); None without any.

    `tiles` are `counted`. Dense (core) points of a tile in one cell that is narrower than `eps` are one node. A core
    point has the node that stands for all that its block links with it, any other point a row for each such node
    within reach, marked `many` if there may be more than one. The edges (u, v) link nodes across blocks.
    """
    spark, table = tiles.sparkSession, laid.table
    wide, limit = len(laid.dims) + 1, eps * eps
    dense = F.sum(F.expr(f"size(filter(counts, c -> c >= {min_samples}))"))
    cores = {r[0]: r[1] for r in tiles.select("block", "counts").groupBy("block").agg(dense).collect()}
    filled = np.array([cores[i] > 0 for i in table.ids.tolist()])
    if not filled.any():
        return None
    asked = np.array([filled[table.near(i, limit)[0]].any() for i in range(len(filled))])
    shared = spark.sparkContext.broadcast((table, asked))
    side = 0.999 * eps / np.sqrt(wide - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, asked = shared.value
        for batch in batches:
            (flat, _), (pids, ends) = _flat(batch, "numbers"), _flat(batch, "pids")
            flat, counts = flat.reshape(-1, wide), _flat(batch, "counts")[0]
            for block, a, b in _runs(batch):
                i = table.place(block)
                if not asked[i]:
                    continue
                points, keys, sizes = flat[ends[a] : ends[b]], pids[ends[a] : ends[b]], np.diff(ends[a : b + 1])
                own = np.flatnonzero(counts[ends[a] : ends[b]] >= min_samples)
                of, core, rows = np.repeat(np.arange(b - a), sizes)[own], points[own], []
                nodes, shown = np.full(len(points), -1), np.zeros(len(points), np.int64)
                nodes[own] = _nodes(core, of, keys[own], side)
                if len(own):
                    boxes = _Tiles(core, _starts(of))
                    rank = np.repeat(np.arange(len(boxes)), np.diff(boxes.starts))
                    # one point of each node stands for it where the tile lies within reach as a whole
                    one = np.zeros(len(own), bool)
                    one[np.unique(np.column_stack([rank, nodes[own]]), axis=0, return_index=True)[1]] = True
                    for j in table.near(i, limit)[0]:
                        if not asked[j] or (i == j and table.parts[j] == 1):
                            continue
                        gap2, reach2 = _box_gaps(table.low[j], table.high[j], boxes.low, boxes.high)
                        kept = np.flatnonzero((gap2 <= limit)[rank] & (one | (reach2 > limit)[rank]))
                        gap2, _ = _point_gaps(table.low[j], table.high[j], [core[kept, d] for d in range(1, wide)])
                        kept = kept[gap2 <= limit]
                        shown[own[kept]] = 1
                        rows += _dealt(int(table.ids[j]), int(table.parts[j]), core[kept], of[kept], 0, nodes[own[kept]])
                keys = np.concatenate([keys, nodes, shown])
                rows += [(block, p, True, 0.0, sizes, keys, points) for p in range(table.parts[i])]
                yield _sent(rows)

    def run(sent: pa.Table) -> pa.Table:
        table, _ = shared.value
        block, part = sent.column("block")[0].as_py(), sent.column("part")[0].as_py()
        alone = table.parts[table.place(block)] == 1
        own, _, (pids, node, shown) = _sides(sent, wide, False, 3)
        points, tile = np.column_stack([own.weight, *own.at]), np.repeat(np.arange(len(own)), np.diff(own.starts))
        core = node >= 0
        mine = np.bincount(tile[core], minlength=len(own)) if len(own) else np.zeros(0, np.int64)
        pieces = [(points[core], mine[mine > 0]), *_pieces(sent, wide, False)]
        met = _Tiles(*_joined(pieces, wide))
        theirs = _flat(sent.filter(pc.invert(sent.column("own"))), "pids")[0]
        names, at = np.unique(np.concatenate([node[core], theirs]), return_inverse=True)
        groups = _grouped(met, int((mine > 0).sum()), at, len(names), limit, step)
        inner = int(core.sum())
        found = [_touched(_Tiles(points[~core], _starts(tile[~core])), met, groups[at], pids[~core], limit, step, alone)]
        if part == 0:
            found.append((pids[core], groups[at[:inner]], np.ones(inner, bool), np.zeros(inner, bool)))
        # nodes that other tasks may know, with the node that stands for them here
        known = np.unique(np.concatenate([at[:inner][(shown[core] > 0) | (not alone)], at[inner:]]))
        known = known[groups[known] != known]
        touches = [np.concatenate(x) for x in zip(*found)]
        columns = [
            pa.array(np.concatenate([touches[0], names[known]])), pa.array(names[np.concatenate([touches[1], groups[known]])]),
            pa.array(np.concatenate([touches[2], np.zeros(len(known), bool)]), mask=np.arange(len(touches[0]) + len(known)) >= len(touches[0])),
            pa.array(np.concatenate([touches[3], np.zeros(len(known), bool)])),
        ]
        return pa.table(columns, names=["pid", "node", "core", "many"])

    sent = spread(tiles.mapInArrow(send, _SENT), "block", "part").groupBy("block", "part")
    found = cut(sent.applyInArrow(run, "pid bigint, node bigint, core boolean, many boolean"))
    return found.where("core IS NOT NULL"), found.where("core IS NULL").selectExpr("pid AS u", "node AS v")


def _starts(tile: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin, and the end of the last."""
    return np.concatenate([np.flatnonzero(np.diff(tile, prepend=-1)), [len(tile)]])


def _nodes(core: np.ndarray, of: np.ndarray, pids: np.ndarray, side: float) -> np.ndarray:
    """The node of each core point: the first point of its tile in the same cell."""
    if not len(core):
        return pids
    # within its tile, so that the numbers stay small
    cell = np.floor(core[:, 1:] / side)
    _, first, back = np.unique(np.column_stack([of, cell]), axis=0, return_index=True, return_inverse=True)
    return pids[first][back.ravel()]


def _grouped(met: _Tiles, inner: int, at: np.ndarray, n: int, limit: float, step: int) -> np.ndarray:
    """For each of n nodes the smallest that is linked with it by points of the first `inner` tiles."""
    groups = np.arange(n)
    if not n:
        return groups
    tile = np.repeat(np.arange(len(met)), np.diff(met.starts))
    pairs = np.unique(np.column_stack([tile, at]), axis=0)
    begins = np.concatenate([np.searchsorted(pairs[:, 0], np.arange(len(met))), [len(pairs)]])

    def nodes(tiles: np.ndarray) -> np.ndarray:
        lengths = begins[tiles + 1] - begins[tiles]
        offsets = lengths.cumsum() - lengths
        return pairs[np.repeat(begins[tiles] - offsets, lengths) + np.arange(lengths.sum()), 1]

    # first what lies within reach as a whole: most links of dense places need no look at points
    us, vs, crossing = [], [], []
    for t in range(inner):
        gap2, reach2 = _box_gaps(met.low[t], met.high[t], met.low[t:], met.high[t:])
        inside = reach2 <= limit
        whole = t + np.flatnonzero(inside)
        if len(whole):
            v = np.concatenate([nodes(np.array([t])), nodes(whole)])
            us.append(np.full(len(v), v[0]))
            vs.append(v)
        crossing.append(t + np.flatnonzero((gap2 <= limit) & ~inside))
        if len(us) % OFTEN == 0 or t == inner - 1:
            groups = _merged(groups, us, vs)
            us, vs = [], []
    for t in range(inner):
        a, b = met.starts[t], met.starts[t + 1]
        own = groups[at[a:b]]
        single = (own == own[0]).all()
        tiles = crossing[t]
        some = met.points(tiles)
        if single:
            some = some[groups[at[some]] != own[0]]
        gap2, _ = _point_gaps(met.low[t], met.high[t], [c[some] for c in met.at])
        some = some[gap2 <= limit]
        for which, close in _close([c[a:b] for c in met.at], [c[some] for c in met.at], limit, step):
            there = at[some[which]]
            if single:
                v = np.unique(there[close.any(axis=0)])
                us.append(np.full(len(v), at[a]))
                vs.append(v)
            else:
                i, j = np.nonzero(close)
                link = np.unique(at[a + i] * n + there[j])
                us.append(link // n)
                vs.append(link % n)
        if t % OFTEN == OFTEN - 1 or t == inner - 1:
            groups = _merged(groups, us, vs)
            us, vs = [], []
    return groups


def _merged(groups: np.ndarray, us: list[np.ndarray], vs: list[np.ndarray]) -> np.ndarray:
    """The groups with those of both ends of each edge made one; a group is its smallest member."""
    if not us:
        return groups
    u, v = np.concatenate(us), np.concatenate(vs)
    while True:
        a, b = groups[u], groups[v]
        apart = a != b
        if not apart.any():
            return groups
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        up = np.arange(len(groups))
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        groups = up[groups]


def _touched(
    others: _Tiles, met: _Tiles, groups: np.ndarray, pids: np.ndarray, limit: float, step: int, alone: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pid, group, false, many) for the points of `others` and the groups of core points within reach."""
    keys, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in range(len(others) if len(met) else 0):
        a, b = others.starts[t], others.starts[t + 1]
        low, high = others.low[t], others.high[t]
        gap2, reach2 = _box_gaps(low, high, met.low, met.high)
        inside = reach2 <= limit
        every = np.unique(groups[met.points(np.flatnonzero(inside))])
        some = met.points(np.flatnonzero((gap2 <= limit) & ~inside))
        some = some[~np.isin(groups[some], every)]
        gap2, _ = _point_gaps(low, high, [c[some] for c in met.at])
        some = some[gap2 <= limit]
        keys.append(np.repeat(np.arange(a, b), len(every)))
        found.append(np.tile(every, b - a))
        for which, close in _close([c[a:b] for c in others.at], [c[some] for c in met.at], limit, step):
            i, j = np.nonzero(close)
            keys.append(a + i)
            found.append(groups[some[which]][j])
    pair = np.unique(np.column_stack([np.concatenate(keys), np.concatenate(found)]), axis=0)
    times = np.bincount(pair[:, 0], minlength=len(pids)) if len(pids) else np.zeros(0, np.int64)
    many = times[pair[:, 0]] > 1 if alone else np.ones(len(pair), bool)
    return pids[pair[:, 0]], pair[:, 1], np.zeros(len(pair), bool), many
