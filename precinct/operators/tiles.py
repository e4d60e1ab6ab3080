"""Adaptive tiles over points: the common base of the neighbour operators.

Points are split level by level, two dimensions and 16 ways at a time, until a tile holds
few distinct points. However unevenly the points lie, a tile is small, so it fits one row
as an array, and a dense place becomes many tiles instead of one big group. Searches walk
the levels from the root with box distances and only meet the tiles they need: no cross
join, no pair of rows is ever shuffled, and everything is joins on tile paths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from precinct.runtime import BROADCAST_ROWS, cut, small, spread

CAPACITY = 128
_BITS = 48  # positions per dimension: 2^48 steps over the data's range
_FUSED_COLUMNS = 12  # dimensions times levels in one stage of a walk
_MAX_TURNS = _BITS // 2


@dataclass(frozen=True)
class Tiles:
    dims: list[str]
    locs: DataFrame  # pid, first, w, dims…: one row per distinct location, written out
    tiles: DataFrame  # tile, w, lo_…, hi_…, pts: one row per tile
    levels: list[DataFrame]  # per depth: path, parent, n, w, leaf, lo_…, hi_…
    sizes: list[int]
    root: dict  # n, w, lo_…, hi_… of all points

    @property
    def points(self) -> DataFrame:
        """tile, pid, w, dims…: one row per distinct location."""
        return self.tiles.select("tile", F.explode("pts").alias("p")).select(
            "tile", "p.pid", "p.first", "p.w", *[f"p.{d}" for d in self.dims]
        )


def locations(rows: DataFrame, row_id: str, dims: list[str]) -> DataFrame:
    """Distinct locations with their row count `w` and smallest row id `first`.

    Copies collapse here, before any neighbour work, with map-side partial counts. Row ids may be
    null or repeat: they only order results, `build` gives each location a key of its own.
    """
    present = rows
    for d in dims:
        present = present.where(F.col(d).isNotNull())
    return present.groupBy(*dims).agg(F.count("*").alias("w"), F.min(row_id).alias("first"))


def build(
    locs: DataFrame, dims: list[str], capacity: int = CAPACITY, max_diagonal: float | None = None
) -> Tiles | None:
    """Tiles of at most `capacity` locations (and diagonal, if given); None without points."""
    edges, figures = _figures(dims)
    locs, root = keyed(locs, dims)
    if not root["n"]:
        return None

    fits = f"n <= {capacity}"
    if max_diagonal is not None:
        fits += f" AND {_diagonal2(dims)} <= {max_diagonal * max_diagonal!r}"

    # Group at a depth where a tile holds few points on average, then go on, three levels
    # at a time, with the points of nodes that are still too full.
    limit = _depth_limit(dims)
    depth = min(limit, 1 + sum(root["n"] > capacity * 16**i for i in range(limit)))
    stages: list[tuple[int, DataFrame]] = []
    active = locs
    while True:
        full = Observation()
        path = _path(dims, root, depth)
        deep = active.groupBy(path.alias("path")).agg(*map(F.expr, figures)).withColumn("fits", F.expr(fits))
        deep = cut(deep.observe(full, F.count_if(~F.col("fits")).alias("n")))
        stages.append((depth, deep))
        if not full.get["n"]:
            break
        if depth == limit:
            # a tile of the last level spans 2^-48 of the range in each dimension
            raise ValueError(f"more than {capacity} locations, or a wider tile than asked for, remain in one smallest tile")
        crowded = deep.where("NOT fits").select("path")
        active = locs.withColumn("path", path).join(small(crowded, full.get["n"]), "path", "left_semi")
        depth = min(limit, depth + 3)

    # Upper levels are sums of the lower ones; a node below a leaf is dropped.
    by_depth = {at: deep for at, deep in stages}
    outer = [f"{f}({e}_{d}) AS {e}_{d}" for d in dims for f, e in (("min", "lo"), ("max", "hi"))]
    for up in range(depth - 1, 0, -1):
        if up not in by_depth:
            grouped = by_depth[up + 1].groupBy(_parent("path").alias("path"))
            rolled = grouped.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), *map(F.expr, outer))
            by_depth[up] = rolled.withColumn("fits", F.expr(fits))
    columns = ["path", "n", "w", "fits", *[f"{e}_{d}" for d in dims for e in ("lo", "hi")]]
    levels = None
    for at in range(1, depth + 1):
        level = by_depth[at].select(F.lit(at).alias("depth"), *columns)
        levels = level if levels is None else levels.unionByName(level)
    nodes = cut(levels.withColumn("parent", _parent("path")))
    counted = nodes.groupBy("depth").agg(F.count("*").alias("n"), F.count_if("fits").alias("fits"))
    sizes = {r["depth"]: (r["n"], r["fits"]) for r in counted.collect()}
    kept, ends = [], {}
    for at in range(1, depth + 1):
        level = nodes.where(F.col("depth") == at)
        if at > 1:
            n_above, n_fit = sizes[at - 1]
            inner = nodes.where((F.col("depth") == at - 1) & ~F.col("fits")).select(F.col("path").alias("parent"))
            level = level.join(small(inner, n_above - n_fit), "parent", "left_semi") if n_fit else level
        level = level.withColumnRenamed("fits", "leaf")
        kept.append(level)
        if sizes[at][1]:
            ends[at] = level.where("leaf").select(F.col("path").alias("tile"))

    placed = None
    for at, end in ends.items():
        here = locs.withColumn("tile", _path(dims, root, at))
        here = here.join(small(end, sizes[at][1]), "tile", "left_semi")
        placed = here if placed is None else placed.unionByName(here)
    row = F.struct("pid", "first", "w", *dims)
    tiles = placed.groupBy("tile").agg(
        F.sum("w").alias("w"), F.collect_list(row).alias("pts"), *map(F.expr, edges)
    )
    return Tiles(dims, locs, cut(tiles), kept, [sizes[i][0] for i in range(1, depth + 1)], root)


def _figures(dims: list[str]) -> tuple[list[str], list[str]]:
    edges = [f"{f}({d}) AS {name}_{d}" for d in dims for f, name in (("min", "lo"), ("max", "hi"))]
    return edges, ["count(*) AS n", "sum(w) AS w", *edges]


def keyed(locs: DataFrame, dims: list[str]) -> tuple[DataFrame, dict]:
    """The locations with a key `pid` each, written once, and n, w, lo_…, hi_… of all."""
    seen = Observation()
    rows = locs.select(F.monotonically_increasing_id().alias("pid"), "first", "w", *dims)
    return cut(rows.observe(seen, *map(F.expr, _figures(dims)[1]))), seen.get


def _depth_limit(dims: list[str]) -> int:
    return _MAX_TURNS * ((len(dims) + 1) // 2)


def _parent(path: str) -> Column:
    return F.expr(f"left({path}, length({path}) - 1)")


def _diagonal2(dims: list[str]) -> str:
    return "(" + " + ".join(f"(hi_{d} - lo_{d}) * (hi_{d} - lo_{d})" for d in dims) + ")"


def _path(dims: list[str], root: dict, depth: int) -> Column:
    """Tile path of a point at `depth`: one hex digit per level, dimension pairs in turn."""
    groups = [dims[i : i + 2] for i in range(0, len(dims), 2)]
    last = (1 << _BITS) - 1

    def two_bits(d: str, turn: int) -> str:
        low, high = root[f"lo_{d}"], root[f"hi_{d}"]
        if low == high:
            return "0"
        step = f"floor(({d} - {low!r}D) / {high - low!r}D * {float(1 << _BITS)!r}D)"
        return f"(shiftright(least(CAST({step} AS BIGINT), {last}), {_BITS - 2 * (turn + 1)}) & 3)"

    digits = []
    for level in range(depth):
        turn, group = divmod(level, len(groups))
        bits = [two_bits(d, turn) for d in groups[group]]
        digits.append(f"hex({' * 4 + '.join(bits)})")
    return F.expr(f"concat({', '.join(digits)})")


def _gap2(dims: list[str], a: str, b: str) -> str:
    """SQL of the squared smallest distance of boxes a and b."""
    gaps = [f"greatest(0D, {a}lo_{d} - {b}hi_{d}, {b}lo_{d} - {a}hi_{d})" for d in dims]
    return "(" + " + ".join(f"{g} * {g}" for g in gaps) + ")"


def _reach2(dims: list[str], a: str, b: str) -> str:
    """SQL of the squared largest distance between points of boxes a and b."""
    reaches = [f"greatest({a}hi_{d} - {b}lo_{d}, {b}hi_{d} - {a}lo_{d})" for d in dims]
    return "(" + " + ".join(f"{r} * {r}" for r in reaches) + ")"


def distance2(dims: list[str], p: str, q: str) -> str:
    """SQL of the squared distance of two point structs, summed in the order of `dims`."""
    return "(" + " + ".join(f"({p}.{d} - {q}.{d}) * ({p}.{d} - {q}.{d})" for d in dims) + ")"


def _walk(
    left: DataFrame,
    tree: Tiles,
    measures: dict[str, str],
    settled: str,
    keep: str | None = None,
    prune: Callable[[DataFrame], DataFrame] = lambda frontier: frontier,
) -> DataFrame:
    """Pair every left tile a with the root and go down: replace each unsettled node b by its
    children, level by level.

    `measures` are SQL columns over the boxes of a and of a node just reached (sides alo_…,
    ahi_…, blo_…, bhi_…); nodes failing `keep`, over the same boxes, are dropped at once, and
    `prune` sees each new frontier. Small levels are broadcast, and settled rows pass through
    the outer join untouched. For large levels the frontier is written out, so that settled
    rows skip the join.
    """
    sides = [f"{e}_{d}" for d in tree.dims for e in ("lo", "hi")]
    own = ["a", *[f"a{s}" for s in sides]]
    kept = f"({keep})" if keep else "true"
    # The root's figures are plain literals. It is not tested by `keep`: a filter under these
    # renamed columns would make Catalyst infer it in every combination of old and new names.
    frontier = spread(left.select("tile", *sides), "tile").selectExpr(
        "tile AS a",
        *[f"{s} AS a{s}" for s in sides],
        f"CAST({tree.root['w']} AS BIGINT) AS _bw",
        *[f"{tree.root[s]!r}D AS b{s}" for s in sides],
    )
    frontier = frontier.selectExpr(
        *own, "'' AS b", "_bw AS bw", "false AS bleaf", *[f"{m} AS {name}" for name, m in measures.items()]
    )
    frontier = prune(frontier)
    own = [c for c in frontier.columns if c not in ("b", "bw", "bleaf", *measures)]
    # Fused joins over many box columns outgrow what the JVM compiles, so a long walk is cut.
    stride = max(1, _FUSED_COLUMNS // len(tree.dims))
    for step, (level, size) in enumerate(zip(tree.levels, tree.sizes), 1):
        if step % stride == 0 and size <= BROADCAST_ROWS:
            frontier = cut(frontier)
        kids = level.selectExpr(
            "parent AS _parent", "path AS _b", "w AS _bw", "leaf AS _bleaf", *[f"{s} AS b{s}" for s in sides]
        )
        fresh = {"b": "_b", "bw": "_bw", "bleaf": "_bleaf", **measures}
        if size <= BROADCAST_ROWS:
            open_node = frontier.withColumn("_key", F.expr(f"CASE WHEN NOT ({settled}) THEN b END"))
            joined = open_node.join(F.broadcast(kids), F.col("_key") == F.col("_parent"), "left")
            frontier = joined.where(f"_parent IS NULL OR {kept}").selectExpr(
                *own, *[f"CASE WHEN _parent IS NOT NULL THEN {new} ELSE {c} END AS {c}" for c, new in fresh.items()]
            )
        else:
            written = cut(frontier)
            stepped = written.where(f"NOT ({settled})").join(kids, F.col("b") == F.col("_parent"))
            frontier = written.where(settled).select(*own, *fresh).unionByName(
                stepped.where(kept).selectExpr(*own, *[f"{new} AS {c}" for c, new in fresh.items()])
            )
        frontier = prune(frontier)
    return frontier


def within(left: DataFrame, tree: Tiles, eps: float) -> DataFrame:
    """(a, b, bw, inside): nodes near each left tile.

    `inside` marks a node all of whose points are within `eps` of all points of a; the
    other rows are leaf tiles that need a look at their points.
    """
    reach2 = f"{eps * eps!r}D"
    near = _walk(
        left, tree, {"inside": f"{_reach2(tree.dims, 'a', 'b')} <= {reach2}"}, "inside OR bleaf",
        keep=f"{_gap2(tree.dims, 'a', 'b')} <= {reach2}",
    )
    return near.select("a", "b", "bw", "inside")


def nearest(left: DataFrame, tree: Tiles, k: int) -> DataFrame:
    """(a, b, bw, box, bound): leaf tiles that may hold a k nearest point of a."""
    sides = [f"{e}_{d}" for d in tree.dims for e in ("lo", "hi")]

    def prune(frontier: DataFrame) -> DataFrame:
        # a node with k points bounds the k-th distance by its far side
        known = "bound, " if "bound" in frontier.columns else ""
        others = [c for c in frontier.columns if c != "bound"]
        bound = f"least({known}min(far) OVER (PARTITION BY a))" if known else "min(far) OVER (PARTITION BY a)"
        return frontier.selectExpr(*others, f"{bound} AS bound").where("gap <= bound")

    measures = {
        "gap": _gap2(tree.dims, "a", "b"),
        "far": f"CASE WHEN _bw >= {k} THEN {_reach2(tree.dims, 'a', 'b')} END",
        "box": f"struct({', '.join(f'b{s}' for s in sides)})",
    }
    return _walk(left, tree, measures, "bleaf", prune=prune).select("a", "b", "bw", "box", "bound")
