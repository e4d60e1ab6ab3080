"""Near-duplicates by SimHash fingerprints and vantage-point trees.

A tree node holds a vantage fingerprint and a radius: nearer fingerprints go inside, the others
outside. By the triangle inequality a fingerprint can only have a neighbour on the other side if
its own distance lies within the link distance of the radius, and only then a copy of it visits
that side as a guest. Leaves are shards; each compares its residents with residents and guests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.text import free_names, lowered, steps
from precinct.operators.components import connected_components
from precinct.runtime import attach, cut, send_to_workers, small

SHINGLE = 3
SEED = 42
DISTANCE = 2

# A tree is fitted on about this many fingerprints of the shard it splits (a choice by hash,
# so the same on every run); every fingerprint is then routed through it.
SAMPLE = 1 << 14

# Residents that a shard may have before it is split again, and the guests of one task's group.
LEAF = 2048
GUESTS = 1 << 14

# Vantage fingerprints tried at each node.
TRIES = 8

# Rounds of trees; shards that are still too large then are compared block by block.
ROUNDS = 8

send_to_workers(__name__)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's lower-cased word shingles; zero without words."""
    words = lowered(text).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    shingle = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; `fp` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = pa.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id bigint, fp bigint")


def near_classes(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id reachable over links.

    Fingerprints link when they differ in at most `distance` bits. Texts without words share the
    fingerprint zero and link like any other; repeated rows stay; a row without a doc_id takes
    part, and a class without any doc_id has a null component_id. Other columns are ignored.
    """
    rows = cut(fingerprints(docs, shingle))
    # copies collapse to one fingerprint with its smallest document before anything is compared
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    found = connected_components(links(distinct.select("fp"), distance))
    roots = distinct.join(found.withColumnsRenamed({"node": "fp", "component": "root"}), "fp", "left")
    roots = cut(roots.withColumn("root", F.coalesce("root", "fp")))
    first = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut(roots.join(cut(first), "root").select("fp", "component_id", "n"))
    return attach(rows, classes, ["fp"], "n").select("doc_id", "fp", "component_id")


def one_per_class(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs`, all columns, of the smallest doc_id of each class.

    Rows that repeat a doc_id and its text count once. Rows without a doc_id go if their class
    has one; of the others one per fingerprint stays. An empty table stays empty; other columns may
    have any names.
    """
    classes = near_classes(docs, shingle, distance)
    at, same, mine = free_names(docs.columns, "at", "same", "mine")
    first = cut(classes.where("doc_id = component_id").select(F.col("doc_id").alias(at)).distinct())
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    kept = docs.join(first, F.col("doc_id").cast("bigint") == F.col(at), "left_semi")
    kept = kept.withColumn(same, text).dropDuplicates(["doc_id", same]).drop(same)

    @F.pandas_udf("bigint")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    nameless = cut(classes.where("doc_id IS NULL AND component_id IS NULL").select(F.col("fp").alias(mine)).distinct())
    alone = docs.where("doc_id IS NULL").withColumn(mine, fp(F.col("text").cast("string")))
    alone = alone.join(nameless, mine, "left_semi").dropDuplicates([mine]).drop(mine)
    return kept.unionByName(alone)


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v) links that connect exactly the distinct fingerprints `fp` within `distance` bits.

    Each shard gives every member a link to the smallest member it is connected to, so no shard
    emits its pairs, and no link between different fingerprints is lost.
    """
    spark = fps.sparkSession
    rows = fps.select(F.lit("").alias("shard"), "fp", F.lit(True).alias("home"))
    settled = []
    for round_ in range(ROUNDS):
        homes = rows.where("home").groupBy("shard").agg(F.count("*").alias("homes"))
        large = cut(homes.where(F.col("homes") > LEAF))
        n = large.count()
        if not n:
            break
        if round_:
            settled.append(rows.join(small(large, n), "shard", "left_anti"))
            rows = rows.join(small(large, n).drop("homes"), "shard", "left_semi")
        rows = cut(_routed(rows, large, n, distance, round_))
    rows = cut(_united([*settled, rows]))
    return _compared(rows, distance, spark)


def _united(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _routed(rows: DataFrame, large: DataFrame, n: int, distance: int, round_: int) -> DataFrame:
    """The rows of too large shards, sent down a tree fitted on a bounded sample of each shard."""
    share = F.least(F.lit(1.0), SAMPLE / F.col("homes"))
    chosen = F.pmod(F.xxhash64("fp", F.lit(round_)), F.lit(1 << 30)) < share * (1 << 30)
    sample = rows.where("home").join(small(large, n), "shard").where(chosen)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.sort(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
        tree = _tree(points, LEAF * min(1.0, SAMPLE / pdf["homes"].iloc[0]), distance)
        return pd.DataFrame({"shard": [key[0]], **{k: [v.tolist()] for k, v in tree.items()}})

    arrays = "vantage array<bigint>, radius array<bigint>, inside array<bigint>, outside array<bigint>"
    trees = cut(sample.groupBy("shard").applyInPandas(fit, f"shard string, {arrays}"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, part in pdf.groupby("shard", sort=False):
                tree = {k: np.array(part[k].iloc[0], np.int64) for k in ("vantage", "radius", "inside", "outside")}
                fp = part["fp"].to_numpy(np.int64)
                at, leaf, home = _descend(fp.view(np.uint64), part["home"].to_numpy(bool), tree, distance)
                yield pd.DataFrame({"shard": [f"{shard}.{x}" for x in leaf], "fp": fp[at], "home": home})

    joined = rows.join(small(trees, n), "shard")
    return joined.mapInPandas(route, "shard string, fp bigint, home boolean")


def _distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int64)


def _tree(points: np.ndarray, leaf: float, distance: int) -> dict[str, np.ndarray]:
    """Nodes as arrays; a child below zero is the leaf of number -1 - child.

    Each node takes, of a few vantages and of the radii around the median, the pair that sends
    the fewest guests across. A node whose points are fewer than `leaf` or 16 becomes a leaf.
    """
    out: dict[str, list[int]] = {"vantage": [], "radius": [], "inside": [], "outside": []}
    rng, leaves, todo = np.random.default_rng(0), 0, [(points, None, "")]
    while todo:
        own, parent, side = todo.pop()
        best = None
        if len(own) > max(leaf, 16) or parent is None:
            for v in rng.choice(own, min(TRIES, len(own)), replace=False):
                counts = np.bincount(_distances(own, v), minlength=65).cumsum()
                for t in range(64):
                    if 0.3 * len(own) <= counts[t] <= 0.7 * len(own):
                        crossing = counts[t] - (counts[t - distance] if t >= distance else 0)
                        if best is None or crossing < best[0]:
                            best = (crossing, v, t)
            if best is None and len(own) > 1:  # most points are equally far: take off what is nearest
                d = _distances(own, own[0])
                best = (0, own[0], int(np.sort(d)[len(d) // 2 - 1])) if d.max() > np.sort(d)[len(d) // 2 - 1] else (0, own[0], 0)
        if best is None:
            child, leaves = -1 - leaves, leaves + 1
        else:
            child = len(out["vantage"])
            inner = _distances(own, best[1]) <= best[2]
            for name, value in (("vantage", int(best[1].view(np.int64))), ("radius", best[2]), ("inside", 0), ("outside", 0)):
                out[name].append(value)
            todo += [(own[inner], child, "inside"), (own[~inner], child, "outside")]
        if parent is not None:
            out[side][parent] = child
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _descend(
    fps: np.ndarray, home: np.ndarray, tree: dict[str, np.ndarray], distance: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) of every leaf that each row reaches.

    A resident goes to one side; when that is the inside and the radius is near, a guest goes
    outside as well. That is enough for pairs on two sides: one of them visits the other.
    """
    vantage = tree["vantage"].view(np.uint64)
    if not len(vantage):
        return np.arange(len(fps)), np.zeros(len(fps), np.int64), home
    found, todo = [], [(0, np.arange(len(fps)), home)]
    while todo:
        node, rows, own = todo.pop()
        if not len(rows):
            continue
        if node < 0:
            found.append((rows, np.full(len(rows), -1 - node), own))
            continue
        d, t = _distances(fps[rows], vantage[node]), tree["radius"][node]
        inner = np.where(own, d <= t, d - distance <= t)
        todo.append((tree["inside"][node], rows[inner], own[inner]))
        outer = np.where(own, d > t, d + distance > t)
        guest = own & (d <= t) & (d + distance > t)
        todo.append((tree["outside"][node], np.r_[rows[outer], rows[guest]], np.r_[own[outer], np.zeros(guest.sum(), bool)]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _compared(rows: DataFrame, distance: int, spark) -> DataFrame:
    """Links within the shards; what is too much for one group is compared block by block."""
    sizes = rows.groupBy("shard").agg(
        F.sum(F.col("home").cast("int")).alias("homes"), F.sum((~F.col("home")).cast("int")).alias("guests")
    )
    sizes = sizes.select(
        "shard",
        F.greatest(F.ceil(F.col("homes") / (2 * LEAF)), F.lit(1)).alias("blocks"),
        F.greatest(F.ceil(F.col("guests") / GUESTS), F.lit(1)).alias("parts"),
    ).where("blocks > 1 OR parts > 1")
    sizes = cut(sizes)
    rows = rows.join(small(sizes, sizes.count()), "shard", "left").fillna(1, ["blocks", "parts"])
    block, part = F.pmod(F.xxhash64("fp"), "blocks"), F.pmod(F.xxhash64("fp", F.lit(7)), "parts")
    # residents of one block are guests of the later blocks, guests visit all blocks
    rows = rows.withColumn("own", block).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.where("NOT home OR block >= own").withColumn("home", F.col("home") & (F.col("block") == F.col("own")))
    parts = F.when(F.col("home"), F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).otherwise(F.array(part))
    rows = rows.withColumn("part", F.explode(parts)).select("shard", "block", "part", "fp", "home")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        home = pdf["home"].to_numpy(bool)
        fps = np.r_[np.sort(pdf["fp"].to_numpy(np.int64)[home]), np.unique(pdf["fp"].to_numpy(np.int64)[~home])]
        points, n = fps.view(np.uint64), int(home.sum())
        pairs = []
        step = max(1, (1 << 22) // max(1, len(points)))
        for at in range(0, n, step):
            i, j = np.nonzero(np.bitwise_count(points[at : min(at + step, n), None] ^ points[None, :]) <= distance)
            new = i + at < j
            pairs.append(np.stack([i[new] + at, j[new]]))
        i, j = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        root = smallest_reached(len(points), i, j)
        linked = root != np.arange(len(points))
        return pd.DataFrame({"u": fps[linked], "v": fps[root[linked]]})

    return rows.groupBy("shard", "block", "part").applyInPandas(compare, "u bigint, v bigint")


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (i, j) connect it to."""
    low = np.arange(n)
    while len(i):
        a, b = low[i], low[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(low, low[low]):
            low = low[low]
    return low
