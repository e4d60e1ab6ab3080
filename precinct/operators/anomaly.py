"""Isolation forest: small trees built in parallel tasks, rows scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precinct.operators.quantiles import quantile
from precinct.runtime import cut, send_to_workers

# The forest's set-up.
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.1

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, length double"

send_to_workers(__name__)


def average_length(n: float) -> float:
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def samples(df: DataFrame, key: str, names: list[str], n: int, trees: int, seed: int) -> DataFrame:
    """(tree, names…): for each tree min(256, n) rows drawn without replacement.

    Each row decides by seeded hashes of `key`, which no two rows share, which trees it is a candidate
    for, in one narrow pass; about 400 candidates per tree remain and the lowest 256 hashes are
    taken. With keys from `identified` the draw does not depend on how the table is split.
    """
    size = min(SAMPLE, n)
    share = min(1.0, 400.0 / max(n, 1))
    limit = int(share * (1 << 53))
    draw = f"shiftrightunsigned(xxhash64({key}, {seed}, t), 11)"
    drawn = df.selectExpr(
        *names, key, f"explode(filter(sequence(0, {trees - 1}), t -> {draw} < {limit})) AS tree"
    ).withColumn("draw", F.expr(draw.replace(", t)", ", tree)")))
    order = Window.partitionBy("tree").orderBy("draw", key)
    return drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).select("tree", key, *names)


def _grow(tree: int, rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One tree of at most 256 rows: random feature, random threshold, until rows part."""
    names = [c for c in rows.columns if c not in ("tree", "_id")]
    points = rows.sort_values("_id")[names].to_numpy(dtype=float)
    random = np.random.default_rng([seed, tree])
    deepest = math.ceil(math.log2(max(2, len(points))))
    nodes: list[list] = []
    waiting = [(np.arange(len(points)), 0, -1, "")]
    while waiting:
        members, depth, parent, side = waiting.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][4 if side == "left" else 5] = at
        part = points[members]
        varied = np.flatnonzero(part.max(axis=0) > part.min(axis=0))
        if depth >= deepest or len(members) <= 1 or len(varied) == 0:
            nodes.append([tree, at, -1, 0.0, -1, -1, depth + average_length(len(members))])
            continue
        feature = int(random.choice(varied))
        low, high = part[:, feature].min(), part[:, feature].max()
        threshold = float(random.uniform(low, high))
        goes_left = part[:, feature] <= threshold
        if goes_left.all():
            threshold = float(np.nextafter(high, low))
            goes_left = part[:, feature] <= threshold
        nodes.append([tree, at, feature, threshold, -1, -1, 0.0])
        waiting.append((members[~goes_left], depth + 1, at, "right"))
        waiting.append((members[goes_left], depth + 1, at, "left"))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "length"])


def fit_forest(
    df: DataFrame, key: str, names: list[str], trees: int = TREES, seed: int = 42
) -> DataFrame:
    """Node table of the forest: at most trees × 511 rows, whatever the data."""
    n = df.count()
    drawn = samples(df, key, names, n, trees, seed).withColumnRenamed(key, "_id")

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _grow(int(key[0]), rows, seed)

    nodes = drawn.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    return cut(nodes.withColumn("sample_size", F.lit(min(SAMPLE, n))))


def score(df: DataFrame, names: list[str], nodes: DataFrame) -> DataFrame:
    """Rows plus `score` in [−1, 0): the lower, the easier a row is to set apart."""
    table = nodes.orderBy("tree", "node").toPandas()
    if table.empty:  # a forest of no rows
        return df.withColumn("score", F.lit(None).cast("double"))
    width = int(table["node"].max()) + 1
    trees = int(table["tree"].max()) + 1
    scale = average_length(int(table["sample_size"].iloc[0])) or 1.0
    place = (table["tree"].to_numpy(), table["node"].to_numpy())

    def grid(column: str, kind: type) -> np.ndarray:
        cells = np.zeros((trees, width), dtype=kind)
        cells[place] = table[column].to_numpy()
        return cells

    # all trees in one row of cells, bounded by trees × 511 nodes; a leaf's children are the leaf itself
    split = grid("feature", int).ravel()
    inner, own = split >= 0, np.arange(trees * width)
    first = own - own % width
    kids = np.column_stack([np.where(inner, first + grid(side, int).ravel(), own) for side in ("right", "left")])
    steps, reached = 0, first[::width]
    while (inside := reached[inner[reached]]).size:
        steps, reached = steps + 1, kids[inside].ravel()
    forest = df.sparkSession.sparkContext.broadcast(
        (np.maximum(split, 0), grid("threshold", float).ravel(), kids.ravel(), grid("length", float).ravel())
    )

    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        feature, threshold, kids, length = forest.value
        for columns in batches:
            points = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            row, flat = np.arange(len(points)) * len(columns), points.ravel()
            total = np.zeros(len(points))
            for tree in range(trees):
                node = np.full(len(points), tree * width)
                for _ in range(steps):
                    lower = flat.take(row + feature.take(node)) <= threshold.take(node)
                    node = kids.take(2 * node + lower)
                total += length.take(node)
            yield pd.Series(-np.exp2(-total / trees / scale))

    return df.withColumn("score", F.pandas_udf(scored, "double")(*names))


def anomalies(
    df: DataFrame, row_id: str, names: list[str], nodes: DataFrame, contamination: float = CONTAMINATION
) -> DataFrame:
    """(row_id, score, is_anomaly): scores strictly under their `contamination` quantile."""
    scored = cut(score(df, names, nodes).select(row_id, "score"))
    edge = quantile(scored, "score", contamination).scalar()
    return scored.withColumn("is_anomaly", F.col("score") < edge)
