"""Density clustering, k-means and cluster measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.operators import blocks, neighbours
from precinct.operators import tiles as T
from precinct.operators.components import connected_components
from precinct.operators.neighbours import nearest_sets, places
from precinct.runtime import attach, cut, ranked, send_to_workers, small

NOISE = -1
# Rows of one block of the pairwise silhouette.
BLOCK_ROWS = 4_000
# Clusters that the squared silhouette of a row may look at one by one.
FEW_CLUSTERS = 1_000

send_to_workers(__name__)


def dbscan(
    rows: DataFrame, row_id: str, dims: list[str], eps: float, min_samples: int
) -> DataFrame:
    """Rows plus `dbscan_label`: 0, 1, … by smallest core row id, −1 for noise.

    A point is core with at least `min_samples` rows within `eps`, itself included; a
    border point joins the lowest-numbered cluster it touches. Rows lacking a coordinate
    are noise. Each block of neighbouring points links its core points by itself, so the
    graph to contract has only the nodes by which blocks know each other.
    """
    lost = rows.where(~_all_present(dims)).withColumn("dbscan_label", F.lit(NOISE))
    locs, root, plain = places(rows, row_id, dims)
    if not root["n"]:
        return lost
    laid = blocks.lay(locs, root, plain, eps, neighbours.MET_TILES)
    tiles = blocks.counted(laid, eps, neighbours.DISTANCES)
    found = blocks.linked(laid, tiles, eps, min_samples, neighbours.DISTANCES)
    if found is None:
        return rows.withColumn("dbscan_label", F.lit(NOISE))

    touches, links = found
    groups = cut(connected_components(links))
    named = touches.join(small(groups, groups.count()), "node", "left").select(
        "pid", "core", "many", F.coalesce("component", "node").alias("component")
    )
    placed = cut(locs.join(named, "pid", "left"))
    clusters = placed.where("core").groupBy("component").agg(F.min("first").alias("first"))
    numbers = ranked(clusters, ["first", "component"], "label").select("component", "label")
    labelled = placed.join(small(numbers, numbers.count()), "component", "left")
    # only border points may stand in several rows
    several = labelled.where("many").groupBy("pid", *plain, "w").agg(F.min("label").alias("label"))
    columns = [*[F.col(p).alias(d) for p, d in zip(plain, dims)], "w", F.coalesce("label", F.lit(NOISE)).cast("int").alias("dbscan_label")]
    located = labelled.where("many IS NULL OR NOT many").select(columns).unionByName(several.select(columns))
    return attach(rows, cut(located), dims, "w").unionByName(lost)


def _all_present(dims: list[str]) -> Column:
    present = F.lit(True)
    for d in dims:
        present = present & F.col(d).isNotNull()
    return present


def assembled(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Vectors in a fixed layout and order of a key that no two rows share, so that seeded fits repeat."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    return vectors.repartition(parts, key).sortWithinPartitions(key)


def cluster_counts(df: DataFrame, label: str = "dbscan_label") -> DataFrame:
    """One row: n_clusters, noise_ratio, n_records."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    noise = F.coalesce(F.sum(F.when(F.col(label) == NOISE, F.col("n"))), F.lit(0))
    return sizes.agg(
        F.count_if(F.col(label) != NOISE).alias("n_clusters"),
        (noise / F.sum("n")).alias("noise_ratio"),
        F.sum("n").alias("n_records"),
    )


def cluster_metrics(
    df: DataFrame, row_id: str, dims: list[str], label: str = "dbscan_label", metric: str = "squared"
) -> DataFrame:
    """One row: n_clusters, noise_ratio, n_records, silhouette (0 unless over one cluster).

    Noise counts as a cluster of its own. The `squared` silhouette uses squared
    distances, for which cluster means stand in for the members: its work grows with the
    rows. The `euclidean` one has no such form and costs all pairs of rows, done in
    blocks; choose it for tables of up to some hundred thousand rows.
    """
    forms = {"squared": silhouette_squared, "euclidean": silhouette_euclidean}
    counted = cluster_counts(df, label)
    score = forms[metric](df, row_id, dims, label).agg(F.avg("silhouette")).scalar()
    # with one cluster the measure is 0, whatever the noise
    shown = F.when(F.col("n_clusters") > 1, score).otherwise(0.0)
    return counted.select("*", shown.alias("silhouette"))


def silhouette_squared(df: DataFrame, row_id: str, dims: list[str], label: str) -> DataFrame:
    """(row_id, silhouette) with squared distances.

    The mean squared distance to a cluster is the squared distance to its centre plus the
    cluster's variance, i.e. a distance to the point (centre, deviation) in one more
    dimension. So the closest other cluster is a nearest-neighbour search over centres,
    with as many clusters as there may be; up to FEW_CLUSTERS are all looked at instead.
    """
    spread_of = F.expr(" + ".join(f"var_pop({d})" for d in dims))
    clusters = cut(
        df.groupBy(label).agg(
            F.count("*").alias("members"), *[F.avg(d).alias(f"c_{d}") for d in dims], spread_of.alias("spread")
        )
    )
    known = clusters.where(_all_present([f"c_{d}" for d in dims]))
    k = known.count()
    if k < 2:
        return df.select(row_id, F.lit(0.0).alias("silhouette"))
    if k <= FEW_CLUSTERS:
        placed = df.where(_all_present(dims) & F.col(label).isNotNull())
        return placed.select(row_id, _measured(known, dims, label)(label, *dims).alias("silhouette"))
    space = [*dims, "deviation"]
    centres = clusters.select(
        F.col(label).cast("string").alias("first"), F.lit(1).cast("bigint").alias("w"),
        *[F.col(f"c_{d}").alias(d) for d in dims], F.sqrt("spread").alias("deviation"),
    )
    spots = T.locations(df.withColumn("deviation", F.lit(0.0)), row_id, space)
    best, _ = nearest_sets(spots, centres, space, 2)
    closest = cut(best.select(*dims, "w", F.slice("best", 1, 3).alias("best")))
    rows = attach(df.select(row_id, label, *dims), closest, dims, "w")
    own = rows.join(small(clusters, clusters.count()), label)
    to_centre = " + ".join(f"({d} - c_{d}) * ({d} - c_{d})" for d in dims)
    inner = f"(({to_centre}) + spread) * members / (members - 1)"
    outer = f"filter(best, c -> c.first <> CAST({label} AS STRING))[0].d2"
    return own.selectExpr(row_id, f"CASE WHEN members > 1 THEN {inner} END AS a", f"{outer} AS b").selectExpr(
        row_id, "CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0D ELSE (b - a) / greatest(a, b) END AS silhouette"
    )


def _measured(clusters: DataFrame, dims: list[str], label: str) -> Callable[..., Column]:
    """The silhouette with squared distances of a label and a place, by a look at all of a few clusters."""
    rows = clusters.orderBy(label).select(label, "members", "spread", *[f"c_{d}" for d in dims]).collect()
    shared = clusters.sparkSession.sparkContext.broadcast(
        (np.array([r[0] for r in rows]), np.array([r[1:3] for r in rows], float), np.array([r[3:] for r in rows], float))
    )

    def silhouettes(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        labels, (members, spread), centres = shared.value[0], shared.value[1].T, shared.value[2]
        for own, *columns in batches:
            at, points = np.searchsorted(labels, own.to_numpy()), np.column_stack([c.to_numpy(dtype=float) for c in columns])
            found = []
            for some in np.array_split(np.arange(len(points)), len(points) * len(labels) // neighbours.DISTANCES + 1):
                gaps = np.zeros((len(some), len(labels)))
                for d in range(len(columns)):
                    gap = points[some, d, None] - centres[None, :, d]
                    gaps += gap * gap
                gaps += spread
                mine = np.arange(len(some)), at[some]
                n = members[at[some]]
                inner = gaps[mine] * n / np.maximum(n - 1, 1)
                gaps[mine] = np.inf
                outer = gaps.min(axis=1)
                most = np.maximum(inner, outer)
                found.append(np.where((n > 1) & (most > 0), (outer - inner) / np.where(most > 0, most, 1), 0.0))
            yield pd.Series(np.concatenate(found))

    return F.pandas_udf(silhouettes, "double")


def silhouette_euclidean(df: DataFrame, row_id: str, dims: list[str], label: str) -> DataFrame:
    """(row_id, silhouette) with plain distances, by blocks of rows against blocks of rows.

    Quadratic work by definition of the measure. Each pair of blocks is one bounded numpy
    product giving sums per row and cluster; no pair of rows is ever emitted.
    """
    total = df.count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    block = F.pmod(F.xxhash64(row_id), F.lit(blocks))
    rows = cut(df.select(F.col(row_id).cast("string").alias("pid"), F.col(label).alias("label"), *dims, block.alias("block")))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    mine = rows.withColumn("other", every)
    theirs = rows.withColumnRenamed("block", "other").withColumn("block", every)

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for name, members in right.groupby("label"):
            total = np.zeros(len(left))
            points = members[dims].to_numpy()
            here = left[dims].to_numpy()
            for at in range(0, len(points), 256):
                gap = here[:, None, :] - points[None, at : at + 256, :]
                total += np.sqrt((gap * gap).sum(axis=2)).sum(axis=1)
            parts.append(pd.DataFrame({"pid": left["pid"], "own": left["label"], "label": name, "total": total}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["pid", "own", "label", "total"])

    partial = (
        mine.groupBy("block", "other")
        .cogroup(theirs.groupBy("block", "other"))
        .applyInPandas(sums, "pid string, own bigint, label bigint, total double")
    )
    sizes = rows.groupBy("label").agg(F.count("*").alias("members"))
    summed = partial.groupBy("pid", "own", "label").agg(F.sum("total").alias("total")).join(sizes, "label")
    mean = F.when(F.col("own") == F.col("label"), F.col("total") / F.nullif(F.col("members") - 1, F.lit(0))).otherwise(
        F.col("total") / F.col("members")
    )
    scored = summed.withColumn("mean", mean).groupBy("pid").agg(
        F.max(F.when(F.col("own") == F.col("label"), F.col("mean"))).alias("a"),
        F.min(F.when(F.col("own") != F.col("label"), F.col("mean"))).alias("b"),
    )
    return scored.selectExpr(
        f"pid AS {row_id}",
        "CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0D ELSE (b - a) / greatest(a, b) END AS silhouette",
    )
