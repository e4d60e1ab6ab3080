"""Regular grids and the scores laid over them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.functions.labels import proximity
from precinct.operators.centres import Centres
from precinct.operators.features import Scaler
from precinct.operators.neighbours import nearest_distance
from precinct.operators.stats import bounds
from precinct.runtime import small

# Bounds (minx, miny, maxx, maxy) of the default area.
DEFAULT_BOUNDS = (-74.3, 40.6, -74.1, 40.8)
# Distances in degrees are multiplied by this in the activity score.
ACTIVITY_SCALE = 100.0

Bounds = tuple[float, float, float, float]


def padded_bounds(df: DataFrame, lon: str, lat: str, step: float) -> Bounds:
    """Bounds of the rows, one step wider on each side; the default area without points."""
    row = bounds(df, lon, lat).first()
    if row["minx"] is None:
        return DEFAULT_BOUNDS
    return row["minx"] - step, row["miny"] - step, row["maxx"] + step, row["maxy"] + step


def grid(spark: SparkSession, area: Bounds, step: float) -> DataFrame:
    """Points (cell, x, y) from the low corner on in steps, high ends left out, x outer."""
    minx, miny, maxx, maxy = area
    across, up = (max(0, math.ceil((high - low) / step)) for low, high in ((minx, maxx), (miny, maxy)))
    cells = spark.range(across * up)
    column = F.floor(F.col("id") / F.lit(max(up, 1)))
    return cells.select(
        F.col("id").alias("cell"),
        (F.lit(minx) + column * F.lit(step)).alias("x"),
        (F.lit(miny) + F.pmod("id", F.lit(max(up, 1))) * F.lit(step)).alias("y"),
    )


def activity_grid(
    suspects: DataFrame,
    step: float = 0.01,
    area: Bounds | None = None,
    row_id: str = "suspect_id",
    xy: tuple[str, str] = ("address_lon", "address_lat"),
) -> DataFrame:
    """(cell, x, y, activity_score): high where a suspect is close; 0 without suspects."""
    area = area or padded_bounds(suspects, *xy, step)
    cells = grid(suspects.sparkSession, area, step)
    near = nearest_distance(cells, suspects, "cell", row_id, ("x", "y"), xy)
    score = F.coalesce(proximity("min_distance", ACTIVITY_SCALE), F.lit(0.0))
    return near.select("cell", "x", "y", score.alias("activity_score"))


def cluster_shares(labels: DataFrame, label: str = "kmeans_label") -> DataFrame:
    """(label, share): each cluster's share of all rows."""
    total = labels.agg(F.count("*").alias("n")).scalar()
    return labels.groupBy(label).agg((F.count("*") / total).alias("share"))


def theft_risk_grid(
    labels: DataFrame,
    model: Centres,
    scaler: Scaler,
    area: Bounds | None = None,
    step: float = 0.01,
    compat: bool = False,
    thefts: DataFrame | None = None,
    xy: tuple[str, str] = ("incident_lon", "incident_lat"),
) -> DataFrame:
    """(cell, x, y, risk_score): the share of thefts in the cluster a point falls into.

    Coordinates are scaled as in training and all other features left at their mean;
    `compat` feeds raw degrees instead. Without an `area` the grid covers `thefts` and a step around
    them, or the default area if there are none.
    """
    if area is None:
        area = padded_bounds(thefts, *xy, step) if thefts is not None else DEFAULT_BOUNDS
    names = scaler.names
    cells = grid(labels.sparkSession, area, step).withColumns({"_x": F.col("x"), "_y": F.col("y")})
    filled = cells.withColumns({n: F.lit(0.0) for n in names if n not in ("x", "y")})
    if not compat:
        filled = filled.withColumns({"x": scaler.scaled("x"), "y": scaler.scaled("y")})
    placed = model.nearest(filled).select("cell", "_x", "_y", "kmeans_label")
    shares = small(cluster_shares(labels), len(model.values))
    return placed.join(shares, "kmeans_label", "left").select(
        "cell", F.col("_x").alias("x"), F.col("_y").alias("y"), F.coalesce("share", F.lit(0.0)).alias("risk_score")
    )
