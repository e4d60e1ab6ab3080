"""Proximity-labelled regression: learn where criminal recovery places are close."""

from __future__ import annotations

import datetime as dt
import math
import warnings
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.functions.labels import proximity
from precinct.operators.cluster import assembled
from precinct.operators.features import Encoders, Scaler, filled_parts
from precinct.operators.filters import criminal_recoveries
from precinct.operators.neighbours import knn_distance
from precinct.operators.quantiles import quantile
from precinct.operators.rows import ROW, identified
from precinct.runtime import cut

# The training set-up.
NEIGHBOURS = 5
MIN_CRIMINAL = 5
TEST_SHARE = 0.2
TREES = 100
DEPTH = 10

XY = ("recovery_lon", "recovery_lat")


@dataclass
class RiskModel:
    """Outcome of training; without enough data only the status is set."""

    status: str
    names: list[str] = field(default_factory=list)
    model: RandomForestRegressionModel | None = None
    scaler: Scaler | None = None
    encoders: Encoders = field(default_factory=Encoders)
    metrics: dict[str, float] = field(default_factory=dict)

    @property
    def importances(self) -> dict[str, float]:
        return dict(zip(self.names, map(float, self.model.featureImportances.toArray())))


def risk_labels(recoveries: DataFrame, row_id: str = "recovery_id", xy: tuple[str, str] = XY) -> DataFrame:
    """Recoveries plus `risk`: closeness to the k nearest criminal places, 1 on the spot."""
    criminal = criminal_recoveries(recoveries)
    near = knn_distance(recoveries, criminal, NEIGHBOURS, row_id, row_id, xy, xy)
    return near.withColumn("risk", proximity("mean_distance"))


def training_rows(
    recoveries: DataFrame, row_id: str = "recovery_id", xy: tuple[str, str] = XY
) -> tuple[DataFrame, list[str], Encoders]:
    """Rows (row_id, features…, risk), the feature names, and the condition codes."""
    labelled = risk_labels(recoveries, row_id, xy).where("risk IS NOT NULL")
    columns = {"x": F.col(xy[0]), "y": F.col(xy[1])}
    if "recovery_date" in recoveries.columns:
        parts = filled_parts(recoveries, "recovery_date")
        columns |= {n: parts[n] for n in ("hour", "dow", "month")}
    encoders = Encoders()
    if "vehicle_condition" in recoveries.columns:
        encoders = encoders.fit(recoveries, ["vehicle_condition"])
        labelled = encoders.apply(labelled, "vehicle_condition", "_condition")
        columns["condition"] = F.col("_condition")
    names = list(columns)
    return labelled.select(row_id, *[c.alias(n) for n, c in columns.items()], "risk"), names, encoders


def split_flags(df: DataFrame, key: str, n_test: int, n: int, seed: int) -> DataFrame:
    """Add `is_test` for exactly `n_test` rows: the ones with the lowest seeded hash of a key no two rows share."""
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double")
    drawn = df.withColumn("_draw", draw)
    # halfway between the last test row and the first training row
    edge = quantile(drawn, "_draw", min(1.0, (n_test - 0.5) / max(1, n - 1))).scalar()
    return drawn.withColumn("is_test", F.col("_draw") <= edge).drop("_draw")


def train_risk(
    recoveries: DataFrame,
    row_id: str = "recovery_id",
    xy: tuple[str, str] = XY,
    seed: int = 42,
    trees: int = TREES,
) -> RiskModel:
    n_criminal = criminal_recoveries(recoveries).count()
    if n_criminal < MIN_CRIMINAL:
        warnings.warn("Insufficient criminal location data for training")
        return RiskModel("insufficient_data")

    rows, names, encoders = training_rows(recoveries, row_id, xy)
    rows = identified(rows)
    n = rows.count()
    n_test = math.ceil(n * TEST_SHARE)
    rows = cut(split_flags(rows, ROW, n_test, n, seed))

    scaler = Scaler.fit(rows.where("NOT is_test"), names)
    vectors = assembled(scaler.apply(rows), ROW, names)
    forest = RandomForestRegressor(
        featuresCol="features", labelCol="risk", numTrees=trees, maxDepth=DEPTH,
        featureSubsetStrategy="all", seed=seed,
    )
    model = forest.fit(vectors.where("NOT is_test"))
    gap = F.col("prediction") - F.col("risk")
    tested = model.transform(vectors.where("is_test")).agg(F.avg(gap * gap).alias("mse"), F.count("*").alias("n")).first()
    metrics = {
        "mse": tested["mse"],
        "n_criminal_locations": n_criminal,
        "n_training_samples": n - tested["n"],
        "n_test_samples": tested["n"],
    }
    return RiskModel("trained", names, model, scaler, encoders, metrics)


def location_risk(
    trained: RiskModel, locations: DataFrame, xy: tuple[str, str], as_of: dt.datetime | None = None
) -> DataFrame:
    """Locations plus `risk_score`, for the time `as_of` and the first vehicle condition.

    Every location is kept; one without coordinates has a null score.
    """
    if trained.model is None:
        raise ValueError("no risk model trained")
    now = as_of or dt.datetime.now()
    fixed = {"hour": now.hour, "dow": now.weekday(), "month": now.month, "condition": 0}
    features = {f"_f_{n}": F.lit(float(fixed[n])) for n in trained.names if n in fixed}
    features |= {"_f_x": F.col(xy[0]), "_f_y": F.col(xy[1])}
    prepared = locations.withColumns(features)
    scaled = {
        f"_f_{n}": (F.col(f"_f_{n}") - m) / (s if s > 0 else 1.0)
        for n, m, s in zip(trained.names, trained.scaler.means, trained.scaler.deviations)
    }
    vectors = VectorAssembler(
        inputCols=[f"_f_{n}" for n in trained.names], outputCol="features", handleInvalid="keep"
    ).transform(prepared.withColumns(scaled))
    placed = F.col(xy[0]).isNotNull() & F.col(xy[1]).isNotNull()
    scored = trained.model.transform(vectors).withColumn("risk_score", F.when(placed, F.col("prediction")))
    return scored.drop("features", "prediction", *features)
