"""Training entry points, the summary of what is trained, and saving it."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.operators import anomaly
from precinct.operators.centres import Centres, kmeans
from precinct.operators.cluster import NOISE, cluster_metrics, dbscan
from precinct.operators.features import Encoders, Features, Scaler
from precinct.operators.risk import RiskModel, train_risk
from precinct.operators.rows import ROW, identified
from precinct.runtime import cut, drop, found

MIN_KMEANS = 3


@dataclass
class Trained:
    """Everything learnt so far, by name. Row data stays in frames, never here."""

    labels: dict[str, DataFrame] = field(default_factory=dict)
    kmeans: dict[str, Centres] = field(default_factory=dict)
    scalers: dict[str, Scaler] = field(default_factory=dict)
    encoders: dict[str, Encoders] = field(default_factory=dict)
    forests: dict[str, DataFrame] = field(default_factory=dict)
    risk: RiskModel | None = None
    loaded: dict[str, int] = field(default_factory=dict)


def attach_data(trained: Trained, **tables: DataFrame | None) -> Trained:
    """Count the given tables (theft, suspect, recovery) and note which are there."""
    for name, df in tables.items():
        if df is not None:
            trained.loaded[name] = df.count()
    return trained


def train_clusters(
    trained: Trained,
    name: str,
    features: Features,
    eps: float = 0.01,
    min_samples: int = 5,
    with_kmeans: bool = True,
    seed: int = 42,
    metric: str = "squared",
) -> DataFrame:
    """Density clusters, and k-means with as many centres as hotspots (3 at least).

    Keeps the labels, scaler and centres under `name`; returns the one-row metrics. The labels
    have each input row once, under a key of its own: ids may be null or repeat.
    """
    scaled, scaler = features.standardised()
    frame = identified(scaled.frame)
    if with_kmeans:
        labelled, trained.kmeans[name] = hotspot_kmeans(frame, ROW, features.names, eps, min_samples, seed)
    else:
        labelled = dbscan(frame, ROW, features.names, eps, min_samples)
    labelled = cut(labelled)
    trained.labels[name] = labelled
    trained.scalers[name] = scaler
    trained.encoders[name] = features.encoders
    return cluster_metrics(labelled, ROW, features.names, metric=metric)


def hotspot_kmeans(
    frame: DataFrame, row_id: str, names: list[str], eps: float = 0.01, min_samples: int = 5, seed: int = 42
) -> tuple[DataFrame, Centres]:
    """Rows plus `dbscan_label` and `kmeans_label`, with as many centres as hotspots (3 at least), and the centres."""
    labelled = cut(dbscan(frame, row_id, names, eps, min_samples))
    hotspots = labelled.where(F.col("dbscan_label") != NOISE).select("dbscan_label").distinct().count()
    return kmeans(labelled, names, max(MIN_KMEANS, hotspots), seed)


def train_anomalies(trained: Trained, name: str, features: Features, seed: int = 42) -> DataFrame:
    """(row_id, score, is_anomaly) of the rows the forest was fitted on, each once."""
    scaled, scaler = features.standardised()
    # no row is lost: what is still missing, such as a place, counts as the mean
    frame = identified(scaled.frame.fillna(0.0, features.names))
    nodes = anomaly.fit_forest(frame, ROW, features.names, seed=seed)
    trained.forests[name] = nodes
    trained.scalers[f"{name}_anomaly"] = scaler
    trained.encoders.setdefault(name, features.encoders)
    return anomaly.anomalies(frame, features.row_id, features.names, nodes)


def train_activity_risk(trained: Trained, recoveries: DataFrame, seed: int = 42) -> RiskModel:
    trained.risk = train_risk(recoveries, seed=seed)
    if trained.risk.model is not None:
        trained.scalers["criminal_activity"] = trained.risk.scaler
        trained.encoders["criminal_activity"] = trained.risk.encoders
    return trained.risk


def model_summary(spark: SparkSession, trained: Trained) -> DataFrame:
    """(kind, name, metric, value) rows of all that is trained."""
    rows = [("data", n, "rows", float(v)) for n, v in trained.loaded.items()]
    rows += [("kmeans", n, "k", float(len(m.values))) for n, m in trained.kmeans.items()]
    rows += [("scaler", n, "features", float(len(s.names))) for n, s in trained.scalers.items()]
    rows += [("encoder", n, c, 1.0) for n, e in trained.encoders.items() for c in sorted(e.columns)]
    rows += [("forest", n, "trees", float(anomaly.TREES)) for n in trained.forests]
    if trained.risk is not None and trained.risk.model is not None:
        rows += [("criminal_activity", "risk", m, float(v)) for m, v in trained.risk.metrics.items()]
        rows += [("importance", "risk", n, v) for n, v in trained.risk.importances.items()]
    schema = "kind string, name string, metric string, value double"
    summary = spark.createDataFrame(rows, schema)
    for name, labels in trained.labels.items():
        for column in ("dbscan_label", "kmeans_label"):
            if column in labels.columns:
                counted = labels.where(F.col(column) != NOISE).agg(F.count_distinct(column).cast("double").alias("value"))
                summary = summary.unionByName(
                    counted.select(
                        F.lit("clusters").alias("kind"), F.lit(name).alias("name"),
                        F.lit(f"n_{column.removesuffix('_label')}").alias("metric"), "value",
                    )
                )
    return summary


def train_anomaly_detectors(
    spark: SparkSession, trained: Trained, theft: Features | None = None, suspect: Features | None = None, seed: int = 42
) -> DataFrame:
    """(name, rows, anomalies) of the forests trained on the given features; a missing input has no row."""
    counts = []
    for name, features in (("theft", theft), ("suspect", suspect)):
        if features is not None:
            flags = train_anomalies(trained, name, features, seed)
            counted = flags.agg(F.count("*").alias("rows"), F.count_if("is_anomaly").alias("anomalies"))
            counts.append(counted.select(F.lit(name).alias("name"), "rows", "anomalies"))
    empty = spark.createDataFrame([], "name string, rows bigint, anomalies bigint")
    return reduce(DataFrame.unionByName, counts, empty)


def save_models(spark: SparkSession, trained: Trained, directory: str) -> None:
    """Write all parts to a new folder under `directory`, and then a manifest that names it.

    Readers follow the last complete manifest: a save that breaks off leaves the bundle saved
    before it. That one is kept for readers under way, older ones are deleted.
    """
    older = _manifests(spark, directory)
    number = max(older, default=0) + 1
    parts = f"{directory}/parts/{number:09d}-{uuid.uuid4().hex}"
    facts = {
        "parts": parts,
        "scalers": {n: [s.names, s.means, s.deviations] for n, s in trained.scalers.items()},
        "encoders": {n: [sorted(e.columns), e.rows] for n, e in trained.encoders.items()},
        "labels": sorted(trained.labels),
        "kmeans": {n: c.names for n, c in trained.kmeans.items()},
        "forests": sorted(trained.forests),
        "loaded": trained.loaded,
    }
    for name, labels in trained.labels.items():
        labels.write.parquet(f"{parts}/labels/{name}")
    for name, centres in trained.kmeans.items():
        centres.table(spark).write.parquet(f"{parts}/kmeans/{name}")
    for name, nodes in trained.forests.items():
        nodes.write.parquet(f"{parts}/forests/{name}")
    for name, encoders in trained.encoders.items():
        if encoders.table is not None:
            encoders.table.write.parquet(f"{parts}/encoders/{name}")
    if trained.risk is not None:
        facts["risk"] = [trained.risk.status, trained.risk.names, trained.risk.metrics]
        if trained.risk.model is not None:
            trained.risk.model.save(f"{parts}/risk")
    manifest = spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1)
    manifest.write.text(f"{directory}/manifests/{number:09d}")
    for past in sorted(older)[:-1]:
        drop(spark, _facts(spark, directory, past)["parts"])
        drop(spark, f"{directory}/manifests/{past:09d}")


def _manifests(spark: SparkSession, directory: str) -> list[int]:
    """Numbers of the manifests that were written to their end."""
    return [int(path.split("/")[-2]) for path in found(spark, f"{directory}/manifests/*/_SUCCESS")]


def _facts(spark: SparkSession, directory: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{directory}/manifests/{number:09d}").first()["value"])


def load_models(spark: SparkSession, directory: str) -> Trained:
    """The bundle of the last complete manifest in `directory`."""
    numbers = _manifests(spark, directory)
    if not numbers:
        raise FileNotFoundError(f"no saved models in {directory}")
    facts = _facts(spark, directory, max(numbers))
    parts = facts["parts"]
    trained = Trained(loaded=facts["loaded"])
    for name, (names, means, deviations) in facts["scalers"].items():
        trained.scalers[name] = Scaler(names, means, deviations)
    for name, (columns, rows) in facts["encoders"].items():
        table = spark.read.parquet(f"{parts}/encoders/{name}") if columns else None
        trained.encoders[name] = Encoders(table, set(columns), rows)
    for name in facts["labels"]:
        trained.labels[name] = spark.read.parquet(f"{parts}/labels/{name}")
    for name, names in facts["kmeans"].items():
        rows = spark.read.parquet(f"{parts}/kmeans/{name}").orderBy("centre").collect()
        trained.kmeans[name] = Centres(names, [[r[n] for n in names] for r in rows])
    for name in facts["forests"]:
        trained.forests[name] = spark.read.parquet(f"{parts}/forests/{name}")
    if "risk" in facts:
        status, names, metrics = facts["risk"]
        trained.risk = RiskModel(status, names, metrics=metrics)
        if names:
            trained.risk.model = RandomForestRegressionModel.load(f"{parts}/risk")
            trained.risk.scaler = trained.scalers["criminal_activity"]
            trained.risk.encoders = trained.encoders["criminal_activity"]
    return trained
