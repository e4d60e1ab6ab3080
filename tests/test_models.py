import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from precinct.operators import anomaly, cluster, features, grid, models, risk
from precinct.operators.quantiles import quantile


def _thefts(spark, n=60):
    random = np.random.default_rng(3)
    rows = [
        (
            f"INC{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), ["Honda", "Ford", None][i % 3], "sedan",
            None if i % 10 == 0 else 2000 + i % 20, float(1000 * (i % 7)), ["Key", "Tow"][i % 2], 50000.0,
            float(-74.2 + random.normal(0, 0.02)), float(40.7 + random.normal(0, 0.02)),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        """incident_id string, incident_date timestamp_ntz, vehicle_make string, vehicle_type string, vehicle_year int,
           vehicle_value double, theft_method string, owner_income double, incident_lon double, incident_lat double""",
    )


def _recoveries(spark, n=60, criminal=20):
    random = np.random.default_rng(4)
    rows = [
        (
            f"REC{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), float(-74.2 + random.normal(0, 0.05)),
            float(40.7 + random.normal(0, 0.05)), ["Good", "Poor"][i % 2], i < criminal,
        )
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        """recovery_id string, recovery_date timestamp_ntz, recovery_lon double, recovery_lat double,
           vehicle_condition string, is_criminal_location boolean""",
    )


def test_features_fill_and_encode(spark):
    made = features.theft_features(_thefts(spark))
    assert made.names == features.THEFT_ORDER
    frame = made.frame.toPandas().sort_values("incident_id").reset_index(drop=True)
    years = [2000 + i % 20 for i in range(60) if i % 10]
    assert frame["year"][0] == np.median(years)
    # Ford, Honda, Unknown in value order
    assert list(frame["make"][:3]) == [1, 0, 2]
    scaled, scaler = made.standardised()
    values = scaled.frame.toPandas()[made.names].to_numpy()
    np.testing.assert_allclose(values.mean(axis=0), 0, atol=1e-9)
    np.testing.assert_allclose(values.std(axis=0)[made.names.index("x")], 1)
    assert (values[:, made.names.index("income")] == 0).all()
    assert features.theft_features(_thefts(spark), names=["x", "y", "value"]).names == ["x", "y", "value"]


def test_unseen_label_fails(spark):
    known = features.theft_features(_thefts(spark)).encoders
    other = _thefts(spark, 3).withColumn("vehicle_make", F.lit("Tesla"))
    with pytest.raises(Exception, match="not seen"):
        features.theft_features(other, encoders=known).frame.collect()


def test_silhouettes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 13)
    random = np.random.default_rng(2)
    points = np.concatenate([random.normal(c, 0.3, (20, 2)) for c in (0, 2, 4)] + [[[9.0, 9.0]]])
    labels = np.repeat([0, 1, -1, 2], [20, 20, 20, 1])
    df = spark.createDataFrame(
        [(f"p{i:02d}", float(p[0]), float(p[1]), int(l)) for i, (p, l) in enumerate(zip(points, labels))],
        "id string, x double, y double, dbscan_label int",
    )
    for metric, power in (("euclidean", 1), ("squared", 2)):
        gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)) ** power
        want = []
        for i, l in enumerate(labels):
            own = (labels == l) & (np.arange(len(labels)) != i)
            if not own.any():
                want.append(0.0)
                continue
            a, b = gaps[i][own].mean(), min(gaps[i][labels == o].mean() for o in set(labels) - {l})
            want.append((b - a) / max(a, b))
        got = cluster.cluster_metrics(df, "id", ["x", "y"], metric=metric).first()
        assert got.silhouette == pytest.approx(np.mean(want), abs=1e-9)
        assert (got.n_clusters, got.n_records) == (3, 61) and got.noise_ratio == pytest.approx(20 / 61)
    one = df.withColumn("dbscan_label", F.when(F.col("dbscan_label") == 0, 0).otherwise(-1))
    assert cluster.cluster_metrics(one, "id", ["x", "y"]).first().silhouette == 0


def test_grid_steps(spark):
    area = (-74.25, 40.70, -74.15, 40.80)
    cells = grid.grid(spark, area, 0.005).orderBy("cell").toPandas()
    assert len(cells) == 400
    np.testing.assert_allclose(cells["x"].unique(), np.arange(-74.25, -74.15, 0.005)[:20])
    assert len(grid.grid(spark, (0, 0, 0.2, 0.2), 0.01).toPandas()) == len(np.arange(0, 0.2, 0.01)) ** 2
    assert grid.padded_bounds(_thefts(spark).where("false"), "incident_lon", "incident_lat", 1) == grid.DEFAULT_BOUNDS
    none = grid.activity_grid(spark.createDataFrame([], "suspect_id string, address_lon double, address_lat double"), 0.1)
    assert none.where("activity_score <> 0").count() == 0 and none.count() > 0


def test_clusters_grid_summary_and_saving(spark, tmp_path):
    thefts = _thefts(spark)
    trained = models.attach_data(models.Trained(), theft=thefts, suspect=None)
    made = features.theft_features(thefts)
    metrics = models.train_clusters(trained, "theft", made).first()
    assert metrics.n_records == 60 and 0 <= metrics.noise_ratio <= 1
    flags = models.train_anomalies(trained, "theft", made).toPandas()
    assert 0 < flags["is_anomaly"].sum() <= math.ceil(0.1 * 60)
    outcome = models.train_activity_risk(trained, _recoveries(spark))
    assert outcome.metrics["n_test_samples"] == 12 and outcome.metrics["n_training_samples"] == 48
    assert sum(outcome.importances.values()) == pytest.approx(1)

    labels = trained.labels["theft"]
    shares = grid.cluster_shares(labels).toPandas()
    assert shares["share"].sum() == pytest.approx(1) and len(shares) == 3
    cells = grid.theft_risk_grid(labels, trained.kmeans["theft"], trained.scalers["theft"], (-74.3, 40.6, -74.1, 40.8), 0.05)
    scores = cells.toPandas()
    assert len(scores) == len(np.arange(-74.3, -74.1, 0.05)) * len(np.arange(40.6, 40.8, 0.05)) and set(scores["risk_score"]) <= set(shares["share"])

    spots = thefts.select("incident_id", "incident_lon", "incident_lat")
    when = dt.datetime(2024, 5, 1, 13)
    score = lambda t: risk.location_risk(t.risk, spots, ("incident_lon", "incident_lat"), when).orderBy("incident_id").toPandas()
    before = score(trained)
    assert before["risk_score"].between(0, 1, inclusive="right").all() and len(before) == 60

    models.save_models(spark, trained, str(tmp_path / "m"))
    loaded = models.load_models(spark, str(tmp_path / "m"))
    np.testing.assert_array_equal(before["risk_score"], score(loaded)["risk_score"])
    assert loaded.scalers["theft"] == trained.scalers["theft"]
    scaled = made.standardised()[0].frame
    again = anomaly.score(scaled, made.names, loaded.forests["theft"]).orderBy("incident_id").toPandas()["score"]
    np.testing.assert_array_equal(again, flags.sort_values("incident_id")["score"])
    summary = models.model_summary(spark, loaded).toPandas()
    assert {"kmeans", "scaler", "encoder", "forest", "clusters", "importance", "data"} <= set(summary["kind"])
    with pytest.raises(FileNotFoundError):
        models.load_models(spark, str(tmp_path / "none"))


def test_too_few_criminal_places(spark):
    with pytest.warns(UserWarning, match="Insufficient"):
        trained = risk.train_risk(_recoveries(spark, criminal=4))
    assert trained.status == "insufficient_data"
    with pytest.raises(ValueError):
        risk.location_risk(trained, _recoveries(spark), ("recovery_lon", "recovery_lat"))
    assert risk.train_risk(_recoveries(spark).drop("is_criminal_location")).status == "insufficient_data"


def test_forest_is_seeded_and_sees_outliers(spark):
    random = np.random.default_rng(8)
    points = [(f"p{i:04d}", *map(float, random.normal(0, 1, 2))) for i in range(600)] + [("out", 40.0, -40.0)]
    df = spark.createDataFrame(points, "id string, a double, b double")
    nodes = anomaly.fit_forest(df, "id", ["a", "b"], trees=50)
    per_tree = nodes.groupBy("tree").count().toPandas()
    assert len(per_tree) == 50 and per_tree["count"].max() <= 511
    scores = anomaly.score(df, ["a", "b"], nodes).toPandas().set_index("id")["score"]
    assert scores.idxmin() == "out" and scores.between(-1, 0).all()
    same = anomaly.score(df, ["a", "b"], anomaly.fit_forest(df, "id", ["a", "b"], trees=50)).toPandas().set_index("id")["score"]
    np.testing.assert_array_equal(scores.sort_index(), same.sort_index())
    sample = anomaly.samples(df, "id", ["a", "b"], 601, 50, 42).groupBy("tree").count().toPandas()
    assert (sample["count"] == 256).all()


def test_no_row_is_lost_to_missing_values(spark):
    thefts = _thefts(spark).withColumn("n", F.substring("incident_id", 4, 3).cast("int"))
    thefts = thefts.withColumn("incident_date", F.when(F.col("n") % 6 != 0, F.col("incident_date")))
    thefts = thefts.withColumn("incident_lon", F.when(F.col("n") % 11 != 0, F.col("incident_lon"))).drop("n")
    made = features.theft_features(thefts)
    assert made.frame.where("hour IS NULL").isEmpty()
    trained = models.Trained()
    assert models.train_anomalies(trained, "theft", made).count() == 60
    models.train_clusters(trained, "theft", made)
    assert trained.labels["theft"].count() == 60
    recoveries = _recoveries(spark)
    first = recoveries.agg(F.min("recovery_id")).first()[0]
    recoveries = recoveries.withColumn("recovery_date", F.when(F.col("recovery_id") != first, F.col("recovery_date")))
    model = risk.train_risk(recoveries, trees=5)
    scored = risk.location_risk(model, thefts, ("incident_lon", "incident_lat"), dt.datetime(2024, 5, 1))
    assert scored.count() == 60
    assert scored.where("(incident_lon IS NULL) <> (risk_score IS NULL)").isEmpty()


def test_forest_of_no_rows(spark):
    made = features.theft_features(_thefts(spark).where("false"))
    frame = made.frame.fillna(0.0, made.names)
    nodes = anomaly.fit_forest(frame, made.row_id, made.names)
    assert anomaly.anomalies(frame, made.row_id, made.names, nodes).count() == 0


@pytest.mark.parametrize("few_values", [100_000, 50])
def test_quantiles_narrow_their_bracket(spark, few_values):
    values = np.random.default_rng(8).lognormal(0, 3, 60_000)
    values[:9000] = 1.0
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for q in (0.0, 0.1, 0.31, 0.5, 0.999, 1.0):
        got = df.limit(1).select(quantile(df, "v", q, accuracy=100, few_values=few_values).scalar().alias("q")).first().q
        assert got == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_forest_scores_equal_plain_walks(spark):
    """Trees of very different depths, with rows beyond all thresholds and ones without a number."""
    random = np.random.default_rng(8)
    points = np.concatenate([random.normal(0, 1, (300, 3)), np.zeros((300, 3)), [[1e9, -1e9, 0.0], [float("nan"), 0.0, 0.0]]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, a double, b double, c double")
    nodes = anomaly.fit_forest(df.where("id < 600"), "id", ["a", "b", "c"], trees=20)
    table = {(r.tree, r.node): r for r in nodes.collect()}
    scale = anomaly.average_length(256)
    for r in anomaly.score(df, ["a", "b", "c"], nodes).collect():
        total = 0.0
        for tree in range(20):
            at = table[tree, 0]
            while at.feature >= 0:
                at = table[tree, at.left if r[1 + at.feature] <= at.threshold else at.right]
            total += at.length
        assert abs(r.score + 2 ** (-total / 20 / scale)) < 1e-12


def test_few_and_many_clusters_measure_alike(spark, monkeypatch):
    random = np.random.default_rng(8)
    rows = [(i, int(i % 9 - 1), float(random.normal(i % 9, 1)), float(random.normal(0, 1)) if i % 31 else None) for i in range(400)]
    df = spark.createDataFrame([*rows, (400, 50, 3.0, 3.0)], "id int, dbscan_label int, x double, y double")
    few = cluster.cluster_metrics(df, "id", ["x", "y"]).first()
    monkeypatch.setattr(cluster, "FEW_CLUSTERS", 1)
    many = cluster.cluster_metrics(df, "id", ["x", "y"]).first()
    assert few[:3] == many[:3] == (9, pytest.approx(45 / 401), 401) and few.silhouette == pytest.approx(many.silhouette, abs=1e-12)
