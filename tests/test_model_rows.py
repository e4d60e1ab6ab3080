"""Row identity through the models, k-means over tiles, and saved bundles."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from precinct.operators import anomaly, centres, features, models, risk, rows, tiles
from precinct.operators.rows import ROW, identified
from precinct.plans import model_queries
from test_models import _recoveries, _thefts


def _odd_ids(df, row_id, n):
    """Every row twice under one id, a quarter of the ids missing."""
    at = F.substring(row_id, 4, 3).cast("int")
    twice = df.unionByName(df)
    return twice.withColumn(row_id, F.when(at % 4 != 0, F.concat(F.lit("id"), at % (n // 4))))


@pytest.mark.parametrize("copies", [100_000, 3])
def test_keys_follow_content_not_layout(spark, monkeypatch, copies):
    monkeypatch.setattr(rows, "COPIES", copies)
    df = spark.createDataFrame([(i % 5 or None, float(i % 3), "x") for i in range(90)], "id int, v double, row string")
    df = df.unionByName(df.where("id IS NULL"))
    keyed = identified(df)
    assert keyed.columns == [*df.columns, ROW]
    keys = {tuple(r) for r in keyed.collect()}
    assert len({k[-1] for k in keys}) == 108 == keyed.count()
    assert {tuple(r) for r in identified(df.repartition(7)).collect()} == keys
    assert identified(df.limit(0)).count() == 0


def test_each_row_once_whatever_its_id(spark):
    thefts = _odd_ids(_thefts(spark, 200), "incident_id", 200)
    made = features.theft_features(thefts)
    trained = models.Trained()
    assert models.train_clusters(trained, "theft", made).first().n_records == 400
    labels = trained.labels["theft"]
    assert labels.count() == labels.select(ROW).distinct().count() == 400
    assert labels.where("kmeans_label IS NULL OR dbscan_label IS NULL").isEmpty()
    flags = models.train_anomalies(trained, "theft", made)
    assert flags.count() == 400 and flags.where("score IS NULL").isEmpty()
    recoveries = _odd_ids(_recoveries(spark, 61), "recovery_id", 60)
    outcome = risk.train_risk(recoveries, trees=3)
    assert outcome.metrics["n_test_samples"] == math.ceil(0.2 * 122)
    assert outcome.metrics["n_training_samples"] == 122 - math.ceil(0.2 * 122)


def test_kmeans_thefts_has_a_centre_for_each_hotspot(spark, tmp_path):
    """Five places with six thefts each are five hotspots, so there are five centres."""
    # strides apart in every feature of place
    orders = [(41 * k, 7, dt.date(2024, 1, 1), 1000.0, "F", "1-URGENT") for k in range(1, 6) for _ in range(6)]
    orders += [(1000 + k, 7, dt.date(2024, 2, 1), 50.0 * k, "O", "2-HIGH") for k in range(9)]
    tables = {
        "orders": (orders, "o_orderkey bigint, o_custkey bigint, o_orderdate date, o_totalprice double, o_orderstatus string, o_orderpriority string"),
        "customer": ([(7, "c", "m", 10.0, 1)], "c_custkey bigint, c_name string, c_mktsegment string, c_acctbal double, c_nationkey int"),
        "part": ([(0, "b", "p", 3, "t")], "p_partkey bigint, p_brand string, p_name string, p_size int, p_type string"),
    }
    for name, (rows_of, schema) in tables.items():
        spark.createDataFrame(rows_of, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    labels = model_queries.kmeans_thefts(spark, str(tmp_path))
    assert labels.count() == 39 and labels.select("kmeans_label").distinct().count() == 5


def test_equal_seeds_draw_equal_samples_however_split(spark):
    df = _thefts(spark, 600).selectExpr("CAST(NULL AS STRING) AS id", "incident_lon AS a", "incident_lat AS b")
    drawn = [
        {tuple(r) for r in anomaly.samples(identified(part), ROW, ["a", "b"], 600, 7, 42).collect()}
        for part in (df, df.repartition(5), df.orderBy("b").coalesce(1))
    ]
    assert drawn[0] == drawn[1] == drawn[2] and len(drawn[0]) == 7 * 256
    flags = [split for split in (risk.split_flags(identified(p), ROW, 120, 600, 1) for p in (df, df.repartition(3)))]
    assert {tuple(r) for r in flags[0].collect()} == {tuple(r) for r in flags[1].collect()}
    assert flags[0].where("is_test").count() == 120


def _lloyd(points, start, rounds):
    centre = np.array(start, float)
    for _ in range(rounds):
        label = ((points[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        centre = np.array([points[label == c].mean(0) if (label == c).any() else centre[c] for c in range(len(centre))])
    return ((points[:, None] - centre[None]) ** 2).sum(2).argmin(1), centre


@pytest.mark.parametrize("size,k,held", [(2, 30, 32 << 20), (5, 6, 32 << 20), (2, 6, 0)])
def test_kmeans_equals_plain_rounds(spark, monkeypatch, size, k, held):
    monkeypatch.setattr(centres, "CENTRE_BYTES", held)
    random = np.random.default_rng(size)
    points = random.normal(0, 1, (900, size)) + random.integers(0, 4, 900)[:, None] * 3
    points[:300] = points[0]
    names = [f"c{i}" for i in range(size)]
    table = [(None if i % 3 else i % 50, *map(float, p)) for i, p in enumerate(points)]
    df = spark.createDataFrame(table, "id int, " + ", ".join(f"{n} double" for n in names)).repartition(6)
    start = points[random.choice(np.arange(300, 900), k, replace=False)].tolist()
    start[-1] = [1e6] * size  # a centre that no row is near
    got, found = centres.kmeans(df, names, k, start=start, rounds=2, tolerance=-1.0)
    label, centre = _lloyd(points, start, 2)
    np.testing.assert_allclose(found.values, centre, atol=1e-9)
    seen = sorted(tuple(r) for r in got.select(*names, "kmeans_label").collect())
    assert got.count() == 900 and got.columns == [*df.columns, "kmeans_label"]
    np.testing.assert_allclose(seen, sorted((*map(float, p), int(c)) for p, c in zip(points, label, strict=True)))


def test_kmeans_reads_few_tiles_and_starts_apart(spark):
    random = np.random.default_rng(5)
    spots = random.uniform(-50, 50, (12, 2))
    points = np.concatenate([s + random.normal(0, 0.01, (400, 2)) for s in spots])
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double")
    got, found = centres.kmeans(df, ["x", "y"], 12)
    # the seeded start finds every spot, and the centres end on them
    gaps = ((np.array(found.values)[:, None] - spots[None]) ** 2).sum(2).min(0)
    assert gaps.max() < 0.01
    # where clusters lie apart, no tile is read point by point
    tree = centres.T.build(centres.T.locations(got.withColumn("n", F.lit(None).cast("string")), "n", ["x", "y"]), ["x", "y"])
    batch = centres._stored(tree).coalesce(1).toArrow().combine_chunks().to_batches()[0]
    opened, runs = [], []
    centres._walk(batch, np.array(found.values), lambda a, b, c: runs.append(b - a), lambda a, *_: opened.append(a))
    assert sum(runs) + len(opened) == batch.num_rows and len(opened) <= 0.1 * batch.num_rows


def test_kmeans_with_few_places(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (None, None)], "x double, y double")
    got, found = centres.kmeans(df, ["x", "y"], 5)
    assert len(found.values) == 2 and got.count() == 3
    assert got.where("x IS NULL").first().kmeans_label == found.values.index([0.0, 0.0])
    none, found = centres.kmeans(df.limit(0), ["x", "y"], 5)
    assert none.count() == 0 and found.values == []


def test_both_inputs_of_the_forests_may_be_missing(spark):
    made = features.theft_features(_thefts(spark))
    counts = models.train_anomaly_detectors(spark, models.Trained(), theft=made).collect()
    assert [(r.name, r.rows) for r in counts] == [("theft", 60)] and 0 < counts[0].anomalies <= 6
    assert models.train_anomaly_detectors(spark, models.Trained()).collect() == []


def test_a_broken_save_leaves_the_bundle_before(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "bundle")
    trained = models.attach_data(models.Trained(), theft=_thefts(spark))
    models.train_clusters(trained, "theft", features.theft_features(_thefts(spark), names=["x", "y"]))
    models.save_models(spark, trained, folder)
    before = models.load_models(spark, folder)
    worse = models.Trained(labels=dict(trained.labels), kmeans={"theft": centres.Centres(["x", "y"], [[0.0, 0.0]])})
    worse.forests["theft"] = None  # fails when it is written
    with pytest.raises(AttributeError):
        models.save_models(spark, worse, folder)
    after = models.load_models(spark, folder)
    assert after.kmeans == before.kmeans == trained.kmeans and after.loaded == {"theft": 60}
    del worse.forests["theft"]
    for _ in range(3):
        models.save_models(spark, worse, folder)
    assert models.load_models(spark, folder).kmeans == worse.kmeans
    assert len(list((tmp_path / "bundle" / "manifests").iterdir())) == 2


@pytest.mark.parametrize("size,k", [(2, 9), (4, 3)])
def test_kmeans_rounds_read_only_points_that_may_change_sides(spark, monkeypatch, size, k):
    """Rounds over ever smaller tables end on the centres of plain rounds, as soon as no point changes sides."""
    random = np.random.default_rng(size)
    points = random.normal(0, 1, (6000, size))
    points[:500] = points[0]
    names = [f"c{i}" for i in range(size)]
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], ", ".join(f"{n} double" for n in names))
    monkeypatch.setattr(centres, "CAPACITY", 16)
    read, plain = [], centres._totals

    def totals(rows, *args):
        read.append(rows.selectExpr("sum(size(pids))").first()[0])
        return plain(rows, *args)

    monkeypatch.setattr(centres, "_totals", totals)
    start = points[500 : 500 + k].tolist()
    got, found = centres.kmeans(df, names, k, start=start, rounds=60, tolerance=0.0)
    label, centre = _lloyd(points, start, len(read))
    np.testing.assert_allclose(found.values, centre, atol=1e-9)
    np.testing.assert_allclose(
        sorted(tuple(r) for r in got.collect()), sorted((*map(float, p), int(c)) for p, c in zip(points, label, strict=True))
    )
    assert read[0] == 5501 and min(read) < 5501 / 4


def test_kmeans_tiles_hold_neighbours():
    random = np.random.default_rng(3)
    keys = np.sort(np.concatenate([random.integers(0, 1 << 60, 3000), np.full(1000, 77)]))
    ends = centres._tile_ends(keys)
    sizes = np.diff([0, *ends])
    assert ends[-1] == 4000 and 0 < sizes.min() and sizes.max() <= centres.CAPACITY
    assert centres._tile_ends(keys[:0]) == []


def test_clusters_of_many_features_need_no_tree(spark, monkeypatch):
    """Density clusters and the silhouette of few clusters, as model_summary trains them, walk no tree of tiles."""
    monkeypatch.setattr(tiles, "build", None)
    trained = models.Trained()
    made = features.theft_features(_thefts(spark, 40).unionByName(_thefts(spark, 9)).unionByName(_thefts(spark, 9)))
    metrics = models.train_clusters(trained, "theft", made, min_samples=3).first()
    assert (metrics.n_records, metrics.n_clusters) == (58, 9) and metrics.noise_ratio == pytest.approx(31 / 58)
