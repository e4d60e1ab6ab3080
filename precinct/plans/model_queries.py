"""Queries over the record views: neighbours, features, clusters, grids and models."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.operators import anomaly, centres, cluster, features, filters, grid, models, neighbours, risk, stats
from precinct.plans.catalog import query
from precinct.operators.rows import ROW, identified
from precinct.plans.views import load
from precinct.runtime import cut

AREA = (-74.25, 40.70, -74.15, 40.80)
STEP = 0.005
EPS = 0.01
RECOVERIES_AS_OF = dt.datetime(2024, 1, 31)
SUSPECT_SOURCES = {"date": "last_arrest_date", "age": "suspect_age"}


def _round(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


# ---- neighbours and grids ----------------------------------------------------------

_KNN = """near AS MATERIALIZED (
  SELECT r.recovery_id, list_avg(min(sqrt((r.recovery_lon - c.recovery_lon) * (r.recovery_lon - c.recovery_lon)
      + (r.recovery_lat - c.recovery_lat) * (r.recovery_lat - c.recovery_lat)), 5)) AS mean_distance
  FROM recovery r, (SELECT * FROM recovery WHERE is_criminal_location) c GROUP BY r.recovery_id)"""


@query(
    f"""WITH {_KNN} SELECT recovery_id, round(mean_distance, 9) AS mean_distance,
          round(1 / (1 + mean_distance), 9) AS risk FROM near""",
    ("recovery",),
)
def knn_risk(spark: SparkSession, sf: str) -> DataFrame:
    near = risk.risk_labels(load(spark, sf, "recovery")).select("recovery_id", "mean_distance", "risk")
    return _round(near, {"mean_distance": 9, "risk": 9})


@query(
    f"""WITH {_KNN}, scored AS (SELECT recovery_id, 1 / (1 + mean_distance) AS risk FROM near)
        SELECT recovery_id, round(risk, 9) AS risk FROM scored
        WHERE risk >= (SELECT min(risk) FROM (SELECT risk FROM scored ORDER BY risk DESC LIMIT 6))""",
    ("recovery",),
)
def top_risk_threshold(spark: SparkSession, sf: str) -> DataFrame:
    scored = cut(risk.risk_labels(load(spark, sf, "recovery")).select("recovery_id", "risk"))
    return _round(stats.top_threshold(scored, "risk", 5), {"risk": 9})


_CELLS = """cells AS (
  SELECT i * 20 + j AS cell, -74.25e0 + CAST(i AS DOUBLE) * 0.005e0 AS x, 40.70e0 + CAST(j AS DOUBLE) * 0.005e0 AS y
  FROM (SELECT unnest(range(20)) AS i), (SELECT unnest(range(20)) AS j))"""
_ACTIVITY = f"""{_CELLS}, activity AS MATERIALIZED (
  SELECT cell, x, y, 1 / (1 + 100 * min(sqrt((s.address_lon - x) * (s.address_lon - x)
    + (s.address_lat - y) * (s.address_lat - y)))) AS activity_score
  FROM cells, suspect s GROUP BY cell, x, y)"""


@query(
    f"""WITH {_ACTIVITY} SELECT CAST(cell AS BIGINT) AS cell, round(x, 9) AS x, round(y, 9) AS y,
          round(activity_score, 9) AS activity_score FROM activity""",
    ("suspect",),
)
def activity_grid(spark: SparkSession, sf: str) -> DataFrame:
    scored = grid.activity_grid(load(spark, sf, "suspect"), STEP, AREA)
    return _round(scored, {"x": 9, "y": 9, "activity_score": 9})


@query(
    f"""WITH {_ACTIVITY} SELECT CAST(cell AS BIGINT) AS cell, round(activity_score, 9) AS activity_score FROM activity
        WHERE activity_score > (SELECT quantile_cont(activity_score, 0.8) FROM activity)""",
    ("suspect",),
)
def top_quintile_cells(spark: SparkSession, sf: str) -> DataFrame:
    scored = cut(grid.activity_grid(load(spark, sf, "suspect"), STEP, AREA))
    kept = filters.above_quantile(scored, "activity_score", 0.8).select("cell", "activity_score")
    return _round(kept, {"activity_score": 9})


@query(
    """WITH edges AS (SELECT min(incident_lon) - 0.005e0 AS minx, min(incident_lat) - 0.005e0 AS miny,
         max(incident_lon) + 0.005e0 AS maxx, max(incident_lat) + 0.005e0 AS maxy FROM theft),
       sizes AS (SELECT *, CAST(ceil((maxx - minx) / 0.005e0) AS BIGINT) AS nx,
         CAST(ceil((maxy - miny) / 0.005e0) AS BIGINT) AS ny FROM edges),
       columns_of AS (SELECT *, unnest(range(nx)) AS i FROM sizes),
       cells AS (SELECT *, unnest(range(ny)) AS j FROM columns_of)
       SELECT CAST(i * ny + j AS BIGINT) AS cell, round(minx + i * 0.005e0, 9) AS x, round(miny + j * 0.005e0, 9) AS y FROM cells""",
    ("theft",),
)
def grid_points(spark: SparkSession, sf: str) -> DataFrame:
    area = grid.padded_bounds(load(spark, sf, "theft"), "incident_lon", "incident_lat", STEP)
    return _round(grid.grid(spark, area, STEP), {"x": 9, "y": 9})


# ---- features ----------------------------------------------------------------------


@query(
    """SELECT recovery_id, recovery_lon AS x, recovery_lat AS y, CAST(hour(recovery_date) AS INT) AS hour,
         CAST(isodow(recovery_date) - 1 AS INT) AS dow, CAST(month(recovery_date) AS INT) AS month,
         CAST(quarter(recovery_date) AS INT) AS quarter FROM recovery""",
    ("recovery",),
)
def temporal_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.temporal_features(
        load(spark, sf, "recovery"), "recovery_id", ("recovery_lon", "recovery_lat")
    )


def _code(column: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY coalesce({column}, 'Unknown')) - 1 AS DOUBLE)"


@query(
    """SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS BIGINT) AS code FROM (
         SELECT 'vehicle_make' AS feature, vehicle_make AS value FROM theft UNION
         SELECT 'vehicle_type', vehicle_type FROM theft UNION SELECT 'theft_method', theft_method FROM theft)""",
    ("theft",),
)
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["vehicle_make", "vehicle_type", "theft_method"]
    return features.Encoders().fit(load(spark, sf, "theft"), columns).table.select("feature", "value", "code")


_THEFT_FEATURES = f"""features AS MATERIALIZED (SELECT incident_id, incident_lon AS x, incident_lat AS y,
  CAST(hour(incident_date) AS DOUBLE) AS hour, CAST(isodow(incident_date) - 1 AS DOUBLE) AS dow,
  CAST(month(incident_date) AS DOUBLE) AS month, CAST(quarter(incident_date) AS DOUBLE) AS quarter,
  vehicle_value AS value, CAST(vehicle_year AS DOUBLE) AS year, {_code('vehicle_make')} AS make,
  {_code('vehicle_type')} AS type, {_code('theft_method')} AS method, owner_income AS income FROM theft)"""
_THEFT_NAMES = features.THEFT_ORDER


def _rounded(names: list[str], places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names)


@query(f"WITH {_THEFT_FEATURES} SELECT incident_id, {_rounded(_THEFT_NAMES)} FROM features", ("theft",))
def theft_features(spark: SparkSession, sf: str) -> DataFrame:
    frame = features.theft_features(load(spark, sf, "theft")).frame
    return _round(frame, {n: 6 for n in _THEFT_NAMES})


_SUSPECT_FEATURES = f"""features AS MATERIALIZED (SELECT suspect_id, address_lon AS x, address_lat AS y,
  CAST(hour(last_arrest_date) AS DOUBLE) AS hour, CAST(isodow(last_arrest_date) - 1 AS DOUBLE) AS dow,
  CAST(month(last_arrest_date) AS DOUBLE) AS month, CAST(quarter(last_arrest_date) AS DOUBLE) AS quarter,
  CAST(suspect_age AS DOUBLE) AS age, CAST(coalesce(previous_arrests, 0) AS DOUBLE) AS previous_arrests,
  {_code('occupation')} AS occupation FROM suspect)"""
_SUSPECT_NAMES = [n for n in features.SUSPECT_ORDER if n != "criminal_associations"]


@query(f"WITH {_SUSPECT_FEATURES} SELECT suspect_id, {_rounded(_SUSPECT_NAMES)} FROM features", ("suspect",))
def suspect_features(spark: SparkSession, sf: str) -> DataFrame:
    made = features.suspect_features(load(spark, sf, "suspect"), columns=SUSPECT_SOURCES)
    return _round(made.frame, {n: 6 for n in made.names})


def _scaled(names: list[str], row_id: str, source: str = "features") -> str:
    parts = ", ".join(
        f"coalesce(({n} - avg({n}) OVER ()) / nullif(stddev_pop({n}) OVER (), 0), 0e0) AS {n}" for n in names
    )
    return f"scaled AS MATERIALIZED (SELECT {row_id}, {parts} FROM {source})"


@query(
    f"""WITH {_THEFT_FEATURES}, {_scaled(_THEFT_NAMES, 'incident_id')}
        SELECT incident_id, {_rounded(_THEFT_NAMES)} FROM scaled""",
    ("theft",),
)
def standardise(spark: SparkSession, sf: str) -> DataFrame:
    scaled, _ = features.theft_features(load(spark, sf, "theft")).standardised()
    return _round(scaled.frame, {n: 6 for n in _THEFT_NAMES})


# ---- density clusters --------------------------------------------------------------


def _located(view: str, row_id: str, x: str, y: str) -> str:
    source = f"(SELECT {row_id} AS id, {x} AS x, {y} AS y FROM {view})"
    return _scaled(["x", "y"], "id", source)


def _near(eps: float) -> str:
    """Pairs within eps, itself included, met through cells of side eps."""
    return f"""
      celled AS MATERIALIZED (SELECT *, CAST(floor(x / {eps}e0) AS BIGINT) AS cx, CAST(floor(y / {eps}e0) AS BIGINT) AS cy
        FROM scaled),
      reached AS MATERIALIZED (SELECT *, cx + dx AS kx, cy + dy AS ky FROM celled,
        (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
      near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM reached a JOIN celled b ON b.cx = a.kx AND b.cy = a.ky
        WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {eps}e0 * {eps}e0)"""


def _clusters(eps: float, min_samples: int) -> str:
    return f"""{_near(eps)},
      core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {min_samples}),
      links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
      parts(id, part) USING KEY (id) AS (
        SELECT id, id FROM core
        UNION
        SELECT l.b, min(p.part) FROM parts p JOIN links l ON l.a = p.id JOIN recurring.parts old ON old.id = l.b
        WHERE p.part < old.part GROUP BY l.b),
      numbers AS MATERIALIZED (SELECT id, CAST(dense_rank() OVER (ORDER BY part) - 1 AS INT) AS label FROM parts),
      labels AS MATERIALIZED (SELECT s.id, coalesce(own.label, border.label, -1) AS label FROM scaled s
        LEFT JOIN numbers own ON own.id = s.id
        LEFT JOIN (SELECT n.a AS id, min(c.label) AS label FROM near n JOIN numbers c ON c.id = n.b GROUP BY n.a) border
          ON border.id = s.id)"""


_THEFT_PLACES = _located("theft", "incident_id", "incident_lon", "incident_lat")
_SUSPECT_PLACES = _located("suspect", "suspect_id", "address_lon", "address_lat")


def _theft_places(spark: SparkSession, sf: str) -> DataFrame:
    made = features.theft_features(load(spark, sf, "theft"), names=["x", "y"])
    return cut(made.standardised()[0].frame)


@query(
    f"""WITH {_THEFT_PLACES}, {_near(EPS)}
        SELECT a AS incident_id, CAST(count(*) AS BIGINT) AS n_neighbours FROM near GROUP BY a""",
    ("theft",),
)
def eps_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    counted = neighbours.eps_neighbours(_theft_places(spark, sf), "incident_id", ["x", "y"], EPS)
    return counted.select("incident_id", "n_neighbours")


@query(
    f"""WITH RECURSIVE {_THEFT_PLACES}, {_clusters(EPS, 5)}
        SELECT id AS incident_id, label AS dbscan_label FROM labels""",
    ("theft",),
)
def dbscan_thefts(spark: SparkSession, sf: str) -> DataFrame:
    labelled = cluster.dbscan(_theft_places(spark, sf), "incident_id", ["x", "y"], EPS, 5)
    return labelled.select("incident_id", "dbscan_label")


@query(
    f"""WITH RECURSIVE {_SUSPECT_PLACES}, {_clusters(EPS, 3)}
        SELECT id AS suspect_id, label AS dbscan_label FROM labels""",
    ("suspect",),
)
def dbscan_suspects(spark: SparkSession, sf: str) -> DataFrame:
    made = features.suspect_features(load(spark, sf, "suspect"), names=["x", "y"])
    places = cut(made.standardised()[0].frame)
    labelled = cluster.dbscan(places, "suspect_id", ["x", "y"], EPS, 3)
    return labelled.select("suspect_id", "dbscan_label")


@query(
    f"""WITH RECURSIVE {_THEFT_PLACES}, {_clusters(EPS, 5)},
      placed AS MATERIALIZED (SELECT l.label, s.* FROM labels l JOIN scaled s ON s.id = l.id),
      centres AS MATERIALIZED (SELECT label, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mx, avg(y) AS my,
        var_pop(x) + var_pop(y) AS spread FROM placed GROUP BY label),
      gaps AS MATERIALIZED (SELECT p.id, p.label, c.label AS other, c.n,
        (p.x - c.mx) * (p.x - c.mx) + (p.y - c.my) * (p.y - c.my) + c.spread AS gap FROM placed p, centres c),
      sides AS MATERIALIZED (SELECT id, max(CASE WHEN label = other AND n > 1 THEN gap * n / (n - 1) END) AS a,
        min(CASE WHEN label <> other THEN gap END) AS b FROM gaps GROUP BY id)
      SELECT (SELECT CAST(count(DISTINCT label) AS BIGINT) FROM labels WHERE label <> -1) AS n_clusters,
        (SELECT round(avg(CASE WHEN label = -1 THEN 1e0 ELSE 0e0 END), 9) FROM labels) AS noise_ratio,
        (SELECT CAST(count(*) AS BIGINT) FROM labels) AS n_records,
        CASE WHEN (SELECT count(DISTINCT label) FROM labels WHERE label <> -1) > 1 THEN
          (SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0e0 ELSE (b - a) / greatest(a, b) END), 6)
           FROM sides) ELSE 0e0 END AS silhouette""",
    ("theft",),
)
def cluster_metrics(spark: SparkSession, sf: str) -> DataFrame:
    labelled = cut(cluster.dbscan(_theft_places(spark, sf), "incident_id", ["x", "y"], EPS, 5))
    measured = cluster.cluster_metrics(labelled, "incident_id", ["x", "y"])
    return _round(measured, {"noise_ratio": 9, "silhouette": 6})


# ---- models ------------------------------------------------------------------------


def _theft_kmeans(spark: SparkSession, sf: str):
    """K-means with as many centres as the density clusters find hotspots."""
    made, scaler = features.theft_features(load(spark, sf, "theft")).standardised()
    found, model = models.hotspot_kmeans(cut(made.frame), "incident_id", made.names, EPS)
    return found, model, scaler


@query()
def kmeans_thefts(spark: SparkSession, sf: str) -> DataFrame:
    return _theft_kmeans(spark, sf)[0].select("incident_id", "kmeans_label")


HOTSPOTS = 40


@query(
    f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({HOTSPOTS} AS BIGINT) AS n_centres,
          CAST(0 AS BIGINT) AS n_misplaced, true AS centres_are_means FROM theft""",
    ("theft",),
)
def kmeans_hotspots_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of as many centres as there may be hotspots: no row has a nearer centre than its own."""
    places = _theft_places(spark, sf)
    labelled, found = centres.kmeans(places, ["x", "y"], HOTSPOTS, tolerance=0.0, rounds=200)
    table = F.broadcast(found.table(spark).withColumnsRenamed({"x": "cx", "y": "cy"}))
    gap = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    every = F.array(*[(F.col("x") - a) ** 2 + (F.col("y") - b) ** 2 for a, b in found.values])
    rows = labelled.join(table, F.col("kmeans_label") == F.col("centre")).withColumn(
        "misplaced", F.sqrt(gap) > F.sqrt(F.array_min(every)) + 1e-9
    )
    means = rows.groupBy("centre", "cx", "cy").agg(
        F.count("*").alias("n"), F.count_if("misplaced").alias("misplaced"), F.avg("x").alias("mx"), F.avg("y").alias("my")
    )
    near = (F.abs(F.col("mx") - F.col("cx")) < 1e-6) & (F.abs(F.col("my") - F.col("cy")) < 1e-6)
    return means.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_centres"), F.sum("misplaced").alias("n_misplaced"),
        F.bool_and(near).alias("centres_are_means"),
    )


@query(
    """SELECT stage, n_in, n_out FROM (SELECT 2 * CAST(count(*) AS BIGINT) AS n FROM theft), (VALUES
         ('kmeans', 1e0), ('forest', 1e0), ('test', 0.2e0), ('training', 0.8e0)) s(stage, share),
       LATERAL (SELECT n AS n_in, CAST(CASE stage WHEN 'test' THEN ceil(n * 0.2e0)
         WHEN 'training' THEN n - ceil(n * 0.2e0) ELSE n END AS BIGINT) AS n_out)""",
    ("theft",),
)
def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows into and out of the models when every row stands twice and a quarter of the ids are missing."""
    made = features.theft_features(load(spark, sf, "theft"), names=["x", "y", "value"])
    scaled = made.standardised()[0].frame
    blank = F.pmod(F.xxhash64("incident_id"), F.lit(4)) == 0
    twice = scaled.unionByName(scaled).withColumn("incident_id", F.when(~blank, F.col("incident_id")))
    rows = identified(twice)
    n = rows.count()
    labelled, _ = centres.kmeans(rows, made.names, models.MIN_KMEANS)
    nodes = anomaly.fit_forest(rows, ROW, made.names)
    flags = anomaly.anomalies(rows, ROW, made.names, nodes)
    split = cut(risk.split_flags(rows, ROW, math.ceil(n * risk.TEST_SHARE), n, 42))
    parts = {
        "kmeans": labelled, "forest": flags, "test": split.where("is_test"), "training": split.where("NOT is_test"),
    }
    counted = [
        df.agg(F.count_distinct(ROW).alias("n_out")).select(F.lit(name).alias("stage"), F.lit(n).cast("bigint").alias("n_in"), "n_out")
        for name, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, counted)


@query()
def theft_risk_grid(spark: SparkSession, sf: str) -> DataFrame:
    found, model, scaler = _theft_kmeans(spark, sf)
    return grid.theft_risk_grid(cut(found), model, scaler, AREA, STEP)


@query(
    """WITH edges AS (SELECT min(incident_lon) - 0.005e0 AS minx, min(incident_lat) - 0.005e0 AS miny,
         max(incident_lon) + 0.005e0 AS maxx, max(incident_lat) + 0.005e0 AS maxy FROM theft)
       SELECT CAST(ceil((maxx - minx) / 0.005e0) * ceil((maxy - miny) / 0.005e0) AS BIGINT) AS n_cells,
         round(minx, 9) AS minx, round(miny, 9) AS miny, true AS within_shares FROM edges""",
    ("theft",),
)
def theft_risk_default_area(spark: SparkSession, sf: str) -> DataFrame:
    """The risk grid over the thefts' own bounds: its cells and corner, and scores that are shares of clusters."""
    thefts = cut(load(spark, sf, "theft"))
    made, scaler = features.theft_features(thefts, names=["x", "y"]).standardised()
    found, model = centres.kmeans(cut(made.frame), made.names, models.MIN_KMEANS)
    cells = grid.theft_risk_grid(cut(found), model, scaler, None, STEP, thefts=thefts)
    return cells.agg(
        F.count("*").alias("n_cells"), F.round(F.min("x"), 9).alias("minx"), F.round(F.min("y"), 9).alias("miny"),
        F.bool_and(F.col("risk_score").between(0, 1)).alias("within_shares"),
    )


@query(
    """SELECT 'theft' AS name, CAST(count(*) AS BIGINT) AS n_rows, true AS at_most_a_tenth FROM theft UNION ALL
       SELECT 'suspect', CAST(count(*) AS BIGINT), true FROM suspect""",
    ("theft", "suspect"),
)
def anomaly_detectors(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of both inputs of the forests, and whether at most a tenth of them are flagged, but some."""
    counts = models.train_anomaly_detectors(
        spark, models.Trained(), features.theft_features(load(spark, sf, "theft"), names=["x", "y", "value"]),
        features.suspect_features(load(spark, sf, "suspect"), columns=SUSPECT_SOURCES),
    )
    tenth = (F.col("anomalies") > 0) & (F.col("anomalies") <= F.ceil(F.col("rows") * anomaly.CONTAMINATION))
    return counts.select("name", F.col("rows").alias("n_rows"), tenth.alias("at_most_a_tenth"))


@query(
    f"""WITH {_KNN} SELECT r.recovery_id, recovery_lon AS x, recovery_lat AS y, CAST(hour(recovery_date) AS DOUBLE) AS hour,
          CAST(isodow(recovery_date) - 1 AS DOUBLE) AS dow, CAST(month(recovery_date) AS DOUBLE) AS month,
          {_code('vehicle_condition')} AS condition, round(1 / (1 + mean_distance), 9) AS risk
        FROM recovery r JOIN near ON near.recovery_id = r.recovery_id""",
    ("recovery",),
)
def risk_regression_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, _ = risk.training_rows(load(spark, sf, "recovery"))
    return _round(rows, {"risk": 9})


@query()
def location_risk(spark: SparkSession, sf: str) -> DataFrame:
    trained = risk.train_risk(load(spark, sf, "recovery"))
    xy = ("incident_lon", "incident_lat")
    scored = risk.location_risk(trained, load(spark, sf, "theft").select("incident_id", *xy), xy, RECOVERIES_AS_OF)
    return scored.select("incident_id", "risk_score")


def _anomalies(made: features.Features) -> DataFrame:
    scaled = identified(made.standardised()[0].frame.fillna(0.0, made.names))
    nodes = anomaly.fit_forest(scaled, ROW, made.names)
    return anomaly.anomalies(scaled, made.row_id, made.names, nodes)


@query()
def anomalies_thefts(spark: SparkSession, sf: str) -> DataFrame:
    return _anomalies(features.theft_features(load(spark, sf, "theft")))


@query()
def anomalies_suspects(spark: SparkSession, sf: str) -> DataFrame:
    return _anomalies(features.suspect_features(load(spark, sf, "suspect"), columns=SUSPECT_SOURCES))


@query()
def model_summary(spark: SparkSession, sf: str) -> DataFrame:
    # both are read many times, and the suspects' last arrests come from all orders
    suspects = cut(load(spark, sf, "suspect"))
    trained = models.attach_data(models.Trained(), suspect=suspects)
    made = features.suspect_features(suspects, columns=SUSPECT_SOURCES)
    made = replace(made, frame=cut(made.frame))
    models.train_clusters(trained, "suspect", made, min_samples=3, metric="squared")
    models.train_anomalies(trained, "suspect", made)
    return models.model_summary(spark, trained)
