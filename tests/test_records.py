import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from precinct.functions import geo
from precinct.operators import conform, filters, layers, stats
from precinct.operators.quantiles import quantile
from precinct.runtime import numbered
from precinct.schemas import RECOVERY, SUSPECT, THEFT
from precinct.sources import geojson, points, store


@pytest.mark.parametrize("q", [0.0, 0.1, 0.333, 0.5, 0.8, 0.999, 1.0])
@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantile_is_exact(spark, q, accuracy):
    random = np.random.default_rng(5)
    # a third of all values are one and the same
    values = np.concatenate([random.exponential(10, 400), np.full(200, 7.5)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    assert quantile(df, "v", q, accuracy).first()[0] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_quantile_of_nothing(spark):
    assert quantile(spark.createDataFrame([], "v double"), "v", 0.5).first()[0] is None


def test_numbered_follows_order(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("h"))
    rows = sorted((r.seq, r.h) for r in numbered(df, ["h"]).collect())
    assert [s for s, _ in rows] == list(range(1000)) and [h for _, h in rows] == sorted(h for _, h in rows)
    assert sorted(r.seq for r in numbered(df).collect()) == list(range(1000))


def test_empty_list_keeps_nothing_or_is_off(spark):
    df = spark.createDataFrame([("High", 20), (None, 30)], "risk_level string, suspect_age int")
    assert filters.suspects(df, risk_levels=[]).count() == 0
    assert filters.stored_suspects(df, risk_levels=[]).count() == 2
    assert filters.suspects(df, charges=["x"]).count() == 2  # absent column, criterion skipped
    assert filters.repeat_offenders(df).count() == 0
    with pytest.raises(ValueError):
        filters.near_suspects(df, (0, 0), 1, "home")


def test_recency(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(day,), (day + dt.timedelta(hours=5),), (None,)], "last_arrest_date timestamp_ntz")
    noon = day + dt.timedelta(days=180, hours=2)
    assert filters.suspects(df, recent_arrests_only=True, as_of=noon).count() == 1
    assert filters.stored_suspects(df, recent_arrests_days=180, as_of=noon.date()).count() == 2


def test_recovery_criteria(spark):
    df = spark.createDataFrame(
        [("a", True, "INC1", dt.datetime(2024, 1, 2)), ("b", None, None, dt.datetime(2024, 1, 2, 1))],
        "recovery_id string, is_criminal_location boolean, incident_id string, recovery_date timestamp_ntz",
    )
    assert [r[0] for r in filters.recoveries(df, criminal_locations_only=True).collect()] == ["a"]
    assert [r[0] for r in filters.recoveries(df, with_theft_link=False).collect()] == ["b"]
    assert [r[0] for r in filters.recoveries(df, max_date="2024-01-02").collect()] == ["a"]


def test_summaries_of_empty_and_partial_tables(spark):
    empty = spark.createDataFrame([], THEFT.schema)
    row = stats.theft_summary(empty).first()
    assert row.total_incidents == 0 and row.most_stolen_make is None and row.income_median is None
    people = spark.createDataFrame([("x",), ("x",)], "name string")
    assert stats.suspect_summary(people).first().unique_suspects == 2
    assert stats.suspect_value_counts(people).isEmpty()
    info = stats.table_stats(empty, ["vehicle_make"]).collect()
    assert len(info) == 1 and info[0].total_records == 0 and info[0].column_name is None
    assert stats.map_centre(empty, "incident_lon", "incident_lat").first().centre_lat == 39.8283
    with pytest.raises(ValueError):
        stats.bounds_tuple(empty, "incident_lon", "incident_lat")


def test_wkt_and_projection(spark):
    texts = ["POINT (-74.2 40.7)", " point(1 2) ", "", None, "None", "nan", "POINT (1)", "POINT (1 x)", "LINESTRING (0 0, 1 1)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", geo.from_wkt("t").alias("p")).collect()}
    assert (got[0].x, got[0].y) == (-74.2, 40.7) and (got[1].x, got[1].y) == (1, 2)
    assert all(got[i] is None for i in range(2, 9))
    x, y = geo.mercator(F.lit(-74.2), F.lit(40.7))
    lon, lat = geo.unmercator("x", "y")
    row = spark.range(1).select(x.alias("x"), y.alias("y")).select("x", "y", lon.alias("lon"), lat.alias("lat")).first()
    assert row.x == pytest.approx(-8259906.2175, abs=1e-3) and row.lon == pytest.approx(-74.2) and row.lat == pytest.approx(40.7)


def test_points(spark):
    df = points.from_coordinates(spark, [(-180, -90), (180, 90), (0, 0)], {"id": [1, 2, 3]})
    assert {(r.id, r.geometry.x) for r in df.collect()} == {(1, -180), (2, 180), (3, 0)}
    for bad, message in (([], "No coordinates"), ([(0, 0), (181, 0)], "index 1")):
        with pytest.raises(ValueError, match=message):
            points.from_coordinates(spark, bad)
    with pytest.raises(ValueError, match="Attribute 'a'"):
        points.from_coordinates(spark, [(0, 0)], {"a": [1, 2]})
    table = spark.createDataFrame([(1.0, 2.0, 1), (None, 2.0, 2)], "longitude double, latitude double, id int")
    assert points.from_columns(table).columns == ["id", "geometry"] and points.from_columns(table).count() == 1
    with pytest.raises(KeyError):
        points.from_columns(table, "lng")
    with pytest.raises(Exception, match="Invalid coordinates"):
        points.checked(spark.createDataFrame([(200.0, 0.0)], "x double, y double"), "x", "y").collect()


def test_conform_policies(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "name string, extra int")
    required = {"suspect_id": "string", "bail_amount": "double", "name": "string", "is_x": "boolean", "court_date": "timestamp"}
    nulls = conform.conform(df, required).orderBy("name").collect()
    assert nulls[0].asDict() == {"suspect_id": None, "bail_amount": None, "name": "a", "is_x": None, "court_date": None, "extra": 2}
    now = dt.datetime(2024, 5, 1)
    filled = conform.conform(df, required, conform.COMPAT, as_of=now, order_by=["name"]).orderBy("name").collect()
    assert [r.suspect_id for r in filled] == ["ID_000001", "ID_000002"]
    assert filled[0].bail_amount == 0 and filled[0].is_x is False and filled[0].court_date == now
    kinds = {c: conform.default_kind(c) for c in ("recovery_agency", "criminal_location_type", "police_report_id", "owner_lat", "notes")}
    assert kinds == {"recovery_agency": "zero", "criminal_location_type": "false", "police_report_id": "id", "owner_lat": "zero_point", "notes": "null"}


def _suspects(spark, *ids):
    rows = [(i, f"n{i}", 33.0, 40.7, -74.2, 40.8, -74.3) for i in ids]
    return spark.createDataFrame(
        rows, "suspect_id string, suspect_name string, suspect_age double, address_lat double, address_lon double, arrest_lat double, arrest_lon double"
    )


def test_store(spark, tmp_path):
    table = str(tmp_path / "suspects")
    store.create_table(spark, table, SUSPECT.stored_schema)
    store.create_table(spark, table, SUSPECT.stored_schema)
    with pytest.warns(UserWarning, match="No data found"):
        assert "geometry" in store.load(spark, table, "address_geometry_wkt").columns
    rows = _suspects(spark, "a", "b")
    store.save(rows.withColumn("unknown", F.lit(1)), SUSPECT, table)
    back = store.load(spark, table, "arrest_geometry_wkt")
    assert back.count() == 2 and back.first().geometry.x == -74.3 and "unknown" not in back.columns
    assert back.first().suspect_age == 33 and back.first().created_at is not None
    store.save(_suspects(spark, "c"), SUSPECT, table, clear_existing=False)
    assert store.read(spark, table).count() == 3
    with pytest.raises(ValueError, match="duplicate key"):
        store.save(_suspects(spark, "c"), SUSPECT, table, clear_existing=False)
    with pytest.raises(ValueError, match="while reading"):
        store.save(store.read(spark, table), SUSPECT, table)
    store.save(_suspects(spark, "z"), SUSPECT, table)
    assert [r[0] for r in store.read(spark, table).select("suspect_id").collect()] == ["z"]
    near = store.query_by_distance(spark, table, (40.7, -74.2), 1, "address_lat", "address_lon")
    assert near.count() == 1 and "address_geometry_wkt" in near.columns
    assert store.query_by_distance(spark, table, (50, 0), 1, "address_lat", "address_lon").isEmpty()
    info = store.table_info(store.read(spark, table), "suspect_id").collect()
    assert info[0].name == "suspect_id" and info[0].pk
    with pytest.raises(ValueError):
        store.geometry_column(["a", "b"])


def test_layer_reading(spark, tmp_path):
    square = "[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[0,0],[2,0],[2,4],[0,4],[0,0]]]"
    text = (
        '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"A","population":5},'
        f'"geometry":{{"type":"Polygon","coordinates":{square}}}}},'
        '{"type":"Feature","properties":{"name":"B"},"geometry":{"type":"Point","coordinates":[7,8]}}]}'
    )
    path = tmp_path / "layer.json"
    path.write_text(text)
    with pytest.warns(UserWarning, match="No CRS"):
        layer = geojson.read_layer(spark, str(path))
    rows = {r.properties["name"]: r for r in layer.collect()}
    assert (rows["A"].x, rows["A"].y) == (3, 2)  # the hole takes the left half away
    assert (rows["B"].x, rows["B"].y) == (7, 8) and rows["A"].properties["population"] == "5"
    assert tuple(geojson.bounds(layer).first()) == (0, 0, 7, 8)
    with pytest.raises(FileNotFoundError):
        geojson.read_layer(spark, str(tmp_path / "none.json"))
    (tmp_path / "empty.json").write_text('{"type":"FeatureCollection","crs":{"properties":{"name":"EPSG:3857"}},"features":[]}')
    assert geojson.read_layer(spark, str(tmp_path / "empty.json")).count() == 0


def test_geojson_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, 2.5), ("b", None, 2.0)], "id string, lon double, lat double")
    geojson.write_lines(df, str(tmp_path / "out"), "lon", "lat", ["id"])
    back = {r.properties["id"]: r for r in geojson.read_layer(spark, str(tmp_path / "out"), lines=True).collect()}
    assert (back["a"].x, back["a"].y) == (1.5, 2.5) and back["b"].x is None


def test_map_layer(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, "High"), ("b", 1.0, 2.0, None)], "id string, lon double, lat double, risk_level string")
    rows = {r.id: r for r in layers.map_layer(df, "lon", "lat", "id").collect()}
    assert rows["a"].marker_colour == "orange" and rows["b"].marker_colour == "blue"
    assert {r.popup for r in rows.values()} == {f"Auto Theft Incident<br>Index: {i}" for i in (0, 1)}
    head = layers.layer_header(df, "lon", "lat").first()
    assert head.title == "Auto Theft Locations (2 incidents)" and head.centre_lat == 2


def test_entity_column_sets():
    assert [len(e.required) for e in (THEFT, SUSPECT, RECOVERY)] == [12, 8, 5]
    assert [len(e.columns) for e in (THEFT, SUSPECT, RECOVERY)] == [23, 24, 22]


def test_box_filter_reaches_the_scan(spark, tmp_path):
    store.save(_suspects(spark, "a"), SUSPECT, str(tmp_path / "t"))
    kept = filters.near_suspects(store.read(spark, str(tmp_path / "t")), (40.7, -74.2), 1).select("suspect_id")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(address_lat" in plan and "LessThanOrEqual(address_lon" in plan
    assert "suspect_name" not in plan


@pytest.mark.parametrize("name,x", [("EPSG:4326", 1.0), ("urn:ogc:def:crs:OGC:1.3:CRS84", 1.0), ("EPSG:2263", None), ("EPSG:13857", None)])
def test_only_known_reference_systems(spark, tmp_path, name, x):
    from precinct.sources.geojson import read_layer

    feature = '{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1.0,2.0]}}'
    file = tmp_path / "layer.json"
    file.write_text('{"type":"FeatureCollection","crs":{"properties":{"name":"%s"}},"features":[%s]}' % (name, feature))
    if x is None:
        with pytest.raises(ValueError, match="not supported"):
            read_layer(spark, str(file))
    else:
        assert read_layer(spark, str(file)).first().x == x
