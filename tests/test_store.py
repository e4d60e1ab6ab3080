"""Inserting into tables of any schema, and what box queries on stored tables read."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precinct.schemas import SUSPECT
from precinct.sources import store

SCHEMA = T.StructType()
for name, kind in zip(
    ["id", "n", "lat", "lon", "geometry_wkt", "other"],
    [T.StringType(), T.IntegerType(), T.DoubleType(), T.DoubleType(), T.StringType(), T.StringType()],
    strict=True,
):
    SCHEMA.add(name, kind)


def _rows(spark, *ids):
    rows = [(f"extra{i}", -74.0 - i / 10, float(i) + 0.4, 40.0 + i / 10, key) for i, key in enumerate(ids)]
    return spark.createDataFrame(rows, "surplus string, lon double, n double, lat double, id string")


def _ids(spark, table):
    return sorted(r.id for r in store.read(spark, table).collect())


@pytest.mark.parametrize("kind", ["path", "catalog"])
def test_insert_by_name(spark, tmp_path, kind):
    table = str(tmp_path / "t") if kind == "path" else f"inserted_{tmp_path.name.replace('-', '_')}"
    if kind == "catalog":
        spark.sql(f"CREATE TABLE {table} (id STRING, n INT, lat DOUBLE, lon DOUBLE, geometry_wkt STRING, other STRING, created_at TIMESTAMP_NTZ) USING parquet LOCATION '{tmp_path}/c'")
    store.create_table(spark, table, SCHEMA)
    store.insert(_rows(spark, "a", "b"), table, key="id", place=("lat", "lon"))
    store.insert(_rows(spark, "c").drop("lat"), table, key="id", clear_existing=False, place=("lat", "lon"))
    back = store.read(spark, table)
    assert back.columns == [*SCHEMA.names, "created_at"] and _ids(spark, table) == ["a", "b", "c"]
    a, c = (back.where(f"id = '{i}'").first() for i in "ac")
    assert (a.n, a.geometry_wkt, a.other) == (0, "POINT (-74.0 40.0)", None) and a.created_at is not None
    assert (c.lat, c.geometry_wkt, c.lon) == (None, None, -74.0)
    for wrong in (_rows(spark, "d", "a"), _rows(spark, "d", "d")):
        with pytest.raises(ValueError, match="duplicate key"):
            store.insert(wrong, table, key="id", clear_existing=False)
    with pytest.raises(ValueError, match="duplicate key"):
        store.insert(_rows(spark, "d", "d"), table, key="id")
    assert _ids(spark, table) == ["a", "b", "c"]
    store.insert(_rows(spark, "a", None, None), table, key="id")
    assert store.read(spark, table).count() == 3
    if kind == "catalog":
        spark.sql(f"DROP TABLE {table}")


def test_a_failing_source_leaves_the_table(spark, tmp_path):
    table = str(tmp_path / "t")
    store.create_table(spark, table, SCHEMA)
    store.insert(_rows(spark, "a"), table)
    failing = _rows(spark, "b").withColumn("other", F.raise_error(F.lit("broken source")).cast("string"))
    with pytest.raises(Exception, match="broken source"):
        store.insert(failing, table)
    assert _ids(spark, table) == ["a"] and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(ValueError, match="while reading"):
        store.insert(store.read(spark, table), table)


def test_the_source_runs_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    table = str(tmp_path / "t")
    rows = _rows(spark, *"abcdefgh")
    store.create_table(spark, table, SCHEMA)
    store.insert(rows.mapInArrow(seen, rows.schema), table, key="id", place=("lat", "lon"))
    assert runs.value == 8


def test_required_columns_and_second_place(spark, tmp_path):
    table = str(tmp_path / "t")
    store.create_table(spark, table, T.StructType.fromDDL("id string, is_new boolean, n int, lat_lon_geometry string"))
    store.insert(_rows(spark, "a"), table, second=("lat", "lon"), required={"is_new": "boolean", "id": "string"}, policy="compat")
    row = store.read(spark, table).first()
    assert (row.id, row.is_new, row.lat_lon_geometry) == ("a", False, "POINT (-74.0 40.0)")


def test_z_order_is_the_bits_in_turn(spark):
    places = [(-90.0, -180.0), (40.7, -74.2), (89.99, 179.99), (90.0, 180.0), (0.0, 0.0)]
    got = spark.createDataFrame(places, "lat double, lon double").select(store.z_order("lat", "lon").alias("z")).collect()
    for (lat, lon), row in zip(places, got, strict=True):
        y, x = (min((1 << 20) - 1, int((v + half) / (2 * half) * (1 << 20))) for v, half in ((lat, 90), (lon, 180)))
        assert row.z == sum(((y >> b & 1) << 2 * b) | ((x >> b & 1) << 2 * b + 1) for b in range(20))


def test_box_queries_skip_row_groups_in_both_directions(spark, tmp_path):
    rows = spark.range(4096).select(
        F.concat(F.lit("s"), "id").alias("suspect_id"), (40 + (F.col("id") % 64) / 64).alias("address_lat"),
        (-74 + F.floor(F.col("id") / 64) / 64).alias("address_lon"),
    )
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store.save(rows, SUSPECT, str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    groups = []
    for file in (tmp_path / "t").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = [meta.row_group(g).column(c) for c in range(meta.num_columns)]
            groups.append({c.path_in_schema: (c.statistics.min, c.statistics.max) for c in columns if c.path_in_schema in ("address_lat", "address_lon")})
    assert len(groups) >= 8
    for column, at in (("address_lat", 40.1), ("address_lon", -73.9)):
        assert sum(g[column][0] <= at <= g[column][1] for g in groups) <= len(groups) / 2
