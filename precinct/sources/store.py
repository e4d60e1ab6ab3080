"""Typed Parquet tables of records: create, save, load, describe and query.

A table is a catalog name, or a path when it contains a slash.
"""

from __future__ import annotations

import datetime as dt
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precinct.functions import shapes
from precinct.functions.geo import from_wkt, to_wkt
from precinct.operators.conform import NULLS, conform
from precinct.operators.filters import near
from precinct.runtime import cut, drop, exists, move_files, replace_folder, scratch
from precinct.schemas import CREATED_AT, Entity

# Bits of each coordinate in the sort key of stored places, and the steps that set one bit apart from the next.
_Z_BITS = 20
_Z_MASKS = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _is_path(table: str) -> bool:
    return "/" in table


def read(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table) if _is_path(table) else spark.table(table)


def create_table(spark: SparkSession, table: str, schema: T.StructType) -> None:
    """An empty table with a creation time column; an existing table is left as it is."""
    if CREATED_AT not in schema.names:
        schema = T.StructType([*schema, T.StructField(CREATED_AT, T.TimestampNTZType())])
    empty = spark.createDataFrame([], schema)
    if _is_path(table):
        empty.write.mode("ignore").parquet(table)
    else:
        empty.write.mode("ignore").saveAsTable(table)


def with_wkt(rows: DataFrame, entity: Entity) -> DataFrame:
    """Location texts of every point pair whose columns are there."""
    for (lat, lon), name in zip(entity.points, entity.wkt):
        if lat in rows.columns and lon in rows.columns:
            rows = rows.withColumn(name, to_wkt(lon, lat))
    return rows


def stored_form(
    rows: DataFrame, entity: Entity, policy: str = NULLS, as_of: dt.datetime | None = None
) -> DataFrame:
    """Exactly the stored columns and types of the entity, unknown columns dropped."""
    required = {c: entity.schema[c].dataType.simpleString() for c in entity.columns}
    full = with_wkt(conform(rows, required, policy, as_of), entity)
    created = (F.lit(as_of) if as_of else F.current_timestamp()).cast("timestamp_ntz")
    full = full.withColumn(CREATED_AT, created)
    for name in entity.wkt:
        if name not in full.columns:
            full = full.withColumn(name, F.lit(None).cast("string"))
    return full.select([_cast(f, full).alias(f.name) for f in entity.stored_schema])


def _cast(field: T.StructField, df: DataFrame) -> Column:
    value = F.col(field.name)
    if isinstance(field.dataType, T.IntegerType) and isinstance(
        df.schema[field.name].dataType, (T.DoubleType, T.FloatType)
    ):
        value = F.rint(value)
    return value.cast(field.dataType)


def require_unique(rows: DataFrame, key: str, stored: DataFrame | None = None) -> None:
    """Storage does not enforce keys, so a job looks for one that occurs twice, or in `stored` already."""
    present = rows.where(F.col(key).isNotNull()).select(key)
    twice = present.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").first()
    if twice is None and stored is not None:
        known = stored.select(F.col(key).cast(present.schema[key].dataType).alias(key))
        twice = present.join(known, key, "left_semi").first()
    if twice is not None:
        raise ValueError(f"duplicate key {key} = {twice[0]!r}")


def z_order(lat: str, lon: str) -> Column:
    """The bits of both coordinates in turn, 20 of each: places with near keys are near in both directions."""

    def spread_out(column: str, low: float, width: float) -> Column:
        steps = F.floor((F.col(column) - low) / width * (1 << _Z_BITS))
        bits = F.greatest(F.lit(0), F.least(F.lit((1 << _Z_BITS) - 1), steps)).cast("bigint")
        for shift, mask in _Z_MASKS:
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
        return bits

    return spread_out(lat, -90.0, 180.0).bitwiseOR(F.shiftleft(spread_out(lon, -180.0, 360.0), 1))


def insert(
    rows: DataFrame,
    table: str,
    key: str | None = None,
    clear_existing: bool = True,
    place: tuple[str, str] | None = None,
    geometry: str = "geometry",
    second: tuple[str, str] | None = None,
    required: dict[str, str] | None = None,
    policy: str = NULLS,
    as_of: dt.datetime | None = None,
) -> None:
    """Put rows into an existing table of any schema, by column name.

    Columns that the table lacks are dropped, columns that the rows lack are null, and values are
    cast to the table's types; a creation time column is filled. `place` and `second` are (lat, lon)
    columns whose points are written as text to `<geometry>_wkt` and `<lat>_<lon>_geometry`;
    `required` columns are filled as in `conform`. A `key` found twice, in the rows or, when
    appending, in the table too, is refused, and then or on any other failure before the last step
    the table keeps what it had.

    The source is run once, into a staged folder, sorted along a space-filling curve over `place`, so
    that box queries skip row groups by both coordinates. Files are then renamed into the table.
    """
    spark = rows.sparkSession
    if _is_path(table) and _reads_from(rows, table):
        raise ValueError(f"cannot write {table} while reading from it")
    there = read(spark, table)
    if required:
        rows = conform(rows, required, policy, as_of)
    if place and set(place) <= set(rows.columns):
        rows = rows.withColumn(f"{geometry}_wkt", to_wkt(place[1], place[0]))
    if second and set(second) <= set(rows.columns):
        rows = rows.withColumn(f"{second[0]}_{second[1]}_geometry", to_wkt(second[1], second[0]))
    if CREATED_AT in there.columns and CREATED_AT not in rows.columns:
        rows = rows.withColumn(CREATED_AT, F.lit(as_of) if as_of else F.current_timestamp())
    shaped = rows.select(
        [
            _cast(f, rows).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in there.schema
        ]
    )
    _put(shaped, table, key, None if clear_existing else there, place)


def _put(rows: DataFrame, table: str, key: str | None, appended_to: DataFrame | None, place: tuple[str, str] | None) -> None:
    """Stage rows, check their keys, and only then make them the table or part of it."""
    spark = rows.sparkSession
    with scratch(spark):
        staged = cut(rows)
        if key:
            require_unique(staged, key, appended_to)
        if place and set(place) <= set(staged.columns):
            order = [z_order(*place), *([F.col(key)] if key else [])]
            staged = staged.repartitionByRange(*order).sortWithinPartitions(*order)
        if not _is_path(table):
            staged.write.mode("overwrite" if appended_to is None else "append").insertInto(table)
            return
        folder = table.rstrip("/")
        fresh = f"{folder}-staged-{uuid.uuid4().hex}"
        try:
            staged.write.parquet(fresh)
            if appended_to is None:
                replace_folder(spark, folder, fresh)
            else:
                move_files(spark, fresh, folder)
        finally:
            drop(spark, fresh)


def save(
    rows: DataFrame,
    entity: Entity,
    table: str | None = None,
    clear_existing: bool = True,
    policy: str = NULLS,
    as_of: dt.datetime | None = None,
) -> None:
    """Write rows in the entity's stored form, creating its table if need be; refuses duplicate keys."""
    spark, table = rows.sparkSession, table or entity.table
    if _is_path(table) and exists(spark, table) and _reads_from(rows, table):
        raise ValueError(f"cannot write {table} while reading from it")
    create_table(spark, table, entity.stored_schema)
    stored = stored_form(rows, entity, policy, as_of)
    _put(stored, table, entity.key, None if clear_existing else read(spark, table), entity.points[0])


def _reads_from(rows: DataFrame, path: str) -> bool:
    """Whether a folder that the plan of `rows` reads is `path` or lies in it."""
    place = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    folder = system.makeQualified(place).toString().rstrip("/")
    leaves = rows._jdf.queryExecution().analyzed().collectLeaves()
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRelation" and hasattr(leaf.relation(), "location"):
            roots = leaf.relation().location().rootPaths()
            for i in range(roots.size()):
                read = system.makeQualified(roots.apply(i)).toString().rstrip("/")
                if read == folder or read.startswith(folder + "/"):
                    return True
    return False


def geometry_column(columns: list[str]) -> str:
    """The first column whose name speaks of a geometry text."""
    for c in columns:
        if "geometry" in c.lower() or "_wkt" in c.lower():
            return c
    raise ValueError("No geometry column found")


def with_geometry(rows: DataFrame, wkt: str | None = None, drop_text: bool = True) -> DataFrame:
    """`geometry` decoded from a text column: a point, or the centre of another shape; bad or blank text gives null."""
    source = wkt or geometry_column(rows.columns)
    point = F.coalesce(from_wkt(source), shapes.centre(shapes.from_wkt(source)))
    texts = [c for c in rows.columns if "_wkt" in c.lower() or "geometry" in c.lower()] if drop_text else []
    return rows.select([c for c in rows.columns if c not in texts] + [point.alias("geometry")])


def load(spark: SparkSession, table: str, wkt: str | None = None) -> DataFrame:
    """All rows with `geometry`, without the text helpers. An empty table keeps its columns."""
    rows = read(spark, table)
    if rows.isEmpty():
        warnings.warn(f"No data found in table {table}")
    return with_geometry(rows, wkt)


def query_by_distance(
    spark: SparkSession,
    table: str,
    centre: tuple[float, float],
    radius_km: float,
    lat: str = "lat",
    lon: str = "lon",
    wkt: str | None = None,
) -> DataFrame:
    """Rows in the degree square around `centre`, with `geometry` and the text helpers."""
    return with_geometry(near(read(spark, table), centre, radius_km, lat, lon), wkt, drop_text=False)


def execute_query(spark: SparkSession, sql: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """SQL over stored tables and over frames named as {name} in the text."""
    return spark.sql(sql, args=args, **tables)


def table_info(df: DataFrame, key: str | None = None) -> DataFrame:
    """One row per column: cid, name, type, notnull, dflt_value, pk."""
    rows = [
        (i, f.name, f.dataType.simpleString(), not f.nullable, None, f.name == key)
        for i, f in enumerate(df.schema.fields)
    ]
    schema = "cid int, name string, type string, notnull boolean, dflt_value string, pk boolean"
    return df.sparkSession.createDataFrame(rows, schema)
