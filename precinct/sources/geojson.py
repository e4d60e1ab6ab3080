"""Boundary layers from GeoJSON, and point rows to GeoJSON lines."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.functions.geo import WEB_MERCATOR, WGS84, reproject
from precinct.functions.shapes import area_centre
from precinct.runtime import exists

# The names of the two systems that coordinates may be in.
_CRS_NAMES = {
    "EPSG:4326": WGS84, "urn:ogc:def:crs:EPSG::4326": WGS84, "urn:ogc:def:crs:OGC:1.3:CRS84": WGS84, "OGC:CRS84": WGS84,
    "EPSG:3857": WEB_MERCATOR, "urn:ogc:def:crs:EPSG::3857": WEB_MERCATOR,
}

_PROPERTIES = "map<string,string>"
_FEATURE = "struct<type:string,properties:string,geometry:string>"


def read_layer(spark: SparkSession, path: str, crs: str = WGS84, lines: bool = False) -> DataFrame:
    """Features of a layer: properties, geometry_type, polygons, and their centroid x, y.

    Reads a FeatureCollection, or with `lines` one feature per line, which splits over
    tasks. A collection without a CRS name is taken as WGS 84. `polygons` holds for each
    polygon its rings of points, outer ring first; points have none.
    """
    if not exists(spark, path):
        raise FileNotFoundError(f"Layer not found: {path}")
    source = WGS84
    if lines:
        features = spark.read.schema(_FEATURE[7:-1].replace(":", " ")).json(path)
    else:
        whole = spark.read.option("multiLine", True).schema(
            f"type string, crs string, features array<{_FEATURE}>"
        ).json(path)
        named = whole.select(F.get_json_object("crs", "$.properties.name").alias("name"), "type").first()
        if named is None or named["type"] != "FeatureCollection":
            raise ValueError(f"Error reading layer {path}: not a FeatureCollection")
        if named["name"] is None:
            warnings.warn(f"No CRS found in layer, assuming {WGS84}")
        elif named["name"] not in _CRS_NAMES:
            raise ValueError(f"Error reading layer {path}: CRS {named['name']} is not supported")
        else:
            source = _CRS_NAMES[named["name"]]
        features = whole.select(F.inline("features"))

    kind = F.get_json_object("geometry", "$.type")
    text = F.get_json_object("geometry", "$.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).when(
        kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>")
    )
    spot = F.when(kind == "Point", F.from_json(text, "array<double>"))

    def moved(p):
        x, y = reproject(p[0], p[1], source, crs)
        return F.struct(x.alias("x"), y.alias("y"))

    rings = F.transform(polygons, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, moved)))
    parsed = features.select(
        F.from_json("properties", _PROPERTIES).alias("properties"),
        kind.alias("geometry_type"),
        rings.alias("polygons"),
        moved(spot).alias("_spot"),
    )
    return parsed.withColumn("_centre", F.coalesce(area_centre("polygons"), F.when(kind_is_point(), F.col("_spot")))).select(
        "properties", "geometry_type", "polygons", F.col("_centre.x").alias("x"), F.col("_centre.y").alias("y")
    )


def kind_is_point():
    return F.col("geometry_type") == "Point"


def bounds(layer: DataFrame) -> DataFrame:
    """One row (minx, miny, maxx, maxy) over all ring points and point features."""
    corners = F.flatten(F.flatten("polygons"))
    own = F.when(F.col("polygons").isNull(), F.array(F.struct("x", "y")))
    points = layer.select(F.inline(F.coalesce(corners, own)))
    return points.agg(
        F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy")
    )


def feature_lines(rows: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """One GeoJSON point feature per row, as column `value`; no location gives a null geometry."""
    here = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    geometry = F.when(
        here, F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    )
    # null members are written out, as the format asks for geometry: null
    return rows.select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")
            ),
            {"ignoreNullFields": "false"},
        ).alias("value")
    )


def write_lines(rows: DataFrame, path: str, lon: str, lat: str, properties: list[str]) -> None:
    feature_lines(rows, lon, lat, properties).write.mode("overwrite").text(path)
