"""Point rows from coordinate lists and coordinate columns."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.functions.geo import out_of_range, point
from precinct.schemas import SUSPECT


def from_coordinates(
    spark: SparkSession,
    coordinates: list[tuple[float, float]],
    attributes: dict[str, list] | None = None,
) -> DataFrame:
    """Rows with `geometry` from (lon, lat) pairs on the driver, with optional columns of equal length."""
    columns = {"_lon": [float(p[0]) for p in coordinates], "_lat": [float(p[1]) for p in coordinates], **(attributes or {})}
    if not coordinates:
        raise ValueError("No coordinates provided")
    uneven = sorted(name for name, values in columns.items() if len(values) != len(coordinates))
    if uneven:
        raise ValueError(f"Attribute '{uneven[0]}' does not have one value per coordinate")
    listed = spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))
    wrong = next((i for i, (x, y) in enumerate(zip(columns["_lon"], columns["_lat"], strict=True)) if not (abs(x) <= 180 and abs(y) <= 90)), None)
    if wrong is not None:
        raise ValueError(f"Invalid coordinates at index {wrong}")
    return listed.withColumn("geometry", point("_lon", "_lat")).drop("_lon", "_lat")


def from_columns(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Rows with `geometry` in place of two coordinate columns; rows lacking one are left out with a warning."""
    absent = {lon, lat} - set(df.columns)
    if absent:
        raise KeyError(f"no such columns: {', '.join(sorted(absent))}")
    placed = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    lost = df.where(~placed).count()
    if lost:
        warnings.warn(f"{lost} rows without coordinates are left out")
    return df.where(placed).withColumn("geometry", point(lon, lat)).drop(lon, lat)


def checked(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """The same rows; the job fails on a coordinate out of range."""
    message = F.format_string("Invalid coordinates: (%s, %s)", F.col(lon), F.col(lat))
    return df.withColumn(lat, F.when(out_of_range(lat, lon), F.raise_error(message)).otherwise(F.col(lat)))


def arrest_points(suspects: DataFrame) -> DataFrame:
    """The same suspects with the arrest location as `geometry`."""
    lat, lon = SUSPECT.points[1]
    return suspects.withColumn("geometry", point(lon, lat))
