"""Rows ready for a map client: marker position, colour and popup text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.functions.labels import popup, risk_colour
from precinct.operators.stats import map_centre
from precinct.runtime import numbered

DEFAULT_COLOUR = "red"


def map_layer(
    rows: DataFrame, lon: str, lat: str, row_id: str, popup_columns: list[str] | None = None
) -> DataFrame:
    """(row_id, marker_lat, marker_lon, marker_colour, popup) of the rows.

    Colour follows the risk level where there is one. Without popup columns the text
    counts the rows.
    """
    index = None
    columns = list(popup_columns or [])
    if not columns:
        rows = numbered(rows, name="_index")
        index = F.col("_index")
    colour = risk_colour() if "risk_level" in rows.columns else F.lit(DEFAULT_COLOUR)
    return rows.select(
        F.col(row_id),
        F.col(lat).alias("marker_lat"),
        F.col(lon).alias("marker_lon"),
        colour.alias("marker_colour"),
        popup(columns, rows.columns, index).alias("popup"),
    )


def layer_header(rows: DataFrame, lon: str, lat: str) -> DataFrame:
    """One row: centre, title and number of incidents of a layer."""
    total = rows.agg(F.count("*").alias("n")).scalar()
    title = F.concat(F.lit("Auto Theft Locations ("), total.cast("string"), F.lit(" incidents)"))
    return map_centre(rows, lon, lat).select("*", total.alias("n"), title.alias("title"))
