"""Descriptive columns for map layers and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from precinct.functions.geo import col

# Marker colour per risk level.
RISK_COLOURS = {"Low": "green", "Medium": "yellow", "High": "orange", "Critical": "red"}
OTHER_COLOUR = "blue"


def relationship_type(incident: Column | str = "incident_id", suspect: Column | str = "suspect_id") -> Column:
    theft, person = col(incident).isNotNull(), col(suspect).isNotNull()
    return (
        F.when(theft & person, "Both")
        .when(theft, "Theft Only")
        .when(person, "Suspect Only")
        .otherwise("None")
    )


def risk_colour(level: Column | str = "risk_level") -> Column:
    colour = F.lit(OTHER_COLOUR)
    for name, shade in RISK_COLOURS.items():
        colour = F.when(col(level) == name, shade).otherwise(colour)
    return colour


def popup(columns: list[str], available: list[str], index: Column | None = None) -> Column:
    """Marker text from the chosen columns that exist, or a numbered default text."""
    if not columns:
        place = index if index is not None else F.lit(0)
        return F.concat(F.lit("Auto Theft Incident<br>Index: "), place.cast("string"))
    shown = [c for c in columns if c in available]
    parts = [
        F.concat(F.lit(f"<b>{c}:</b> "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in shown
    ]
    return F.concat_ws("<br>", *parts)


def proximity(distance: Column | str, scale: float = 1.0) -> Column:
    """1 / (1 + scale * distance): 1 on the spot, falling with distance."""
    return F.lit(1.0) / (F.lit(1.0) + col(distance) * scale)


# First present one wins, in this order.
DATE_COLUMNS = ["incident_date", "arrest_date", "recovery_date"]


def date_column(available: list[str], candidates: list[str] = DATE_COLUMNS) -> str | None:
    return next((c for c in candidates if c in available), None)


def temporal_parts(date: Column | str) -> dict[str, Column]:
    """Hour, weekday (Monday = 0), month and quarter."""
    d = col(date)
    return {
        "hour": F.hour(d),
        "dow": F.weekday(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
    }
