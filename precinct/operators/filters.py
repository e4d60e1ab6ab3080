"""Criteria and distance filters. Each one is a single `where` that Catalyst can push down."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.functions.geo import within_box
from precinct.operators.quantiles import quantile
from precinct.schemas import SUSPECT, THEFT, RECOVERY, Entity

# The levels and histories with a filter of their own.
HIGH_RISK = ["High", "Critical"]
REPEAT_HISTORY = ["Repeat Offender", "Career Criminal"]


def _one_of(column: str, values: list | None) -> Column | None:
    if values is None:
        return None
    return F.col(column).isin(list(values)) if values else F.lit(False)


def _at_least(column: str, bound) -> Column | None:
    return None if bound is None else F.col(column) >= F.lit(bound)


def _at_most(column: str, bound) -> Column | None:
    return None if bound is None else F.col(column) <= F.lit(bound)


def _keep(df: DataFrame, wanted: list[tuple[str, Column | None]]) -> DataFrame:
    """AND of the given conditions; those switched off or on absent columns are skipped."""
    present = set(df.columns)
    for column, condition in wanted:
        if condition is not None and column in present:
            df = df.where(condition)
    return df


def thefts(
    df: DataFrame,
    min_value: float | None = None,
    max_value: float | None = None,
    vehicle_types: list[str] | None = None,
    makes: list[str] | None = None,
    min_year: int | None = None,
    max_year: int | None = None,
) -> DataFrame:
    """Inclusive bounds; None switches a criterion off, an empty list keeps nothing."""
    return _keep(
        df,
        [
            ("vehicle_value", _at_least("vehicle_value", min_value)),
            ("vehicle_value", _at_most("vehicle_value", max_value)),
            ("vehicle_type", _one_of("vehicle_type", vehicle_types)),
            ("vehicle_make", _one_of("vehicle_make", makes)),
            ("vehicle_year", _at_least("vehicle_year", min_year)),
            ("vehicle_year", _at_most("vehicle_year", max_year)),
        ],
    )


def _now(as_of: dt.datetime | None) -> dt.datetime:
    return as_of or dt.datetime.now()


def suspects(
    df: DataFrame,
    risk_levels: list[str] | None = None,
    charges: list[str] | None = None,
    min_age: int | None = None,
    max_age: int | None = None,
    gender: str | None = None,
    recent_arrests_only: bool = False,
    days_threshold: int = 180,
    as_of: dt.datetime | None = None,
) -> DataFrame:
    """Criteria on suspects; `as_of` stands in for the current time."""
    since = _now(as_of) - dt.timedelta(days=days_threshold) if recent_arrests_only else None
    return _keep(
        df,
        [
            ("risk_level", _one_of("risk_level", risk_levels)),
            ("arrest_charges", _one_of("arrest_charges", charges)),
            ("suspect_age", _at_least("suspect_age", min_age)),
            ("suspect_age", _at_most("suspect_age", max_age)),
            ("suspect_gender", None if gender is None else F.col("suspect_gender") == gender),
            (
                "last_arrest_date",
                None if since is None else F.col("last_arrest_date") >= F.lit(since).cast("timestamp_ntz"),
            ),
        ],
    )


def stored_suspects(
    df: DataFrame,
    risk_levels: list[str] | None = None,
    charges: list[str] | None = None,
    min_age: int | None = None,
    max_age: int | None = None,
    gender: str | None = None,
    recent_arrests_days: int | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """As `suspects`, with the stored table's rules: empty means off, recency by date."""
    rows = suspects(df, risk_levels or None, charges or None, min_age, max_age, gender or None)
    if recent_arrests_days is None:
        return rows
    today = as_of or dt.date.today()
    since = dt.datetime.combine(today, dt.time()) - dt.timedelta(days=recent_arrests_days)
    return rows.where(F.col("last_arrest_date") >= F.lit(since).cast("timestamp_ntz"))


def high_risk(df: DataFrame) -> DataFrame:
    return suspects(df, risk_levels=HIGH_RISK)


def repeat_offenders(df: DataFrame) -> DataFrame:
    if "criminal_history" not in df.columns:
        return df.where(F.lit(False))
    return df.where(F.col("criminal_history").isin(REPEAT_HISTORY))


def _linked(column: str, wanted: bool | None) -> Column | None:
    if wanted is None:
        return None
    return F.col(column).isNotNull() if wanted else F.col(column).isNull()


def _moment(text: str | None) -> Column | None:
    return None if text is None else F.lit(text).cast("timestamp_ntz")


def recoveries(
    df: DataFrame,
    vehicle_conditions: list[str] | None = None,
    recovery_agencies: list[str] | None = None,
    criminal_locations_only: bool = False,
    with_theft_link: bool | None = None,
    with_suspect_link: bool | None = None,
    case_status: list[str] | None = None,
    min_date: str | None = None,
    max_date: str | None = None,
) -> DataFrame:
    """Criteria on recoveries; a bare date as upper bound means its midnight."""
    return _keep(
        df,
        [
            ("vehicle_condition", _one_of("vehicle_condition", vehicle_conditions)),
            ("recovery_agency", _one_of("recovery_agency", recovery_agencies)),
            ("is_criminal_location", F.col("is_criminal_location") if criminal_locations_only else None),
            ("incident_id", _linked("incident_id", with_theft_link)),
            ("suspect_id", _linked("suspect_id", with_suspect_link)),
            ("case_status", _one_of("case_status", case_status)),
            ("recovery_date", _at_least("recovery_date", _moment(min_date))),
            ("recovery_date", _at_most("recovery_date", _moment(max_date))),
        ],
    )


def linked_recoveries(df: DataFrame) -> DataFrame:
    return df.where(F.col("incident_id").isNotNull() | F.col("suspect_id").isNotNull())


def criminal_recoveries(df: DataFrame) -> DataFrame:
    if "is_criminal_location" not in df.columns:
        return df.where(F.lit(False))
    return df.where(F.col("is_criminal_location"))


def near(
    df: DataFrame,
    centre: tuple[float, float],
    radius_km: float,
    lat: str = "lat",
    lon: str = "lon",
) -> DataFrame:
    """Rows in the degree square around `centre` = (lat, lon)."""
    return df.where(within_box(lat, lon, centre, radius_km))


def near_entity(df: DataFrame, entity: Entity, centre: tuple[float, float], radius_km: float) -> DataFrame:
    return near(df, centre, radius_km, entity.lat, entity.lon)


def near_thefts(df: DataFrame, centre: tuple[float, float], radius_km: float) -> DataFrame:
    return near_entity(df, THEFT, centre, radius_km)


def near_recoveries(df: DataFrame, centre: tuple[float, float], radius_km: float) -> DataFrame:
    return near_entity(df, RECOVERY, centre, radius_km)


def near_suspects(
    df: DataFrame, centre: tuple[float, float], radius_km: float, location_type: str = "address"
) -> DataFrame:
    places = {"address": SUSPECT.points[0], "arrest": SUSPECT.points[1]}
    if location_type not in places:
        raise ValueError("location_type must be 'address' or 'arrest'")
    lat, lon = places[location_type]
    return near(df, centre, radius_km, lat, lon)


def above_quantile(df: DataFrame, score: str, q: float = 0.8) -> DataFrame:
    """Rows whose score lies strictly above the exact `q` quantile of the table."""
    return df.where(F.col(score) > quantile(df, score, q).scalar())
