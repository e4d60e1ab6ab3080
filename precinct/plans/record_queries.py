"""Queries over the record views: cleaning, projections, filters, summaries, storage."""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precinct.functions import geo, labels, shapes
from precinct.operators import clean, conform, filters, layers, stats
from precinct.plans.catalog import query
from precinct.plans.views import load
from precinct.runtime import checkpoint_dir
from precinct.schemas import NULL_TOKENS, RECOVERY, SUSPECT, THEFT, Entity
from precinct.sources import csv, geojson, points, store

CENTRE_A = (40.7282, -74.2090)
CENTRE_B = (40.7357, -74.1724)
SUSPECTS_AS_OF = dt.datetime(2001, 8, 1)


def _round(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _box(lat: str, lon: str, centre: tuple[float, float], radius_km: float) -> str:
    reach = radius_km / 111.0
    return (
        f"{lat} BETWEEN {centre[0] - reach!r}e0 AND {centre[0] + reach!r}e0"
        f" AND {lon} BETWEEN {centre[1] - reach!r}e0 AND {centre[1] + reach!r}e0"
    )


# ---- scans -------------------------------------------------------------------------


@query(
    "SELECT incident_id, round(incident_lon, 9) AS x, round(incident_lat, 9) AS y FROM theft", ("theft",)
)
def scan_geo(spark: SparkSession, sf: str) -> DataFrame:
    rows = store.with_geometry(store.stored_form(load(spark, sf, "theft"), THEFT), "geometry_wkt")
    return rows.select("incident_id", F.round("geometry.x", 9).alias("x"), F.round("geometry.y", 9).alias("y"))


@query(
    """SELECT suspect_id, address_lon AS x, address_lat AS y FROM suspect
       WHERE address_lon IS NOT NULL AND address_lat IS NOT NULL""",
    ("suspect",),
)
def points_from_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = points.from_columns(load(spark, sf, "suspect"), "address_lon", "address_lat")
    return rows.select("suspect_id", "geometry.x", "geometry.y")


@query(
    """SELECT vehicle_type, CAST(count(*) AS BIGINT) AS n, round(avg(vehicle_value), 4) AS avg_value
       FROM theft WHERE vehicle_year >= 2010 GROUP BY vehicle_type""",
    ("theft",),
)
def adhoc_sql(spark: SparkSession, sf: str) -> DataFrame:
    text = """SELECT vehicle_type, count(*) AS n, round(avg(vehicle_value), 4) AS avg_value
              FROM {theft} WHERE vehicle_year >= :year GROUP BY vehicle_type"""
    return store.execute_query(spark, text, {"year": 2010}, theft=load(spark, sf, "theft"))


# ---- cleaning ----------------------------------------------------------------------

_TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)


def _missing(column: str) -> str:
    return f"({column} IS NULL OR {column} IN ({_TOKENS}))"


def _text_missing(entity) -> str:
    places = {c for pair in entity.points for c in pair}
    return " OR ".join(
        f"TRY_CAST({c} AS DOUBLE) IS NULL OR {_missing(c)}" if c in places else _missing(c) for c in entity.required
    )


def _beyond(lat: str, lon: str) -> str:
    lat, lon = f"TRY_CAST({lat} AS DOUBLE)", f"TRY_CAST({lon} AS DOUBLE)"
    return f"{lat} < -90 OR {lat} > 90 OR {lon} < -180 OR {lon} > 180"


_THEFT_BEYOND = f"{_beyond('incident_lat', 'incident_lon')} OR {_beyond('owner_lat', 'owner_lon')}"
_THEFT_REASON = f"""CASE WHEN {_text_missing(THEFT)} THEN 'missing_required'
  WHEN {_THEFT_BEYOND} THEN 'invalid_coordinates'
  WHEN TRY_CAST(vehicle_year AS DOUBLE) IS NULL THEN 'invalid_vehicle_year'
  WHEN TRY_CAST(vehicle_value AS DOUBLE) IS NULL THEN 'invalid_vehicle_value'
  WHEN TRY_CAST(owner_income AS DOUBLE) IS NULL THEN 'invalid_owner_income' END"""


@query(f"SELECT incident_id FROM theft_raw WHERE NOT ({_text_missing(THEFT)})", ("theft_raw",))
def clean_required(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.classify(load(spark, sf, "theft_raw"), THEFT)
    return rows.where(F.coalesce(clean.REASON, F.lit("")) != clean.MISSING).select("incident_id")


@query(f"SELECT incident_id FROM theft_raw WHERE ({_THEFT_REASON}) = 'invalid_coordinates'", ("theft_raw",))
def clean_coords(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.classify(load(spark, sf, "theft_raw"), THEFT)
    return rows.where(F.col(clean.REASON) == clean.BAD_COORDINATES).select("incident_id")


@query(
    f"""SELECT recovery_id, TRY_CAST(recovery_lat AS DOUBLE) AS recovery_lat,
          TRY_CAST(recovery_lon AS DOUBLE) AS recovery_lon
        FROM recovery_raw
        WHERE NOT ({_text_missing(RECOVERY)}) AND NOT ({_beyond('recovery_lat', 'recovery_lon')})""",
    ("recovery_raw",),
)
def clean_coords_recovery(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.cleaned(load(spark, sf, "recovery_raw"), RECOVERY)
    return rows.select("recovery_id", "recovery_lat", "recovery_lon")


@query(
    f"""SELECT incident_id, CAST(vehicle_year AS INT) AS vehicle_year,
          round(CAST(vehicle_value AS DOUBLE), 4) AS vehicle_value, round(CAST(owner_income AS DOUBLE), 4) AS owner_income
        FROM theft_raw WHERE ({_THEFT_REASON}) IS NULL""",
    ("theft_raw",),
)
def clean_numeric(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.cleaned(load(spark, sf, "theft_raw"), THEFT)
    kept = rows.select("incident_id", "vehicle_year", "vehicle_value", "owner_income")
    return _round(kept, {"vehicle_value": 4, "owner_income": 4})


@query(
    """SELECT suspect_id, CAST(TRY_CAST(suspect_age AS INT) AS DOUBLE) AS suspect_age, TRY_CAST(bail_amount AS DOUBLE) AS bail_amount
       FROM suspect_raw""",
    ("suspect_raw",),
)
def coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.classify(load(spark, sf, "suspect_raw"), SUSPECT)
    return rows.select("suspect_id", F.col("suspect_age").cast("double"), "bail_amount")


@query("SELECT incident_id, TRY_CAST(incident_date AS TIMESTAMP) AS incident_date FROM theft_raw", ("theft_raw",))
def coerce_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return clean.classify(load(spark, sf, "theft_raw"), THEFT).select("incident_id", "incident_date")


@query(
    """SELECT recovery_id, CASE WHEN lower(is_criminal_location) IN ('true', '1', 'yes', 'y') THEN 'true'
         WHEN lower(is_criminal_location) IN ('false', '0', 'no', 'n') THEN 'false' END AS is_criminal_location
       FROM recovery_raw""",
    ("recovery_raw",),
)
def bool_normalise(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean.classify(load(spark, sf, "recovery_raw"), RECOVERY)
    return rows.select("recovery_id", F.col("is_criminal_location").cast("string"))


@query(
    f"""SELECT coalesce({_THEFT_REASON}, 'accepted') AS reject_reason, CAST(count(*) AS BIGINT) AS n
        FROM theft_raw GROUP BY 1""",
    ("theft_raw",),
)
def reject_counts(spark: SparkSession, sf: str) -> DataFrame:
    return clean.reject_counts(clean.classify(load(spark, sf, "theft_raw"), THEFT))


# ---- projections -------------------------------------------------------------------


@query("SELECT suspect_id, arrest_lon AS x, arrest_lat AS y FROM suspect", ("suspect",))
def arrest_points(spark: SparkSession, sf: str) -> DataFrame:
    return points.arrest_points(load(spark, sf, "suspect")).select("suspect_id", "geometry.x", "geometry.y")


_WKT_PART = r"regexp_extract({}, 'POINT \(([^ ]+) ([^ )]+)\)', {})"


@query(
    f"""WITH texts AS (SELECT incident_id,
          concat('POINT (', CAST(incident_lon AS STRING), ' ', CAST(incident_lat AS STRING), ')') AS own,
          concat('POINT (', CAST(owner_lon AS STRING), ' ', CAST(owner_lat AS STRING), ')') AS owner FROM theft)
        SELECT incident_id, round(CAST({_WKT_PART.format('own', 1)} AS DOUBLE), 9) AS x,
          round(CAST({_WKT_PART.format('own', 2)} AS DOUBLE), 9) AS y,
          round(CAST({_WKT_PART.format('owner', 1)} AS DOUBLE), 9) AS owner_x,
          round(CAST({_WKT_PART.format('owner', 2)} AS DOUBLE), 9) AS owner_y FROM texts""",
    ("theft",),
)
def wkt_encode(spark: SparkSession, sf: str) -> DataFrame:
    texts = store.with_wkt(load(spark, sf, "theft"), THEFT)
    own, owner = (F.split(F.regexp_replace(c, r"[^0-9.eE+ -]|^POINT ", ""), " ") for c in THEFT.wkt)
    # numbers in text differ between engines in their last digit, so compare them parsed
    parts = {"x": F.element_at(own, -2), "y": F.element_at(own, -1), "owner_x": F.element_at(owner, -2), "owner_y": F.element_at(owner, -1)}
    return texts.select("incident_id", *[F.round(p.cast("double"), 9).alias(n) for n, p in parts.items()])


@query(
    """SELECT recovery_id,
         CASE WHEN k % 7 >= 3 THEN round(recovery_lon, 9) END AS x, CASE WHEN k % 7 >= 3 THEN round(recovery_lat, 9) END AS y
       FROM (SELECT *, CAST(substr(recovery_id, 4) AS INT) AS k FROM recovery)""",
    ("recovery",),
)
def wkt_decode(spark: SparkSession, sf: str) -> DataFrame:
    key = F.substring("recovery_id", 4, 20).cast("int") % 7
    good = geo.to_wkt("recovery_lon", "recovery_lat")
    text = F.when(key == 0, "nan").when(key == 1, "").when(key == 2, "POINT (1 north)").otherwise(good)
    rows = load(spark, sf, "recovery").withColumn("p", geo.from_wkt(text))
    return rows.select("recovery_id", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


@query(
    """SELECT incident_id, round(6378137e0 * radians(incident_lon), 4) AS x,
         round(6378137e0 * ln(tan(pi() / 4 + radians(incident_lat) / 2)), 4) AS y,
         round(incident_lon, 9) AS lon, round(incident_lat, 9) AS lat FROM theft""",
    ("theft",),
)
def reproject_3857(spark: SparkSession, sf: str) -> DataFrame:
    x, y = geo.reproject("incident_lon", "incident_lat", geo.WGS84, geo.WEB_MERCATOR)
    moved = load(spark, sf, "theft").select("incident_id", x.alias("x"), y.alias("y"))
    lon, lat = geo.reproject("x", "y", geo.WEB_MERCATOR, geo.WGS84)
    back = moved.withColumns({"lon": lon, "lat": lat})
    return _round(back, {"x": 4, "y": 4, "lon": 9, "lat": 9})


@query(
    """SELECT incident_id, incident_date, CAST(NULL AS VARCHAR) AS vehicle_color, CAST(NULL AS VARCHAR) AS police_report_id,
         CAST(NULL AS DOUBLE) AS insurance_claim, theft_method FROM theft""",
    ("theft",),
)
def conform_schema(spark: SparkSession, sf: str) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in THEFT.schema}
    full = conform.conform(load(spark, sf, "theft"), types)
    return full.select("incident_id", "incident_date", "vehicle_color", "police_report_id", "insurance_claim", "theft_method")


@query(
    """SELECT incident_id, 'ID_' || lpad(CAST(row_number() OVER (ORDER BY incident_id) AS VARCHAR), 6, '0') AS police_report_id,
         CAST(NULL AS VARCHAR) AS vehicle_color FROM theft""",
    ("theft",),
)
def conform_compat(spark: SparkSession, sf: str) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in THEFT.schema}
    full = conform.conform(load(spark, sf, "theft"), types, conform.COMPAT, order_by=["incident_id"])
    return full.select("incident_id", "police_report_id", "vehicle_color")


@query(
    """SELECT recovery_id, CASE WHEN incident_id IS NOT NULL AND suspect_id IS NOT NULL THEN 'Both'
         WHEN incident_id IS NOT NULL THEN 'Theft Only' WHEN suspect_id IS NOT NULL THEN 'Suspect Only'
         ELSE 'None' END AS relationship_type FROM recovery""",
    ("recovery",),
)
def relationship_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "recovery")
    return rows.select("recovery_id", labels.relationship_type().alias("relationship_type"))


@query(
    """SELECT suspect_id, CASE risk_level WHEN 'Low' THEN 'green' WHEN 'Medium' THEN 'yellow' WHEN 'High' THEN 'orange'
         WHEN 'Critical' THEN 'red' ELSE 'blue' END AS marker_colour FROM suspect""",
    ("suspect",),
)
def risk_colour(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "suspect").select("suspect_id", labels.risk_colour().alias("marker_colour"))


@query(
    """SELECT recovery_id, recovery_lat AS marker_lat, recovery_lon AS marker_lon, 'red' AS marker_colour,
         concat('<b>recovery_id:</b> ', recovery_id, '<br><b>vehicle_condition:</b> ', vehicle_condition,
                '<br><b>suspect_id:</b> ', coalesce(suspect_id, 'None')) AS popup FROM recovery""",
    ("recovery",),
)
def map_layer(spark: SparkSession, sf: str) -> DataFrame:
    shown = ["recovery_id", "vehicle_condition", "no_such_column", "suspect_id"]
    return layers.map_layer(load(spark, sf, "recovery"), "recovery_lon", "recovery_lat", "recovery_id", shown)


# ---- filters -----------------------------------------------------------------------

_THEFT_IDS = "SELECT incident_id, vehicle_type, vehicle_value FROM theft"


@query(
    f"""{_THEFT_IDS} WHERE vehicle_value >= 40000 AND vehicle_value <= 400000 AND vehicle_type IN ('economy', 'medium')
        AND vehicle_year >= 2005 AND vehicle_year <= 2020""",
    ("theft",),
)
def theft_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.thefts(
        load(spark, sf, "theft"), min_value=40000, max_value=400000, vehicle_types=["economy", "medium"],
        min_year=2005, max_year=2020,
    )
    return kept.select("incident_id", "vehicle_type", "vehicle_value")


_SUSPECT_IDS = "SELECT suspect_id, suspect_age, risk_level, last_arrest_date FROM suspect"
_SUSPECT_COLUMNS = ["suspect_id", "suspect_age", "risk_level", "last_arrest_date"]


@query(
    f"""{_SUSPECT_IDS} WHERE risk_level IN ('High', 'Critical') AND suspect_age >= 18 AND suspect_age <= 40
        AND suspect_gender = 'Male' AND last_arrest_date >= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY""",
    ("suspect",),
)
def suspect_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.suspects(
        load(spark, sf, "suspect"), risk_levels=["High", "Critical"], min_age=18, max_age=40, gender="Male",
        recent_arrests_only=True, as_of=SUSPECTS_AS_OF,
    )
    return kept.select(_SUSPECT_COLUMNS)


@query(
    f"""{_SUSPECT_IDS} WHERE suspect_age >= 18 AND suspect_age <= 30
        AND last_arrest_date >= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY""",
    ("suspect",),
)
def suspect_filter_sql(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.stored_suspects(
        load(spark, sf, "suspect"), risk_levels=[], min_age=18, max_age=30, gender="", recent_arrests_days=180,
        as_of=SUSPECTS_AS_OF.date(),
    )
    return kept.select(_SUSPECT_COLUMNS)


@query(f"{_SUSPECT_IDS} WHERE risk_level IN ('High', 'Critical')", ("suspect",))
def high_risk(spark: SparkSession, sf: str) -> DataFrame:
    return filters.high_risk(load(spark, sf, "suspect")).select(_SUSPECT_COLUMNS)


@query(f"{_SUSPECT_IDS} WHERE criminal_history IN ('Repeat Offender', 'Career Criminal')", ("suspect",))
def repeat_offenders(spark: SparkSession, sf: str) -> DataFrame:
    return filters.repeat_offenders(load(spark, sf, "suspect")).select(_SUSPECT_COLUMNS)


_RECOVERY_IDS = "SELECT recovery_id, vehicle_condition, recovery_date FROM recovery"
_RECOVERY_COLUMNS = ["recovery_id", "vehicle_condition", "recovery_date"]


@query(
    f"""{_RECOVERY_IDS} WHERE vehicle_condition IN ('Poor', 'Stripped', 'Burned') AND incident_id IS NOT NULL
        AND suspect_id IS NULL AND case_status IN ('Open', 'Pending')
        AND recovery_date >= TIMESTAMP '2024-01-02' AND recovery_date <= TIMESTAMP '2024-01-20'""",
    ("recovery",),
)
def recovery_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.recoveries(
        load(spark, sf, "recovery"), vehicle_conditions=["Poor", "Stripped", "Burned"], with_theft_link=True,
        with_suspect_link=False, case_status=["Open", "Pending"], min_date="2024-01-02", max_date="2024-01-20",
    )
    return kept.select(_RECOVERY_COLUMNS)


@query(f"{_RECOVERY_IDS} WHERE incident_id IS NOT NULL OR suspect_id IS NOT NULL", ("recovery",))
def linked_recoveries(spark: SparkSession, sf: str) -> DataFrame:
    return filters.linked_recoveries(load(spark, sf, "recovery")).select(_RECOVERY_COLUMNS)


@query(f"{_RECOVERY_IDS} WHERE is_criminal_location", ("recovery",))
def criminal_recoveries(spark: SparkSession, sf: str) -> DataFrame:
    return filters.criminal_recoveries(load(spark, sf, "recovery")).select(_RECOVERY_COLUMNS)


@query(f"{_SUSPECT_IDS} WHERE {_box('address_lat', 'address_lon', CENTRE_B, 5)}", ("suspect",))
def near_address(spark: SparkSession, sf: str) -> DataFrame:
    return filters.near_suspects(load(spark, sf, "suspect"), CENTRE_B, 5).select(_SUSPECT_COLUMNS)


@query(f"{_SUSPECT_IDS} WHERE {_box('arrest_lat', 'arrest_lon', CENTRE_B, 5)}", ("suspect",))
def near_arrest(spark: SparkSession, sf: str) -> DataFrame:
    return filters.near_suspects(load(spark, sf, "suspect"), CENTRE_B, 5, "arrest").select(_SUSPECT_COLUMNS)


@query(
    f"""SELECT incident_id, incident_lat, incident_lon, vehicle_value FROM theft
        WHERE {_box('incident_lat', 'incident_lon', CENTRE_A, 5)}""",
    ("theft",),
)
def near_theft(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.near_thefts(load(spark, sf, "theft"), CENTRE_A, 5)
    return kept.select("incident_id", "incident_lat", "incident_lon", "vehicle_value")


@query(f"{_RECOVERY_IDS} WHERE {_box('recovery_lat', 'recovery_lon', CENTRE_A, 5)}", ("recovery",))
def near_recovery(spark: SparkSession, sf: str) -> DataFrame:
    return filters.near_recoveries(load(spark, sf, "recovery"), CENTRE_A, 5).select(_RECOVERY_COLUMNS)


# ---- summaries ---------------------------------------------------------------------


@query(
    """SELECT CAST(count(*) AS BIGINT) AS total_incidents, round(sum(vehicle_value), 2) AS total_value_stolen,
         round(avg(vehicle_value), 4) AS average_vehicle_value, CAST(min(vehicle_year) AS INT) AS oldest_year,
         CAST(max(vehicle_year) AS INT) AS newest_year, round(avg(owner_income), 4) AS income_mean,
         min(owner_income) AS income_min, max(owner_income) AS income_max,
         (SELECT vehicle_make FROM theft GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_stolen_make,
         (SELECT vehicle_type FROM theft GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_stolen_type,
         round(median(owner_income), 4) AS income_median FROM theft""",
    ("theft",),
)
def theft_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = stats.theft_summary(load(spark, sf, "theft"))
    return _round(summary, {"total_value_stolen": 2, "average_vehicle_value": 4, "income_mean": 4, "income_median": 4})


@query(
    """SELECT recovery_status, CAST(count(*) AS BIGINT) AS n FROM theft WHERE recovery_status IS NOT NULL GROUP BY 1""",
    ("theft",),
)
def recovery_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.counts(load(spark, sf, "theft"), "recovery_status")


@query(
    """SELECT CAST(count(*) AS BIGINT) AS total_suspects, CAST(count(DISTINCT suspect_name) AS BIGINT) AS unique_suspects,
         round(avg(suspect_age), 4) AS average_age, min(suspect_age) AS min_age, max(suspect_age) AS max_age,
         min(last_arrest_date) AS earliest_arrest, max(last_arrest_date) AS latest_arrest,
         CAST(count(*) FILTER (WHERE last_arrest_date >= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY) AS BIGINT)
           AS recent_arrests,
         round(avg(bail_amount), 4) AS bail_average, max(bail_amount) AS bail_max,
         CAST(count(*) FILTER (WHERE bail_amount = 0) AS BIGINT) AS held_without_bail,
         (SELECT arrest_charges FROM suspect GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_charge,
         round(median(bail_amount), 4) AS bail_median FROM suspect""",
    ("suspect",),
)
def suspect_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = stats.suspect_summary(load(spark, sf, "suspect"), as_of=SUSPECTS_AS_OF)
    return _round(summary, {"average_age": 4, "bail_average": 4, "bail_median": 4})


def _counts_sql(view: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, {c} AS value, CAST(count(*) AS BIGINT) AS n FROM {view} WHERE {c} IS NOT NULL GROUP BY 2"
        for c in columns
    )


@query(_counts_sql("suspect", ["suspect_gender", "risk_level", "conviction_status"]), ("suspect",))
def suspect_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.suspect_value_counts(load(spark, sf, "suspect"))


@query(
    """SELECT CAST(count(*) AS BIGINT) AS total_recoveries, CAST(count(incident_id) AS BIGINT) AS with_theft_link,
         CAST(count(suspect_id) AS BIGINT) AS with_suspect_link,
         CAST(count(*) FILTER (WHERE is_criminal_location) AS BIGINT) AS criminal_locations,
         CAST(count(DISTINCT recovery_agency) AS BIGINT) AS recovery_agencies FROM recovery""",
    ("recovery",),
)
def recovery_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.recovery_summary(load(spark, sf, "recovery"))


@query(_counts_sql("recovery", ["vehicle_condition", "recovery_method", "case_status"]), ("recovery",))
def recovery_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.recovery_value_counts(load(spark, sf, "recovery"))


@query(
    """SELECT criminal_location_type, CAST(count(*) AS BIGINT) AS n FROM recovery
       WHERE criminal_location_type IS NOT NULL GROUP BY 1""",
    ("recovery",),
)
def location_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.counts(load(spark, sf, "recovery"), "criminal_location_type")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS total_records, CAST(count({c}) AS BIGINT) AS non_null_count,
              CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM recovery"""
        for c in ["incident_id", "recovery_agency", "criminal_location_type"]
    ),
    ("recovery",),
)
def table_stats(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["incident_id", "recovery_agency", "no_such_column", "criminal_location_type"]
    return stats.table_stats(load(spark, sf, "recovery"), columns)


def _presence_sql(columns: list[str]) -> str:
    return ", ".join(
        f"CAST(count({c}) AS BIGINT) AS {c}_non_null, CAST(count(DISTINCT {c}) AS BIGINT) AS {c}_unique" for c in columns
    )


@query(
    f"""SELECT CAST(count(*) AS BIGINT) AS total_records,
          {_presence_sql(['vehicle_make', 'vehicle_type', 'recovery_status'])},
          round(avg(vehicle_value), 4) AS avg_vehicle_value, round(sum(vehicle_value), 2) AS total_value_stolen,
          min(incident_date) AS earliest_incident, max(incident_date) AS latest_incident FROM theft""",
    ("theft",),
)
def theft_table_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _round(stats.theft_table_stats(load(spark, sf, "theft")), {"avg_vehicle_value": 4, "total_value_stolen": 2})


@query(
    """SELECT CAST(count(*) AS BIGINT) AS total_suspects, CAST(count(DISTINCT suspect_name) AS BIGINT) AS unique_suspects,
         round(avg(suspect_age), 4) AS avg_age, min(suspect_age) AS min_age, max(suspect_age) AS max_age,
         CAST(count(DISTINCT risk_level) AS BIGINT) AS risk_levels_count,
         CAST(count(DISTINCT arrest_charges) AS BIGINT) AS unique_charges,
         CAST(count(DISTINCT conviction_status) AS BIGINT) AS conviction_statuses,
         min(last_arrest_date) AS earliest_arrest, max(last_arrest_date) AS latest_arrest,
         round(avg(bail_amount), 4) AS avg_bail_amount,
         CAST(sum(CASE WHEN bail_amount = 0 THEN 1 ELSE 0 END) AS BIGINT) AS held_without_bail FROM suspect""",
    ("suspect",),
)
def suspect_table_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _round(stats.suspect_table_stats(load(spark, sf, "suspect")), {"avg_age": 4, "avg_bail_amount": 4})


@query(
    f"""SELECT CAST(count(*) AS BIGINT) AS total_records,
          {_presence_sql(['recovery_agency', 'vehicle_condition', 'case_status'])},
          CAST(count(incident_id) AS BIGINT) AS recoveries_with_theft_link,
          CAST(count(suspect_id) AS BIGINT) AS recoveries_with_suspect_link,
          CAST(count(*) FILTER (WHERE is_criminal_location) AS BIGINT) AS criminal_location_recoveries,
          min(recovery_date) AS earliest_recovery, max(recovery_date) AS latest_recovery FROM recovery""",
    ("recovery",),
)
def recovery_table_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.recovery_table_stats(load(spark, sf, "recovery"))


@query(
    """SELECT min(incident_lon) AS minx, min(incident_lat) AS miny, max(incident_lon) AS maxx, max(incident_lat) AS maxy
       FROM theft""",
    ("theft",),
)
def bounds(spark: SparkSession, sf: str) -> DataFrame:
    return stats.bounds(load(spark, sf, "theft"), "incident_lon", "incident_lat")


@query(
    """SELECT round((min(address_lat) + max(address_lat)) / 2, 9) AS centre_lat,
         round((min(address_lon) + max(address_lon)) / 2, 9) AS centre_lon FROM suspect""",
    ("suspect",),
)
def map_centre(spark: SparkSession, sf: str) -> DataFrame:
    centre = stats.map_centre(load(spark, sf, "suspect"), "address_lon", "address_lat")
    return _round(centre, {"centre_lat": 9, "centre_lon": 9})


@query(
    """SELECT round(max(address_lat) - min(address_lat), 9) AS lat_range, round(max(address_lon) - min(address_lon), 9) AS lon_range,
         round((max(address_lat) - min(address_lat)) * 111e0, 6) AS lat_range_km,
         round((max(address_lon) - min(address_lon)) * 111e0, 6) AS lon_range_km FROM suspect""",
    ("suspect",),
)
def geo_spread(spark: SparkSession, sf: str) -> DataFrame:
    spread = stats.geo_spread(load(spark, sf, "suspect"), "address_lon", "address_lat")
    return _round(spread, {"lat_range": 9, "lon_range": 9, "lat_range_km": 6, "lon_range_km": 6})


@query(
    "SELECT round(avg(suspect_age), 4) AS mean, min(suspect_age) AS min, max(suspect_age) AS max FROM suspect", ("suspect",)
)
def age_describe(spark: SparkSession, sf: str) -> DataFrame:
    return _round(stats.describe(load(spark, sf, "suspect"), "suspect_age"), {"mean": 4})


@query(
    """SELECT risk_level, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100e0 / (SELECT count(*) FROM suspect), 6) AS pct
       FROM suspect GROUP BY 1""",
    ("suspect",),
)
def risk_pct(spark: SparkSession, sf: str) -> DataFrame:
    return _round(stats.percent_distribution(load(spark, sf, "suspect"), "risk_level"), {"pct": 6})


@query(
    """SELECT arrest_charges, CAST(count(*) AS BIGINT) AS n FROM suspect GROUP BY 1 ORDER BY n DESC, arrest_charges LIMIT 5""",
    ("suspect",),
)
def top_charges(spark: SparkSession, sf: str) -> DataFrame:
    return stats.top_values(load(spark, sf, "suspect"), "arrest_charges", 5)


# ---- storage and export ------------------------------------------------------------


@query(
    """SELECT suspect_id, suspect_age, last_arrest_date, round(address_lon, 9) AS x, round(address_lat, 9) AS y,
         CAST(NULL AS VARCHAR) AS gang_affiliation FROM suspect""",
    ("suspect",),
)
def save_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    table = f"{checkpoint_dir(spark)}/precinct-tables/{uuid.uuid4().hex}"
    store.save(load(spark, sf, "suspect"), SUSPECT, table)
    back = store.load(spark, table, "address_geometry_wkt")
    return back.select(
        "suspect_id", "suspect_age", "last_arrest_date", F.round("geometry.x", 9).alias("x"),
        F.round("geometry.y", 9).alias("y"), "gang_affiliation",
    )


@query(
    """SELECT recovery_id, vehicle_condition, suspect_id, round(recovery_lon, 9) AS x, round(recovery_lat, 9) AS y FROM recovery""",
    ("recovery",),
)
def geojson_export(spark: SparkSession, sf: str) -> DataFrame:
    shown = ["recovery_id", "vehicle_condition", "suspect_id"]
    lines = geojson.feature_lines(load(spark, sf, "recovery"), "recovery_lon", "recovery_lat", shown)
    schema = """type string, geometry struct<type:string,coordinates:array<double>>,
                properties struct<recovery_id:string,vehicle_condition:string,suspect_id:string>"""
    parsed = lines.select(F.from_json("value", schema).alias("f"))
    at = F.col("f.geometry.coordinates")
    return parsed.select("f.properties.*", F.round(at[0], 9).alias("x"), F.round(at[1], 9).alias("y"))


def _new_table(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/precinct-tables/{uuid.uuid4().hex}"


def _csv_folder(spark: SparkSession, sf: str, view: str, key: str) -> str:
    """A raw view as CSV files, those of odd keys with their columns the other way round."""
    folder = _new_table(spark)
    raw = load(spark, sf, view)
    odd = F.substring(key, 4, 20).cast("int") % 2 == 1
    csv.export_csv(raw.where(~odd), f"{folder}/even")
    csv.export_csv(raw.where(odd).select(*reversed(raw.columns)), f"{folder}/odd")
    return f"{folder}/*"


def _imported(spark: SparkSession, sf: str, entity: Entity) -> DataFrame:
    return csv.import_csv(spark, _csv_folder(spark, sf, f"{entity.name}_raw", entity.key), entity)


@query(
    f"""SELECT incident_id, CAST(vehicle_year AS INT) AS vehicle_year, round(CAST(vehicle_value AS DOUBLE), 4) AS vehicle_value,
          vehicle_model, TRY_CAST(incident_date AS TIMESTAMP) AS incident_date,
          CAST(incident_lon AS DOUBLE) AS x, CAST(incident_lat AS DOUBLE) AS y
        FROM theft_raw WHERE ({_THEFT_REASON}) IS NULL""",
    ("theft_raw",),
)
def import_theft_csv(spark: SparkSession, sf: str) -> DataFrame:
    rows = _round(_imported(spark, sf, THEFT), {"vehicle_value": 4})
    return rows.select("incident_id", "vehicle_year", "vehicle_value", "vehicle_model", "incident_date", "geometry.x", "geometry.y")


@query(
    f"""SELECT suspect_id, suspect_name, CAST(TRY_CAST(suspect_age AS INT) AS DOUBLE) AS suspect_age,
          TRY_CAST(bail_amount AS DOUBLE) AS bail_amount, TRY_CAST(last_arrest_date AS TIMESTAMP) AS last_arrest_date,
          CAST(address_lon AS DOUBLE) AS x, CAST(address_lat AS DOUBLE) AS y, CAST(arrest_lon AS DOUBLE) AS arrest_lon
        FROM suspect_raw WHERE NOT ({_text_missing(SUSPECT)})
          AND NOT ({_beyond('address_lat', 'address_lon')} OR {_beyond('arrest_lat', 'arrest_lon')})""",
    ("suspect_raw",),
)
def import_suspect_csv(spark: SparkSession, sf: str) -> DataFrame:
    rows = _imported(spark, sf, SUSPECT).withColumn("suspect_age", F.col("suspect_age").cast("double"))
    return rows.select(
        "suspect_id", "suspect_name", "suspect_age", "bail_amount", "last_arrest_date", "geometry.x", "geometry.y", "arrest_lon"
    )


@query(
    f"""SELECT recovery_id, TRY_CAST(recovery_date AS TIMESTAMP) AS recovery_date, recovery_location_name, vehicle_condition,
          CASE WHEN lower(is_criminal_location) IN ('true', '1', 'yes', 'y') THEN 'true'
            WHEN lower(is_criminal_location) IN ('false', '0', 'no', 'n') THEN 'false' END AS is_criminal_location,
          CAST(recovery_lon AS DOUBLE) AS x, CAST(recovery_lat AS DOUBLE) AS y
        FROM recovery_raw WHERE NOT ({_text_missing(RECOVERY)}) AND NOT ({_beyond('recovery_lat', 'recovery_lon')})""",
    ("recovery_raw",),
)
def import_recovery_csv(spark: SparkSession, sf: str) -> DataFrame:
    rows = _imported(spark, sf, RECOVERY).withColumn("is_criminal_location", F.col("is_criminal_location").cast("string"))
    return rows.select(
        "recovery_id", "recovery_date", "recovery_location_name", "vehicle_condition", "is_criminal_location", "geometry.x", "geometry.y"
    )


@query(
    f"""SELECT incident_id, {_THEFT_REASON} AS reject_reason, vehicle_value, incident_lat FROM theft_raw
        WHERE ({_THEFT_REASON}) IS NOT NULL""",
    ("theft_raw",),
)
def rejected_csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected rows with their texts as read; the tests check their file and row number."""
    rows = csv.rejected(spark, _csv_folder(spark, sf, "theft_raw", THEFT.key), THEFT)
    cells = {c: F.get_json_object("cells", f"$.{c}").alias(c) for c in ("incident_id", "vehicle_value", "incident_lat")}
    return rows.select(cells["incident_id"], "reject_reason", cells["vehicle_value"], cells["incident_lat"])


@query(
    """SELECT recovery_id, kind, round(lon + dx, 9) AS x, round(lat + dy, 9) AS y FROM (
         SELECT recovery_id, recovery_lon AS lon, recovery_lat AS lat,
           CASE k % 6 WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINESTRING' WHEN 2 THEN 'POLYGON' WHEN 3 THEN 'MULTIPOINT'
             WHEN 4 THEN 'MULTILINESTRING' ELSE 'MULTIPOLYGON' END AS kind,
           CASE k % 6 WHEN 0 THEN 0e0 WHEN 1 THEN (0.03e0 * 0.015e0 + 0.01e0 * 0.03e0) / 0.04e0 WHEN 2 THEN (0.0016e0 * 0.02e0 - 0.0001e0 * 0.015e0) / 0.0015e0
             WHEN 3 THEN 0.02e0 WHEN 4 THEN (0.03e0 * 0.015e0 + 0.01e0 * 0.05e0) / 0.04e0
             ELSE (0.0004e0 * 0.01e0 + 0.0001e0 * 0.105e0) / 0.0005e0 END AS dx,
           CASE k % 6 WHEN 0 THEN 0e0 WHEN 1 THEN 0.01e0 * 0.005e0 / 0.04e0 WHEN 2 THEN (0.0016e0 * 0.02e0 - 0.0001e0 * 0.025e0) / 0.0015e0
             WHEN 3 THEN 0.01e0 WHEN 4 THEN 0.01e0 * 0.01e0 / 0.04e0
             ELSE (0.0004e0 * 0.01e0 + 0.0001e0 * 0.005e0) / 0.0005e0 END AS dy
         FROM (SELECT *, CAST(substr(recovery_id, 4) AS INT) AS k FROM recovery))""",
    ("recovery",),
)
def wkt_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Each recovery place as a geometry of one of six kinds, read from its text and brought to its centre."""
    steps = {
        "POINT": "({0} {0})",
        "LINESTRING": "({0} {0}, {30} {0}, {30} {10})",
        "POLYGON": "(({0} {0}, {40} {0}, {40} {40}, {0} {40}, {0} {0}), ({10} {20}, {20} {20}, {20} {30}, {10} {30}, {10} {20}))",
        "MULTIPOINT": "(({0} {0}), ({20} {0}), ({40} {30}))",
        "MULTILINESTRING": "(({0} {0}, {30} {0}), ({50} {5}, {50} {15}))",
        "MULTIPOLYGON": "((({0} {0}, {20} {0}, {20} {20}, {0} {20}, {0} {0})), (({100} {0}, {110} {0}, {110} {10}, {100} {10}, {100} {0})))",
    }
    key = F.substring("recovery_id", 4, 20).cast("int") % len(steps)
    text = F.lit(None).cast("string")
    for k, (kind, body) in enumerate(steps.items()):
        text = F.when(key == k, _placed(f"{kind} {body}")).otherwise(text)
    rows = load(spark, sf, "recovery").withColumn("shape", shapes.from_wkt(text)).withColumn("c", shapes.centre("shape"))
    return rows.select("recovery_id", "shape.kind", F.round("c.x", 9).alias("x"), F.round("c.y", 9).alias("y"))


def _placed(body: str) -> Column:
    """WKT in which each pair of numbers in braces is a step, in thousandths of a degree, from the recovery place."""
    parts = re.split(r"\{(\d+)\}", body)
    places = ("recovery_lon", "recovery_lat")
    numbers = [(F.col(places[i % 2]) + int(n) / 1000).cast("string") for i, n in enumerate(parts[1::2])]
    texts = [F.lit(t) for t in parts[::2]]
    return F.concat(texts[0], *[c for pair in zip(numbers, texts[1:], strict=True) for c in pair])


@query(
    f"""SELECT incident_id, incident_lat, incident_lon, vehicle_value, round(incident_lon, 9) AS x, round(incident_lat, 9) AS y
        FROM theft WHERE {_box('incident_lat', 'incident_lon', CENTRE_A, 5)}""",
    ("theft",),
)
def near_theft_stored(spark: SparkSession, sf: str) -> DataFrame:
    table = _new_table(spark)
    store.save(load(spark, sf, "theft"), THEFT, table)
    kept = store.query_by_distance(spark, table, CENTRE_A, 5, "incident_lat", "incident_lon", "geometry_wkt")
    place = [F.round(f"geometry.{c}", 9).alias(c) for c in ("x", "y")]
    return kept.select("incident_id", "incident_lat", "incident_lon", "vehicle_value", *place)


@query(
    f"""SELECT suspect_id, address_lat, address_lon, risk_level FROM suspect
        WHERE {_box('address_lat', 'address_lon', CENTRE_B, 5)}""",
    ("suspect",),
)
def near_suspect_stored(spark: SparkSession, sf: str) -> DataFrame:
    table = _new_table(spark)
    store.save(load(spark, sf, "suspect"), SUSPECT, table)
    kept = store.query_by_distance(spark, table, CENTRE_B, 5, "address_lat", "address_lon", "address_geometry_wkt")
    return kept.select("suspect_id", "address_lat", "address_lon", "risk_level")


@query(
    """SELECT incident_id AS place_id, CAST(round(vehicle_value) AS BIGINT) AS worth, incident_lat AS lat,
         CASE WHEN vehicle_year % 2 = 1 THEN vehicle_make END AS kind, CASE WHEN vehicle_year % 2 = 1 THEN 'seen' END AS note
       FROM theft""",
    ("theft",),
)
def insert_into_any_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two inserts into a table of a schema of its own: columns in another order, missing and surplus ones."""
    table = _new_table(spark)
    store.create_table(
        spark, table, T.StructType.fromDDL("place_id string, kind string, worth bigint, lat double, lon double, note string")
    )
    thefts = load(spark, sf, "theft").select(
        F.col("incident_lon").alias("lon"), F.col("vehicle_make").alias("kind"), F.col("vehicle_year").alias("surplus"),
        F.round("vehicle_value").alias("worth"), F.col("incident_lat").alias("lat"), F.col("incident_id").alias("place_id"),
    )
    odd = thefts.where("surplus % 2 = 1").withColumn("note", F.lit("seen"))
    store.insert(odd, table, key="place_id", place=("lat", "lon"))
    store.insert(thefts.where("surplus % 2 = 0").drop("kind"), table, key="place_id", clear_existing=False)
    return store.read(spark, table).select("place_id", "worth", "lat", "kind", "note")
