"""Summaries as one-row frames and value counts as (dimension, value, n) rows.

Plain measures share one hash aggregate. Medians and modes, whose aggregate state grows
with the data, come in as scalar subqueries over scalable forms (`quantiles`).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.functions.geo import DEFAULT_CENTRE, KM_PER_DEGREE
from precinct.operators.quantiles import median, most_frequent


def _has(df: DataFrame, column: str, measure: Column, empty=None) -> Column:
    return measure if column in df.columns else F.lit(empty)


def _modes(df: DataFrame, names: dict[str, str]) -> list[Column]:
    """Commonest values of the given columns (column: result name), null when absent."""
    present = [c for c in names if c in df.columns]
    row = most_frequent(df, present).select(F.struct(*present).alias("modes")).scalar() if present else None
    return [
        (row[c] if c in present else F.lit(None).cast("string")).alias(alias) for c, alias in names.items()
    ]


def theft_summary(df: DataFrame) -> DataFrame:
    totals = df.agg(
        F.count("*").alias("total_incidents"),
        F.sum("vehicle_value").alias("total_value_stolen"),
        F.avg("vehicle_value").alias("average_vehicle_value"),
        F.min("vehicle_year").alias("oldest_year"),
        F.max("vehicle_year").alias("newest_year"),
        F.avg("owner_income").alias("income_mean"),
        F.min("owner_income").alias("income_min"),
        F.max("owner_income").alias("income_max"),
    )
    return totals.select(
        "*",
        *_modes(df, {"vehicle_make": "most_stolen_make", "vehicle_type": "most_stolen_type"}),
        median(df, "owner_income").scalar().alias("income_median"),
    )


def counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) without nulls; no rows when the column is absent."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], f"{column} string, n bigint")
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of several columns in one pass, as (dimension, value, n)."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "dimension string, value string, n bigint")
    text = df.select([F.col(c).cast("string").alias(c) for c in present])
    return (
        text.unpivot([], present, "dimension", "value")
        .where(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.count("*").alias("n"))
    )


def suspect_summary(df: DataFrame, as_of: dt.datetime | None = None, recent_days: int = 180) -> DataFrame:
    since = (as_of or dt.datetime.now()) - dt.timedelta(days=recent_days)
    recent = F.col("last_arrest_date") >= F.lit(since).cast("timestamp_ntz")
    totals = df.agg(
        F.count("*").alias("total_suspects"),
        _has(df, "suspect_name", F.count_distinct("suspect_name")).alias("unique_suspects")
        if "suspect_name" in df.columns
        else F.count("*").alias("unique_suspects"),
        _has(df, "suspect_age", F.avg("suspect_age")).alias("average_age"),
        _has(df, "suspect_age", F.min("suspect_age")).alias("min_age"),
        _has(df, "suspect_age", F.max("suspect_age")).alias("max_age"),
        _has(df, "last_arrest_date", F.min("last_arrest_date")).alias("earliest_arrest"),
        _has(df, "last_arrest_date", F.max("last_arrest_date")).alias("latest_arrest"),
        _has(df, "last_arrest_date", F.count_if(recent)).alias("recent_arrests"),
        _has(df, "bail_amount", F.avg("bail_amount")).alias("bail_average"),
        _has(df, "bail_amount", F.max("bail_amount")).alias("bail_max"),
        _has(df, "bail_amount", F.count_if(F.col("bail_amount") == 0)).alias("held_without_bail"),
    )
    bail_median = median(df, "bail_amount").scalar() if "bail_amount" in df.columns else F.lit(None)
    return totals.select(
        "*", *_modes(df, {"arrest_charges": "most_common_charge"}), bail_median.alias("bail_median")
    )


def suspect_value_counts(df: DataFrame) -> DataFrame:
    return value_counts(df, ["suspect_gender", "risk_level", "conviction_status"])


def recovery_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_recoveries"),
        _has(df, "incident_id", F.count("incident_id"), 0).alias("with_theft_link"),
        _has(df, "suspect_id", F.count("suspect_id"), 0).alias("with_suspect_link"),
        _has(df, "is_criminal_location", F.count_if("is_criminal_location"), 0).alias("criminal_locations"),
        _has(df, "recovery_agency", F.count_distinct("recovery_agency"), 0).alias("recovery_agencies"),
    )


def recovery_value_counts(df: DataFrame) -> DataFrame:
    return value_counts(df, ["vehicle_condition", "recovery_method", "case_status"])


def table_stats(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(column_name, total_records, non_null_count, unique_count) per asked column.

    Unknown columns are skipped. With no known column, or on an empty table, one row
    holds the record count alone. `approximate` swaps exact distinct counts, which
    shuffle every distinct value, for sketches.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    known = [c for c in columns if c in df.columns]
    measures = [F.count("*").alias("total")]
    for c in known:
        measures += [F.count(c).alias(f"present_{c}"), distinct(c).alias(f"distinct_{c}")]
    wide = df.agg(*measures)
    per_column = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"present_{c}").alias("non_null_count"),
            F.col(f"distinct_{c}").alias("unique_count"),
        )
        for c in known
    ]
    if not per_column:
        return wide.select(
            F.lit(None).cast("string").alias("column_name"),
            F.col("total").alias("total_records"),
            F.lit(None).cast("bigint").alias("non_null_count"),
            F.lit(None).cast("bigint").alias("unique_count"),
        )
    rows = F.when(F.col("total") > 0, F.array(*per_column))
    return wide.select(F.col("total").alias("total_records"), F.explode_outer(rows).alias("s")).select(
        "s.column_name", "total_records", "s.non_null_count", "s.unique_count"
    )


def theft_table_stats(df: DataFrame) -> DataFrame:
    columns = ["vehicle_make", "vehicle_type", "recovery_status"]
    per_column = [m for c in columns for m in _presence(c)]
    return df.agg(
        F.count("*").alias("total_records"),
        *per_column,
        F.avg("vehicle_value").alias("avg_vehicle_value"),
        F.sum("vehicle_value").alias("total_value_stolen"),
        F.min("incident_date").alias("earliest_incident"),
        F.max("incident_date").alias("latest_incident"),
    )


def _presence(c: str) -> list[Column]:
    return [F.count(c).alias(f"{c}_non_null"), F.count_distinct(c).alias(f"{c}_unique")]


def suspect_table_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_suspects"),
        F.count_distinct("suspect_name").alias("unique_suspects"),
        F.avg("suspect_age").alias("avg_age"),
        F.min("suspect_age").alias("min_age"),
        F.max("suspect_age").alias("max_age"),
        F.count_distinct("risk_level").alias("risk_levels_count"),
        F.count_distinct("arrest_charges").alias("unique_charges"),
        F.count_distinct("conviction_status").alias("conviction_statuses"),
        F.min("last_arrest_date").alias("earliest_arrest"),
        F.max("last_arrest_date").alias("latest_arrest"),
        F.avg("bail_amount").alias("avg_bail_amount"),
        F.count_if(F.col("bail_amount") == 0).alias("held_without_bail"),
    )


def recovery_table_stats(df: DataFrame) -> DataFrame:
    columns = ["recovery_agency", "vehicle_condition", "case_status"]
    per_column = [m for c in columns for m in _presence(c)]
    return df.agg(
        F.count("*").alias("total_records"),
        *per_column,
        F.count("incident_id").alias("recoveries_with_theft_link"),
        F.count("suspect_id").alias("recoveries_with_suspect_link"),
        F.count_if("is_criminal_location").alias("criminal_location_recoveries"),
        F.min("recovery_date").alias("earliest_recovery"),
        F.max("recovery_date").alias("latest_recovery"),
    )


def bounds(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """One row (minx, miny, maxx, maxy); all null when there are no points."""
    return df.agg(
        F.min(lon).alias("minx"),
        F.min(lat).alias("miny"),
        F.max(lon).alias("maxx"),
        F.max(lat).alias("maxy"),
    )


def bounds_tuple(df: DataFrame, lon: str, lat: str) -> tuple[float, float, float, float]:
    row = bounds(df, lon, lat).first()
    if row["minx"] is None:
        raise ValueError("no points to take bounds of")
    return tuple(row)


def map_centre(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Middle of the bounds, or the default centre without data."""
    lat0, lon0 = DEFAULT_CENTRE
    return bounds(df, lon, lat).select(
        F.coalesce((F.col("miny") + F.col("maxy")) / 2, F.lit(lat0)).alias("centre_lat"),
        F.coalesce((F.col("minx") + F.col("maxx")) / 2, F.lit(lon0)).alias("centre_lon"),
    )


def geo_spread(df: DataFrame, lon: str, lat: str) -> DataFrame:
    tall, wide = F.col("maxy") - F.col("miny"), F.col("maxx") - F.col("minx")
    return bounds(df, lon, lat).select(
        tall.alias("lat_range"),
        wide.alias("lon_range"),
        (tall * KM_PER_DEGREE).alias("lat_range_km"),
        (wide * KM_PER_DEGREE).alias("lon_range_km"),
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max")
    )


def percent_distribution(df: DataFrame, column: str) -> DataFrame:
    """Count per value and its share of all rows; the total is a scalar subquery."""
    total = df.agg(F.count("*").alias("total")).scalar()
    return counts(df, column).withColumn("pct", F.col("n") / total * 100)


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The `n` commonest values (a report); ties go to the smaller value."""
    return counts(df, column).orderBy(F.col("n").desc(), F.col(column)).limit(n)


def top_threshold(df: DataFrame, score: str, rank: int = 5) -> DataFrame:
    """Rows scoring at least the value at descending index min(rank, rows − 1), ties kept."""
    best = df.select(score).where(F.col(score).isNotNull()).orderBy(F.col(score).desc()).limit(rank + 1)
    return df.where(F.col(score) >= best.agg(F.min(score).alias("threshold")).scalar())
