"""Bring a table to a required set of columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.runtime import numbered

NULLS = "nulls"
COMPAT = "compat"

# Name parts deciding the default of an absent column, first match wins.
FALSE_PARTS = ["notified", "collected", "criminal_location", "evidence"]
NOW_PARTS = ["date", "time"]
ID_PARTS = ["id"]
ZERO_PARTS = ["year", "age", "value", "amount"]
ZERO_POINT_PARTS = ["lat", "lon", "latitude", "longitude"]


def default_kind(column: str) -> str:
    """Which default the `compat` policy gives an absent column of this name."""
    name = column.lower()

    def holds(parts: list[str]) -> bool:
        return any(part in name for part in parts)

    if holds(FALSE_PARTS) or name.startswith("is_"):
        return "false"
    for parts, kind in ((NOW_PARTS, "now"), (ID_PARTS, "id"), (ZERO_PARTS, "zero"), (ZERO_POINT_PARTS, "zero_point")):
        if holds(parts):
            return kind
    return "null"


def conform(
    df: DataFrame,
    required: dict[str, str],
    policy: str = NULLS,
    as_of: dt.datetime | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """Required columns first, then the others. `required` maps names to Spark types.

    Absent columns become null. The `compat` policy instead fills them by their name,
    with ID_000001, … for id-like ones, numbered by `order_by` or by partition.
    """
    absent = [c for c in required if c not in df.columns]
    others = [c for c in df.columns if c not in required]
    if policy == NULLS:
        filled = {c: F.lit(None).cast(required[c]) for c in absent}
        return df.select([filled.get(c, F.col(c)).alias(c) for c in required] + others)
    if policy != COMPAT:
        raise ValueError(f"unknown policy {policy!r}")

    kinds = {c: default_kind(c) for c in absent}
    if "id" in kinds.values():
        df = numbered(df, order_by, "_row")
    now = F.lit(as_of or dt.datetime.now()).cast("timestamp_ntz")
    values: dict[str, Column] = {
        "false": F.lit(False),
        "now": now,
        "zero": F.lit(0),
        "zero_point": F.lit(0.0),
        "null": F.lit(None).cast("string"),
    }
    if "id" in kinds.values():
        digits = (F.col("_row") + 1).cast("string")
        width = F.greatest(F.lit(6), F.length(digits))
        values["id"] = F.concat(F.lit("ID_"), F.lpad(digits, width, F.lit("0")))
    return df.select(
        [values[kinds[c]].alias(c) if c in kinds else F.col(c) for c in required] + others
    )
