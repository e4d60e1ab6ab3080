"""Typed projection of raw text rows with one reject reason per row.

Every rule is a column, so cleaning and counting are a single narrow pass: no rule
copies the table and no count needs a second scan (see `cleaned`'s observation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from precinct.functions import geo, parse
from precinct.schemas import Entity

REASON = "reject_reason"
MISSING = "missing_required"
BAD_COORDINATES = "invalid_coordinates"

_PARSERS = {
    "double": parse.number,
    "int": parse.whole,
    "timestamp": parse.timestamp,
    "boolean": parse.flag,
}


def reasons(entity: Entity, validate_coordinates: bool = True) -> list[str]:
    names = [MISSING]
    if validate_coordinates:
        names.append(BAD_COORDINATES)
    return names + [f"invalid_{c}" for c in entity.strict_numbers]


def classify(raw: DataFrame, entity: Entity, validate_coordinates: bool = True) -> DataFrame:
    """Typed columns plus `reject_reason`, null for a good row.

    Rules are checked in order and a row is charged to the first it fails. A
    required cell must hold text; coordinates must also be numbers.
    """

    def typed(c: str) -> Column:
        kind = entity.columns.get(c, "string")
        if kind == "boolean" and c not in entity.flags:
            return F.col(c).try_cast("boolean")
        return _PARSERS[kind](c) if kind in _PARSERS else F.col(c)

    columns = raw.columns
    coordinates = {c for pair in entity.points for c in pair}
    text = raw.select([parse.blank_to_null(F.col(c).cast("string")).alias(c) for c in columns])
    # The numbers the rules look at go through a generator: its output is computed once per
    # row, where a plain projection would be copied into the filter on the reason as well.
    ruling = [c for c in columns if c in coordinates or c in entity.strict_numbers]
    checked = text.select(
        [F.col(c) for c in columns if c not in ruling]
        + [F.col(c).isNull().alias(f"_no_{c}") for c in entity.strict_numbers if c in columns]
        + ([F.inline(F.array(F.struct([typed(c).alias(c) for c in ruling])))] if ruling else [])
    )
    absent = {c: f"_no_{c}" if c in entity.strict_numbers else c for c in entity.required}

    missing = F.lit(False)
    for c in entity.required:
        if c in columns:
            missing = missing | (F.col(absent[c]) if absent[c] != c else F.col(c).isNull())
    reason = F.when(missing, MISSING)
    if validate_coordinates:
        beyond = F.lit(False)
        for lat, lon in entity.points:
            if lat in columns and lon in columns:
                beyond = beyond | geo.out_of_range(lat, lon)
        reason = reason.when(beyond, BAD_COORDINATES)
    for c in entity.strict_numbers:
        if c in columns:
            reason = reason.when(F.col(c).isNull(), f"invalid_{c}")
    values = [F.col(c) if c in ruling else typed(c).alias(c) for c in columns]
    return checked.select(*values, reason.alias(REASON))


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where(F.col(REASON).isNull()).drop(REASON)


def cleaned(
    raw: DataFrame,
    entity: Entity,
    validate_coordinates: bool = True,
    observation: Observation | None = None,
) -> DataFrame:
    """Good rows only. `observation` receives the counts when the result is first run."""
    rows = classify(raw, entity, validate_coordinates)
    if observation is not None:
        counts = [
            F.count_if(F.col(REASON) == name).alias(name)
            for name in reasons(entity, validate_coordinates)
        ]
        rows = rows.observe(observation, F.count("*").alias("rows_read"), *counts)
    return accepted(rows)


def reject_counts(classified: DataFrame) -> DataFrame:
    """Rows per reject reason; good rows are counted under `accepted`."""
    return (
        classified.groupBy(F.coalesce(F.col(REASON), F.lit("accepted")).alias(REASON))
        .agg(F.count("*").alias("n"))
    )


def require_columns(available: list[str], entity: Entity) -> None:
    absent = sorted(set(entity.required) - set(available))
    if absent:
        raise ValueError(f"Missing required columns: {absent}")


def require_rows(classified: DataFrame) -> None:
    """At least one row must survive the required-column rule."""
    survivors = classified.where(F.coalesce(F.col(REASON), F.lit("")) != MISSING)
    if survivors.isEmpty():
        raise ValueError("No valid data rows after cleaning")
