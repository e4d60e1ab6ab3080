"""Text to typed value, bad text to null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from precinct.functions.geo import col
from precinct.schemas import FALSE_TEXTS, NULL_TOKENS, TRUE_TEXTS

# Java also reads "1d", "1f" and hex floats as numbers; this pattern finds them.
_JAVA_ONLY = r"[dDxX]|[0-9.][fF]"
_SLASHES = r"^\s*\d{1,2}/\d{1,2}/\d{4}"


def blank_to_null(c: Column | str) -> Column:
    return F.when(~col(c).isin(NULL_TOKENS), col(c))


def number(c: Column | str) -> Column:
    """A double; text that is not a number, and NaN, give null."""
    text = col(c).cast("string")
    return F.when(~text.rlike(_JAVA_ONLY), F.nullif(text.try_cast("double"), F.lit(float("nan"))))


def whole(c: Column | str) -> Column:
    """Nearest int of a number text (a bare cast would truncate)."""
    return F.rint(number(c)).try_cast("int")


def timestamp(c: Column | str) -> Column:
    """A naive timestamp from ISO text or month/day/year text, else null."""
    text = F.trim(col(c).cast("string"))
    iso = text.try_cast("timestamp_ntz")
    slash = F.when(
        text.rlike(_SLASHES),
        F.coalesce(
            F.try_to_timestamp(text, F.lit("M/d/yyyy H:m:s")),
            F.try_to_timestamp(text, F.lit("M/d/yyyy H:m")),
            F.try_to_timestamp(text, F.lit("M/d/yyyy")),
        ),
    ).cast("timestamp_ntz")
    return F.coalesce(iso, slash)


def flag(c: Column | str) -> Column:
    """true/1/yes/y and false/0/no/n in any case, anything else null."""
    text = F.lower(col(c).cast("string"))
    return F.when(text.isin(TRUE_TEXTS), True).when(text.isin(FALSE_TEXTS), False)
