"""Exact quantiles that never gather the column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

# Rank error of a sketch is at most rows / ACCURACY.
ACCURACY = 10_000

# Distinct values that may be ordered in one task.
FEW_VALUES = 100_000

_MAX_PASSES = 30


def quantile(df: DataFrame, column: str, q: float, accuracy: int = ACCURACY, few_values: int = FEW_VALUES) -> DataFrame:
    """One row, one column: the linearly interpolated `q` quantile of the non-null values.

    A mergeable sketch brackets the answer. Rows below and in the bracket are counted: a bracket
    that misses the wanted ranks is widened, one with more than `few_values` distinct values is
    narrowed by a sketch of its own. Only the last bracket's distinct values are ordered in one
    place, so that step does not grow with the data. Use it as `quantile(...).scalar()`.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    slack = 2.0 / accuracy

    def sketch(rows: DataFrame, at: float) -> Row:
        ends = [max(0.0, at - slack), min(1.0, at + slack)]
        figures = F.percentile_approx("v", ends, accuracy).alias("ends"), F.min("v").alias("least"), F.max("v").alias("most")
        return rows.agg(F.count("*").alias("n"), *figures).first()

    whole = sketch(values, q)
    n = whole["n"]
    if not n:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("quantile"))
    place = (n - 1) * q
    low, high, below = whole["least"], whole["most"], 0
    if n >= 2 * accuracy:
        outer, (low, high) = (low, high), whole["ends"]
        for _ in range(_MAX_PASSES):
            v = F.col("v")
            own = v.between(low, high)
            seen = values.agg(
                F.count_if(v < low).alias("below"), F.count_if(own).alias("own"),
                F.approx_count_distinct(F.when(own, v)).alias("distinct"),
            ).first()
            below = seen["below"]
            if below > math.floor(place):
                low = outer[0]
            elif below + seen["own"] <= math.ceil(place):
                high = outer[1]
            elif seen["distinct"] <= few_values:
                break
            else:
                inner = sketch(values.where(own), (place - below) / max(1, seen["own"] - 1))["ends"]
                outer, (low, high) = (low, high), inner
        else:
            raise RuntimeError("the quantile's bracket did not settle")

    grouped = values.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n"))
    upto = grouped.select("v", (F.sum("n").over(Window.orderBy("v")) + below).alias("upto"))
    picked = upto.agg(
        F.min(F.when(F.col("upto") > math.floor(place), F.col("v"))).alias("lower"),
        F.min(F.when(F.col("upto") > math.ceil(place), F.col("v"))).alias("upper"),
    )
    # a quantile on the last value has no row above it
    step = F.coalesce("upper", "lower") - F.col("lower")
    return picked.select((F.col("lower") + (place - math.floor(place)) * step).alias("quantile"))


def median(df: DataFrame, column: str) -> DataFrame:
    return quantile(df, column, 0.5)


def most_frequent(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the commonest value of each column as text, in one pass over `df`.

    Ties go to the smallest value; a column without values gives null.
    """
    text = df.select([F.col(c).cast("string").alias(c) for c in columns])
    counted = (
        text.unpivot([], columns, "dimension", "value")
        .where(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.count("*").alias("n"))
    )
    return counted.agg(
        *[
            F.min_by(
                "value", F.when(F.col("dimension") == c, F.struct((-F.col("n")).alias("n"), "value"))
            ).alias(c)
            for c in columns
        ]
    )
