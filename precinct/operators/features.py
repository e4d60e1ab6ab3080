"""Feature columns for the models: parts, imputation, label codes, standard scaling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.functions.labels import date_column, temporal_parts
from precinct.operators.quantiles import median
from precinct.runtime import cut, ranked, small

UNKNOWN = "Unknown"


@dataclass
class Encoders:
    """Label codes per column: rows (feature, value, code), and how many there are."""

    table: DataFrame | None = None
    columns: set[str] = field(default_factory=set)
    rows: int = 0

    def fit(self, df: DataFrame, columns: list[str]) -> "Encoders":
        """Learn the columns not known yet, all in one pass; known ones are kept."""
        fresh = [c for c in columns if c not in self.columns]
        if not fresh:
            return self
        text = df.select([F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in fresh])
        values = text.unpivot([], fresh, "feature", "value").distinct()
        learned = ranked(values, ["value"], "code", within="feature")
        table = learned if self.table is None else self.table.unionByName(learned)
        return Encoders(table, self.columns | set(fresh), table.count())

    def apply(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """Add the code of `column`; a value not seen at fitting fails the job."""
        codes = self.table.where(F.col("feature") == column).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        text = F.coalesce(F.col(column).cast("string"), F.lit(UNKNOWN))
        joined = df.withColumn("_text", text).join(
            small(codes, self.rows), F.col("_text") == F.col("_value"), "left"
        )
        unseen = F.raise_error(F.concat(F.lit(f"value of {column} not seen at fitting: "), F.col("_text")))
        code = F.when(F.col("_code").isNull(), unseen).otherwise(F.col("_code"))
        return joined.withColumn(name, code.cast("double")).drop("_text", "_value", "_code")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code) with codes 0, 1, … in value order; missing counts as `Unknown`."""
    return Encoders().fit(df, [column]).table.select("value", "code")


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature."""

    names: list[str]
    means: list[float]
    deviations: list[float]

    @staticmethod
    def fit(df: DataFrame, names: list[str]) -> "Scaler":
        measures = [f(n).alias(f"{p}_{n}") for n in names for f, p in ((F.avg, "m"), (F.stddev_pop, "s"))]
        row = df.agg(*measures).first()
        return Scaler(
            names, [row[f"m_{n}"] or 0.0 for n in names], [row[f"s_{n}"] or 0.0 for n in names]
        )

    def scaled(self, name: str) -> Column:
        i = self.names.index(name)
        spread = self.deviations[i]
        # a constant column scales to 0
        return (F.col(name) - F.lit(self.means[i])) / F.lit(spread if spread > 0 else 1.0)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: self.scaled(n) for n in self.names})


@dataclass(frozen=True)
class Features:
    """A row id plus numeric feature columns in model order."""

    frame: DataFrame
    row_id: str
    names: list[str]
    encoders: Encoders

    def standardised(self) -> tuple["Features", Scaler]:
        scaler = Scaler.fit(self.frame, self.names)
        return Features(scaler.apply(self.frame), self.row_id, self.names, self.encoders), scaler


def temporal_features(df: DataFrame, row_id: str, xy: tuple[str, str], dates: list[str] | None = None) -> DataFrame:
    """x, y and the parts of the first present date column."""
    date = date_column(df.columns, dates) if dates else date_column(df.columns)
    parts = temporal_parts(date) if date else {}
    return df.select(
        row_id, F.col(xy[0]).alias("x"), F.col(xy[1]).alias("y"), *[c.alias(n) for n, c in parts.items()]
    )


def filled_parts(df: DataFrame, date: str) -> dict[str, Column]:
    """The parts of a date column as doubles; a missing date takes the median of each part.

    Unreadable dates are null after cleaning, and training keeps their rows.
    """
    parts = {n: c.cast("double") for n, c in temporal_parts(date).items()}
    if not df.where(F.col(date).isNull()).isEmpty():
        known = cut(df.select(*[c.alias(n) for n, c in parts.items()]))
        parts = {n: F.coalesce(c, median(known, n).scalar(), F.lit(0.0)) for n, c in parts.items()}
    return parts


def _features(
    df: DataFrame,
    row_id: str,
    xy: tuple[str, str],
    dates: list[str] | None,
    numbers: list[tuple[str, str, float | None]],
    categories: list[tuple[str, str]],
    order: list[str],
    encoders: Encoders | None,
) -> Features:
    """Assemble the features that exist. A number's fill of None means its median."""
    date = date_column(df.columns, dates) if dates else date_column(df.columns)
    columns: dict[str, Column] = {"x": F.col(xy[0]), "y": F.col(xy[1])}
    if date:
        columns |= filled_parts(df, date)
    numbers = [n for n in numbers if n[1] in df.columns]
    categories = [c for c in categories if c[1] in df.columns]

    fill_by_median = [source for _, source, fill in numbers if fill is None]
    gaps = {}
    if fill_by_median:
        # medians cost passes over the data, so they are taken only where a value is missing
        gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in fill_by_median]).first().asDict()
    for name, source, fill in numbers:
        value = F.col(source).cast("double")
        if fill is not None:
            value = F.coalesce(value, F.lit(float(fill)))
        elif gaps[source]:
            value = F.coalesce(value, median(df, source).scalar())
        columns[name] = value

    encoders = (encoders or Encoders()).fit(df, [source for _, source in categories])
    coded = df
    for name, source in categories:
        coded = encoders.apply(coded, source, f"_code_{name}")
        columns[name] = F.col(f"_code_{name}")
    names = [n for n in order if n in columns]
    frame = coded.select(row_id, *[columns[n].alias(n) for n in names])
    return Features(frame, row_id, names, encoders)


THEFT_ORDER = [
    "x", "y", "hour", "dow", "month", "quarter", "value", "year", "make", "type", "method", "income",
]


def theft_features(
    df: DataFrame,
    row_id: str = "incident_id",
    xy: tuple[str, str] = ("incident_lon", "incident_lat"),
    names: list[str] | None = None,
    encoders: Encoders | None = None,
) -> Features:
    """Theft features in model order; `names` picks some of them, e.g. without income."""
    wanted = names or THEFT_ORDER
    numbers = [("value", "vehicle_value", None), ("year", "vehicle_year", None), ("income", "owner_income", None)]
    categories = [("make", "vehicle_make"), ("type", "vehicle_type"), ("method", "theft_method")]
    return _features(
        df, row_id, xy, None,
        [n for n in numbers if n[0] in wanted], [c for c in categories if c[0] in wanted],
        [n for n in THEFT_ORDER if n in wanted], encoders,
    )


SUSPECT_ORDER = [
    "x", "y", "hour", "dow", "month", "quarter", "age", "previous_arrests", "occupation",
    "criminal_associations",
]
# Feature → column of the suspect table; map a feature to another name as needed.
SUSPECT_COLUMNS = {
    "date": "arrest_date",
    "age": "age",
    "previous_arrests": "previous_arrests",
    "occupation": "occupation",
    "criminal_associations": "criminal_associations",
}


def suspect_features(
    df: DataFrame,
    row_id: str = "suspect_id",
    xy: tuple[str, str] = ("address_lon", "address_lat"),
    columns: dict[str, str] | None = None,
    names: list[str] | None = None,
    encoders: Encoders | None = None,
) -> Features:
    """Suspect features in model order; `columns` overrides where a feature is read from."""
    wanted = names or SUSPECT_ORDER
    at = SUSPECT_COLUMNS | (columns or {})
    numbers = [("age", at["age"], None), ("previous_arrests", at["previous_arrests"], 0.0)]
    categories = [(n, at[n]) for n in ("occupation", "criminal_associations")]
    return _features(
        df, row_id, xy, ["incident_date", at["date"], "recovery_date"],
        [n for n in numbers if n[0] in wanted], [c for c in categories if c[0] in wanted],
        [n for n in SUSPECT_ORDER if n in wanted], encoders,
    )
