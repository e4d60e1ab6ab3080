"""A key for every row, whatever its own ids say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.runtime import cut, spread

ROW = "row_key"

# Copies of one row that a task numbers at a time.
COPIES = 100_000


def identified(df: DataFrame) -> DataFrame:
    """Rows plus `row_key`, one for each row, written once.

    The key is the row's content and a number among its copies, so it does not depend on how the
    table is split or ordered. Copies are counted before they are numbered, so that a row repeated
    very often is never sorted, and its numbers are dealt to many tasks.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    counted = cut(df.groupBy(*columns).agg(F.count("*").alias("_copies")))
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, F.lit(COPIES).cast("bigint")))
    numbered = counted.select("*", first.alias("_first"))
    most = counted.agg(F.max("_copies")).first()[0] or 0
    if most > COPIES:
        numbered = spread(numbered)
    last = F.least(F.col("_first") + COPIES, "_copies") - 1
    numbered = numbered.withColumn("_copy", F.explode(F.sequence("_first", last)))
    content = F.sha2(F.to_json(F.struct(*columns)), 256)
    return cut(numbered.select(*columns, F.concat(content, F.lit("-"), F.col("_copy")).alias(ROW)))
