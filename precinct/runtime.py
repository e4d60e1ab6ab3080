"""Session helpers shared by the operators: scratch tables, size checks, hot keys."""

from __future__ import annotations

import sys
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"

# A table with at most this many narrow rows may be broadcast (a few MB).
BROADCAST_ROWS = 200_000

# A table whose values were counted to weigh this much may be broadcast.
BROADCAST_BYTES = 32 << 20

# Distinct keys that one task may sort.
FEW_KEYS = 1_000_000

# A key with more rows than this is handled as hot in `attach`.
HOT_ROWS = 1_000_000


def found(spark: SparkSession, path: str) -> list[str]:
    """The files and folders that a path (globs allowed) names, on any Hadoop file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return [status.getPath().toString() for status in there or []]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder (globs allowed) is there."""
    return bool(found(spark, path))


def send_to_workers(module: str) -> None:
    """Send the Python functions of `module` along with the tasks.

    Executors then need no installed copy of this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, as the cluster names it.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost together with an executor.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder before running on a cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="precinct-"))
    return spark.sparkContext.getCheckpointDir()


# What the open `scratch` blocks delete when they end: (path, catalog name or nothing).
_scopes: list[list[tuple[str, str | None]]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written by `cut` and `bucketed` inside the block are deleted when it ends.

    What outlives the block is written with `keep=True`; an outer block, if any, then deletes it.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path, name in _scopes.pop():
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that this module has written."""
    _system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def replace_folder(spark: SparkSession, folder: str, fresh: str) -> None:
    """Make `fresh` the content of `folder`; what was there stays if that fails."""
    system, old = _system(spark, folder), f"{folder}-before-{uuid.uuid4().hex}"
    place, before = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (folder, old))
    had = system.exists(place)
    if had and not system.rename(place, before):
        raise OSError(f"cannot move {folder}")
    if not system.rename(spark._jvm.org.apache.hadoop.fs.Path(fresh), place):
        if had:
            system.rename(before, place)
        raise OSError(f"cannot move {fresh} to {folder}")
    if had:
        system.delete(before, True)


def move_files(spark: SparkSession, source: str, folder: str) -> None:
    """Move the data files of a written table into another folder, under names of their own."""
    system, mark = _system(spark, folder), uuid.uuid4().hex[:8]
    for path in found(spark, f"{source}/part-*"):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not system.rename(place, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{mark}-{place.getName()}")):
            raise OSError(f"cannot move {path}")


def _system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _new_path(spark: SparkSession, keep: bool, name: str | None = None) -> str:
    path = f"{checkpoint_dir(spark)}/precinct-tables/{uuid.uuid4().hex}"
    scope = _scopes[:-1] if keep else _scopes
    if scope:
        scope[-1].append((path, name))
    return path


# Settings that blocks hold: how many blocks, and the value before the first.
_held_settings: dict[str, list] = {}
_settings_lock = threading.Lock()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block, also if threads open such blocks side by side."""
    with _settings_lock:
        for key, value in values.items():
            holders = _held_settings.setdefault(key, [0, spark.conf.get(key, None)])
            holders[0] += 1
            spark.conf.set(key, value)
    try:
        yield
    finally:
        with _settings_lock:
            for key in values:
                holders = _held_settings[key]
                holders[0] -= 1
                if not holders[0]:
                    before = _held_settings.pop(key)[1]
                    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# What a query run for a written table shuffled is read by nothing else and deleted at its end.
BRIEF_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

# Tables bucketed by the first join key meet without a shuffle, and without a sort if a bucket is one file.
CO_LOCATED = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    One pass, survives lost executors, and the reader knows the table's size, so
    Catalyst picks broadcast or shuffle joins from real numbers.
    """
    spark = df.sparkSession
    path = _new_path(spark, keep)
    with settings(spark, BRIEF_SHUFFLES):
        df.write.parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def bucketed(df: DataFrame, buckets: int, by: str, sort: list[str], folders: list[str] | None = None) -> DataFrame:
    """Write `df` as a table of `buckets` sorted buckets by a column, for joins on it without a shuffle.

    Call it inside a `scratch` block, which drops the table and its files. Rows should already lie
    in `buckets` partitions by that column, so that each task writes one file per value of `folders`.
    """
    spark = df.sparkSession
    name = f"precinct_{uuid.uuid4().hex}"
    path = _new_path(spark, False, name)
    with settings(spark, BRIEF_SHUFFLES):
        writer = df.write.partitionBy(*folders) if folders else df.write
        writer.bucketBy(buckets, by).sortBy(*sort).option("path", path).saveAsTable(name)
    return spark.table(name)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark `df` for broadcast when its counted size allows it, else leave it alone."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def light(df: DataFrame, weight: int) -> DataFrame:
    """Mark `df` for broadcast when the counted bytes of its rows allow it, for rows of any width."""
    return F.broadcast(df) if weight <= BROADCAST_BYTES else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even out rows that are few but costly to work on.

    An explicit partition number keeps adaptive execution from merging them into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def attach(
    rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of `rows` with a table that has one row per key and its row count.

    Keys above `hot_rows` (at most rows / hot_rows of them) are broadcast, so the
    rows of a hot key never meet in one task; all other keys use a plain join.
    """
    hot = keyed.where(F.col(weight) > hot_rows).drop(weight)
    n_hot = hot.count()
    if n_hot == 0:
        return rows.join(keyed.drop(weight), on)
    if n_hot > BROADCAST_ROWS:
        return attach(rows, keyed, on, weight, hot_rows * 10)
    cold = keyed.where(F.col(weight) <= hot_rows).drop(weight)
    hot_keys = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(
        rows.join(hot_keys, on, "left_anti").join(cold, on)
    )


def ranked(df: DataFrame, by: list[str], name: str, within: str | None = None) -> DataFrame:
    """Number the rows of a table of distinct keys 0, 1, … by `by` (apart per `within`).

    A short table is numbered by a window, a long one by range partitions.
    """
    df = cut(df)
    if df.count() <= FEW_KEYS:
        window = Window.partitionBy(within) if within else Window
        return df.withColumn(name, F.row_number().over(window.orderBy(*by)).cast("bigint") - 1)
    if not within:
        return numbered(df, by, name)
    rows = numbered(df, [within, *by], name)
    firsts = rows.groupBy(within).agg(F.min(name).alias("_first"))
    return rows.join(F.broadcast(firsts), within).withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def numbered(df: DataFrame, order_by: list[str] | None = None, name: str = "seq") -> DataFrame:
    """Add 0, 1, 2, … in the order of `order_by` (or in partition order) at scale.

    Two passes instead of one global window: number the rows inside each range
    partition, then shift each partition by the rows before it.
    """
    if order_by:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by)
    # monotonically_increasing_id keeps the partition in the upper bits and the
    # row's position in the lower 33.
    kept = cut(df.withColumn("_mono", F.monotonically_increasing_id()))
    kept = kept.withColumn("_part", F.shiftright("_mono", 33)).withColumn(
        "_pos", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    )
    # One row per partition, so one task may sum up the rows before each of them.
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        kept.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_mono", "_part", "_pos", "_offset")
    )
