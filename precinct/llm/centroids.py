"""Lloyd's clustering of integer vectors, sharded by dimension.

Vectors are cut into blocks of columns and stored once, each block bucketed by chunks of vectors. A
task reads one block: it knows only that block's slice of the centroids and adds up exact partial
distances. Partial distances of a chunk meet by its key, are summed, and the nearest centroid is
taken. The labels, a few bytes a vector, are joined back to the stored blocks without moving
these, and each block's sums make the next slice of its centroids. Nothing but the slices, which
are as many numbers as centroids have components, passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.vectors import integers, usable
from precinct.runtime import BRIEF_SHUFFLES, CO_LOCATED, bucketed, cut, scratch, send_to_workers, settings

BLOCKS = 4

# Vectors of one stored row: small rows keep the readers' batches small.
CHUNK = 128

# Stored bytes of one bucket of one block.
BUCKET_BYTES = 64 << 20

# Vectors whose distances a step works on at a time.
STEP = 1 << 16

send_to_workers(__name__)


def lloyd(
    rows: DataFrame,
    k: int = 8,
    rounds: int = 10,
    size: int = 64,
    scale: int = 1024,
    seed: int = 3,
    blocks: int = BLOCKS,
    chunk: int = CHUNK,
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector, and the final centroids.

    Kept are vectors of `size` components without nulls, NaN or infinities, each component turned
    into floor(scale * x); a component of 2^27 or more after that leaves the vector out, as its
    squared distances would not fit 64 bits. The centroids start as the k vectors with the
    smallest sha256 of `<seed>:<vec_id>` (an empty id if null; equal ids by their components). Rows
    are vectors of their own, whether or not ids or vectors repeat. Of fewer than k vectors all
    are centroids; without any the result is empty. Other columns are ignored.
    """
    spark = rows.sparkSession
    with scratch(spark), settings(spark, CO_LOCATED | BRIEF_SHUFFLES):
        vectors = rows.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")).where(
            usable("embedding", scale, size)
        )
        centroids = _starts(vectors, k, scale, seed)
        if not centroids.size:
            return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), []
        edges = [size * b // blocks for b in range(blocks + 1)]
        slices = list(zip(edges, edges[1:], strict=False))
        packed = cut(vectors.mapInArrow(_packer(slices, scale, chunk), "chunk bigint, block int, parts binary, ids array<bigint>"))
        held = packed.agg(F.sum(F.length("parts"))).first()[0]
        buckets = max(2, -(-held // (blocks * BUCKET_BYTES)))
        stored = bucketed(packed.repartition(buckets, "chunk"), buckets, "chunk", ["chunk"], ["block"])
        shards = [stored.where(F.col("block") == b) for b in range(blocks)]
        for _ in range(rounds):
            with scratch(spark):
                labels = cut(_nearest(shards, slices, centroids))
                centroids = _moved(shards, slices, centroids, labels)
        members = _nearest(shards, slices, centroids, with_ids=True)
        return cut(members, keep=True), [[int(x) for x in c] for c in centroids]


def _starts(vectors: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    """The first centroids: k rows at most reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    ints = F.transform("embedding", lambda x: F.floor(x * scale))
    first = vectors.select(key.alias("key"), ints.alias("ints")).orderBy("key", "ints").limit(k).collect()
    return np.array([r.ints for r in first], np.int64)


def _packer(slices: list[tuple[int, int]], scale: int, chunk: int) -> Callable:
    """Chunks of vectors, a row for each block of columns; the first block's row has the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = integers(batch.column(1), slices[-1][1], scale)
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for at in range(0, len(ints), chunk):
                for b, (low, high) in enumerate(slices):
                    part = ints[at : at + chunk, low:high].astype("<i4").tobytes()
                    out.append((number, b, part, ids[at : at + chunk] if b == 0 else None))
                number += 1
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["chunk", "block", "parts", "ids"]
            )

    return run


def _distances(part: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of one block to the slices of the centroids, exactly."""
    largest = max(np.abs(part).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if 4 * int(largest) ** 2 * max(1, part.shape[1]) < 1 << 53 else np.int64
    a, c = part.astype(kind), centroids.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)


def _partial(centroids: np.ndarray, with_ids: bool) -> Callable:
    """(chunk, sums) of one block: partial distances of a chunk's vectors, packed."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP // CHUNK):
                batch = whole.slice(at, STEP // CHUNK)
                raw = batch.column(1).to_pylist()
                counts = [len(r) // (4 * width) for r in raw]
                sums = _distances(np.frombuffer(b"".join(raw), "<i4").reshape(-1, width), centroids)
                # half the bytes where they suffice; the reader sees it by the length
                kind = "<i4" if sums.max(initial=0) < 1 << 31 else "<i8"
                bytes_ = memoryview(sums.astype(kind).tobytes())
                ends = np.cumsum(counts) * k * np.dtype(kind).itemsize
                packed = [bytes_[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                columns = [batch.column(0), pa.array(packed, pa.binary()), pa.array(counts, pa.int32())]
                names = ["chunk", "sums", "n"]
                if with_ids:
                    columns, names = [*columns, batch.column(2)], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _nearest(shards: list[DataFrame], slices: list, centroids: np.ndarray, with_ids: bool = False) -> DataFrame:
    """The nearest centroid of each vector, the smaller number on ties.

    A row per chunk with its labels packed, or with ids a row per vector with its distance.
    """
    parts = []
    for b, (shard, (low, high)) in enumerate(zip(shards, slices, strict=True)):
        mine = with_ids and b == 0
        run = _partial(centroids[:, low:high], mine)
        schema = "chunk bigint, sums binary, n int" + (", ids array<bigint>" if mine else "")
        part = shard.select("chunk", "parts", *(["ids"] if mine else [])).mapInArrow(run, schema)
        parts.append(part if mine or not with_ids else part.withColumn("ids", F.lit(None).cast("array<bigint>")))
    both = reduce(DataFrame.unionByName, parts).groupBy("chunk")
    taken = [F.collect_list("sums").alias("sums"), F.first("n").alias("n")]
    if with_ids:
        taken.append(F.first("ids", ignorenulls=True).alias("ids"))
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, least = [], []
            for sums, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total = np.zeros(n * k, np.int64)
                for part in sums:
                    total += np.frombuffer(part, "<i4" if len(part) == 4 * n * k else "<i8")
                total = total.reshape(n, k)
                labels.append(total.argmin(1))
                least.append(total[np.arange(n), labels[-1]])
            if not labels:
                continue
            if with_ids:
                flat = [np.concatenate(labels).astype(np.int32), np.concatenate(least)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(3).flatten(), *map(pa.array, flat)], ["vec_id", "cluster", "distance"]
                )
            else:
                packed = pa.array([x.astype("<i4").tobytes() for x in labels], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["chunk", "labels"])

    schema = "vec_id bigint, cluster int, distance bigint" if with_ids else "chunk bigint, labels binary"
    return both.agg(*taken).mapInArrow(run, schema)


def _moved(shards: list[DataFrame], slices: list, centroids: np.ndarray, labels: DataFrame) -> np.ndarray:
    """The centroids after one round: each block sums its own columns over its chunks' labels."""
    k = len(centroids)

    def summer(low: int, high: int) -> Callable:
        width = high - low

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
            for batch in batches:
                raw, marks = b"".join(batch.column(0).to_pylist()), b"".join(batch.column(1).to_pylist())
                part, label = np.frombuffer(raw, "<i4").reshape(-1, width), np.frombuffer(marks, "<i4")
                counts += np.bincount(label, minlength=k)
                order = np.argsort(label, kind="stable")
                present, first = np.unique(label[order], return_index=True)
                if len(present):
                    sums[present] += np.add.reduceat(part[order].astype(np.int64), first, axis=0)
            found = np.flatnonzero(counts)
            cells = len(found) * width
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(found, width).astype(np.int32)),
                    pa.array(np.tile(np.arange(low, high), len(found)).astype(np.int32)),
                    pa.array(sums[found].reshape(cells)),
                    pa.array(np.repeat(counts[found], width)),
                ],
                ["cluster", "place", "total", "n"],
            )

        return run

    parts = [
        shard.select("chunk", "parts").join(labels, "chunk").select("parts", "labels").mapInArrow(
            summer(*edges), "cluster int, place int, total bigint, n bigint"
        )
        for shard, edges in zip(shards, slices, strict=True)
    ]
    sums = reduce(DataFrame.unionByName, parts).groupBy("cluster", "place")
    moved = centroids.copy()
    # k times size numbers; a cluster without vectors has no row and keeps its centroid
    for r in sums.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[r.cluster, r.place] = r.total // r.n
    return moved
