"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window of a text
that gets clearly shorter with the toxic dictionary than with the ordinary one speaks for
toxicity; a document's evidence is the sum of what its windows save beyond a margin, and the
evidence from which on a document counts as toxic is calibrated on labelled rows of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precinct import runtime
from precinct.llm.text import crc, free_names, in_worker, lowered, steps
from precinct.runtime import cut, send_to_workers, small

# Bytes of the fragments that training weighs, and how many of them mark toxic samples.
SIZES = (5, 8)
FRAGMENTS = 256
MIN_ROWS = 4
MIN_LOG_ODDS = 1.5

# Fragments that a task counts in ordinary rows at once.
FIRST = 32_768

# Bits for each id in the bitmaps that tell which rows may have a label, and bits of one bitmap (Spark's size).
BITS_PER_ID = 8
MAP_BITS = 1 << 15

TOXIC_BYTES = 4 << 10
ORDINARY_BYTES = 32 << 10

# The largest number of saved bytes that a window may be asked for, and of such windows.
MOST_BYTES = 8
MOST_WINDOWS = 200

# A window is a word; a longer word is cut into overlapping windows.
WORD_BYTES = 48

# Every window is framed: both dictionaries end with HEAD, so zstandard's fixed costs are paid
# alike, and it searches no matches in the last bytes of a block, which TAIL fills.
HEAD, TAIL = bytes(range(128, 160)), bytes(range(160, 168))

# Remainders of crc32(doc_id) mod 5: 0 is never learnt from, 4 calibrates, the others train.
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4

# Words that a task remembers, in two generations.
MEMORY_WORDS = 150_000

# Words whose fragments or telling parts a task remembers while it counts.
COUNTED_WORDS = 20_000

# Fragments or words that a task counts before it hands them on.
COUNTED = 200_000

send_to_workers(__name__)


class Model(NamedTuple):
    """Dictionary contents (bounded by TOXIC_BYTES and ORDINARY_BYTES) and the two thresholds."""

    toxic: bytes
    ordinary: bytes
    saved: int
    windows: int


class Distance:
    """What each window saves with the toxic dictionary against the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        settings = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, window_log=18, hash_log=17, chain_log=17, search_log=6,
            write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        self.toxic, self.ordinary = (
            zstandard.ZstdCompressor(
                compression_params=settings,
                dict_data=zstandard.ZstdCompressionDict(content + HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            ).compress
            for content in (toxic, ordinary)
        )
        self.memory: dict[bytes, tuple] = {}
        self.older: dict[bytes, tuple] = {}

    def _saved(self, word: bytes) -> tuple[int, ...]:
        if len(word) > WORD_BYTES:
            step = WORD_BYTES // 2
            return tuple(x for i in range(0, len(word) - step, step) for x in self._saved(word[i : i + WORD_BYTES]))
        window = HEAD + b" " + word + b" " + TAIL
        saved = len(self.ordinary(window)) - len(self.toxic(window))
        return (min(saved, MOST_BYTES),) if saved > 0 else ()

    def evidence(self, text: str | None) -> list[int]:
        """How many windows of a whole text save 1 byte or more, 2 or more, ... up to MOST_BYTES."""
        if len(self.memory) > MEMORY_WORDS:
            self.memory, self.older = {}, self.memory
        memory, found = self.memory, [0] * (MOST_BYTES + 1)
        words = lowered(text).split()
        long = {}
        for word in set(words).difference(memory):
            saved = self.older.get(word)
            if saved is None:
                saved = self._saved(word)
            (memory if len(word) <= WORD_BYTES else long)[word] = saved
        told = list(filter(None, map(memory.get, words)))
        if long:
            told += [long[word] for word in words if word in long]
        for saved in told:
            for x in saved:
                found[x] += 1
        return np.cumsum(found[:0:-1])[::-1].tolist()


def with_evidence(docs: DataFrame, model: Model, name: str = "_found") -> DataFrame:
    """All rows and columns plus column `name`, the evidence of `text`: counts, all zero for null and empty texts."""
    toxic, ordinary = model.toxic, model.ordinary
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = in_worker(("toxicity", toxic, ordinary), lambda: Distance(toxic, ordinary))
        for batch in steps(batches):
            found = [distance.evidence(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names)

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))]))


def score(model: Model, found: Column) -> Column:
    """0 to 1, from 0.5 on for a document with as many telling windows as the threshold asks for."""
    return 1 / (1 + F.exp(F.least(F.lit(30.0), model.windows - 0.5 - F.element_at(found, model.saved))))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries and threshold from labelled rows (doc_id, toxic 0 or 1).

    Only rows outside the held-out fold are learnt from, and of them only text and label. The thresholds
    are calibrated with dictionaries of the training rows alone; those that are kept are of all rows.
    Without toxic or without ordinary rows there is no evidence, and every text scores below 0.5.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    fold = crc("doc_id") % FOLDS
    known = known.agg(F.max("toxic").cast("int").alias("toxic")).where(fold != HELD_OUT)
    known = cut(known.withColumn("part", (fold == CALIBRATION).cast("int")))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _labelled(docs, known)
    trained, whole = _contents(rows)
    model = Model(*trained, 1, 1)
    if not model.toxic:
        return model._replace(windows=1 << 30)
    check = rows.where("part = 1").select("toxic", "text")
    saved, windows = _thresholds(with_evidence(check, model).select("toxic", F.col("_found").alias("found")))
    return Model(*whole, saved, windows)


def _labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """All labelled rows: their text and the columns of `known` but doc_id."""
    n = known.count()
    if n > runtime.BROADCAST_ROWS:
        docs = _perhaps(docs, known, n)
    return cut(docs.join(small(known, n), "doc_id").drop("doc_id"))


def _perhaps(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """The rows of `docs` whose doc_id has its bit in bitmaps of the known ids' hashes: all labelled ones and some others.

    So few texts but those that are learnt from are shuffled to meet a long table of labels.
    """
    maps = -(-min(n * BITS_PER_ID, runtime.BROADCAST_BYTES * 8) // MAP_BITS)
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(maps * MAP_BITS))
    map_no, bit = F.floor(slot / MAP_BITS), slot % MAP_BITS
    bits = known.groupBy(map_no.alias("_map")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return docs.join(F.broadcast(bits), map_no == F.col("_map")).where(there).drop("_map", "_bits")


class _Remembered(dict):
    """What a function gives for a word, for a bounded number of words."""

    def __init__(self, work: Callable[[bytes], object], most: int = COUNTED_WORDS):
        self.work, self.most = work, most

    def __missing__(self, word: bytes) -> object:
        if len(self) >= self.most:
            self.clear()
        made = self.work(word)
        if len(word) <= WORD_BYTES:
            self[word] = made
        return made


def _fragments(word: bytes) -> set[bytes]:
    x = b" " + word + b" "
    return {x[i : i + size] for size in SIZES for i in range(len(x) - size + 1)}


def _contents(rows: DataFrame) -> tuple[tuple[bytes, bytes], tuple[bytes, bytes]]:
    """Train both dictionaries, once on the rows of part 0 and once on all rows.

    Fragments of a few bytes are weighed by the documents of each label that have them. The
    toxic content is made of the parts of toxic documents' words that the strongest fragments
    cover, the ordinary one of ordinary documents' frequent words without such fragments; the
    most frequent stand last, where matches cost least. Each pass over the texts serves both trainings.
    """
    n = np.zeros((2, 2), int)
    for r in rows.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect():
        n[r.part :, r.toxic] += r.n
    if not n[1].all():
        return (b"", b""), (b"", b"")
    tops = _strongest(rows, n)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of ordinary rows every word by part, of toxic ones the covered parts of words by training
        words, parts = (Counter(), Counter()), (Counter(), Counter())
        covered = _Remembered(lambda word: [_covered(b" " + word + b" ", top) for top in tops])

        def counted() -> pa.RecordBatch:
            plain = (Counter(), Counter())
            for word in words[0].keys() | words[1].keys():
                numbers = words[0][word], words[0][word] + words[1][word]
                for k, top in enumerate(tops):
                    if numbers[k] and not _covered(b" " + word + b" ", top):
                        plain[k][b" " + word + b" "] = numbers[k]
            return _batch((*plain, *parts), ("b0", "b1", "a0", "a1"))

        for batch in steps(batches):
            for toxic, part, text in zip(*(batch.column(c).to_pylist() for c in ("toxic", "part", "text")), strict=True):
                distinct = set(lowered(text).split())
                if toxic:
                    for found in map(covered.__getitem__, distinct):
                        for k in range(part, 2):
                            parts[k].update(found[k])
                else:
                    words[part].update(w for w in distinct if len(w) <= WORD_BYTES)
            if sum(map(len, words)) > COUNTED:
                yield counted()
                words, parts = (Counter(), Counter()), (Counter(), Counter())
        yield counted()

    counted = rows.mapInArrow(sample, "item binary, b0 bigint, b1 bigint, a0 bigint, a1 bigint").groupBy("item")
    items = cut(counted.agg(*(F.sum(c).alias(c) for c in ("b0", "b1", "a0", "a1"))))
    out = []
    for k in range(2):
        pair = [b"", b""]
        for i, (column, limit) in enumerate((("a", TOXIC_BYTES), ("b", ORDINARY_BYTES))):
            if n[k].all():
                for r in items.where(F.col(f"{column}{k}") > 0).orderBy(F.desc(f"{column}{k}"), "item").limit(limit // min(SIZES)).collect():
                    if len(pair[i]) + len(r.item) <= limit:
                        pair[i] = bytes(r.item) + pair[i]
        out.append((pair[0], pair[1]))
    return out[0], out[1]


def _strongest(rows: DataFrame, n: np.ndarray) -> list[set[bytes]]:
    """For each training the FRAGMENTS fragments with the largest product of toxic rows and log odds.

    Toxic rows come first, they are few. A fragment's toxic rows bound its product, so it suffices
    to count in the ordinary rows the FIRST ones by toxic rows and those whose bound reaches the weakest of
    the strongest so far: a fragment in fewer toxic rows than needed is never counted there.
    """
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        fragments = _Remembered(_fragments)
        for batch in steps(batches):
            for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts[part].update(set().union(*map(fragments.__getitem__, set(lowered(text).split()))))
            if len(counts[0]) + len(counts[1]) > COUNTED:
                yield _batch(counts, ("n0", "n1"))
                counts = (Counter(), Counter())
        yield _batch(counts, ("n0", "n1"))

    schema = "item binary, n0 bigint, n1 bigint"

    def summed(counts: DataFrame, name: str) -> DataFrame:
        return counts.groupBy("item").agg(F.sum("n0").alias(f"{name}0"), F.sum(F.col("n0") + F.col("n1")).alias(f"{name}1"))

    def product(k: int, b: Column) -> tuple[Column, Column]:
        odds = F.log((F.col(f"a{k}") + 0.5) / (n[k, 1].item() + 1)) - F.log((b + 0.5) / (n[k, 0].item() + 1))
        return F.col(f"a{k}") * odds, (F.col(f"a{k}") >= MIN_ROWS) & (odds > MIN_LOG_ODDS)

    ordinary = rows.where("toxic = 0").select("part", "text")
    toxic = summed(rows.where("toxic = 1").select("part", "text").mapInArrow(weigh, schema), "a")
    toxic = cut(toxic.where(F.col("a1") >= MIN_ROWS))
    first = {bytes(r.item) for k in range(2) for r in toxic.orderBy(F.desc(f"a{k}"), "item").limit(FIRST).collect()}
    counted = _in_ordinary(ordinary, sorted(first))
    grams = toxic.join(F.broadcast(counted), "item")

    def best(k: int) -> list:
        weight, strong = product(k, F.col(f"b{k}"))
        return grams.where(strong).select("item", weight.alias("weight")).orderBy(F.desc("weight"), "item").limit(FRAGMENTS).collect()

    tops = [best(k) for k in range(2)]
    may = F.lit(False)
    for k, top in enumerate(tops):
        weight, strong = product(k, F.lit(0))
        # the margin keeps a fragment that only rounding would rule out
        may = may | (strong & (weight >= (top[-1].weight * (1 - 1e-9) if len(top) == FRAGMENTS else 0.0)))
    rest = cut(toxic.join(F.broadcast(counted.select("item")), "item", "left_anti").where(may))
    n_rest = rest.count()
    if n_rest:
        if n_rest <= FIRST:
            counted = _in_ordinary(ordinary, sorted(bytes(r.item) for r in rest.select("item").collect()))
        else:
            counted = summed(ordinary.mapInArrow(weigh, schema).join(small(rest.select("item"), n_rest), "item", "left_semi"), "b")
        more = rest.join(small(counted, min(n_rest, runtime.BROADCAST_ROWS + 1)), "item", "left").fillna(0, ["b0", "b1"])
        grams = cut(grams.unionByName(more))
        tops = [best(k) for k in range(2)]
    return [{bytes(r.item) for r in top} for top in tops]


def _in_ordinary(ordinary: DataFrame, items: list[bytes]) -> DataFrame:
    """(item, b0, b1): in how many rows of part 0 and of both parts each fragment stands; for a bounded number of them."""
    spark = ordinary.sparkSession
    shared = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {item: i for i, item in enumerate(shared.value)}
        counts = np.zeros((2, len(number)), np.int64)
        known = _Remembered(lambda word: np.array([number[x] for x in _fragments(word) if x in number], np.int32), MEMORY_WORDS)
        for batch in steps(batches):
            for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = [known[word] for word in set(lowered(text).split())]
                if found:
                    # a place that is named twice is raised once: rows are counted, not occurrences
                    counts[part][np.concatenate(found)] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, *counts[:, at])], ["number", "n0", "n1"])

    found = ordinary.mapInArrow(run, "number bigint, n0 bigint, n1 bigint").groupBy("number")
    found = found.agg(F.sum("n0").alias("b0"), F.sum(F.col("n0") + F.col("n1")).alias("b1"))
    table = spark.createDataFrame(pa.table({"number": pa.array(range(len(items)), pa.int64()), "item": pa.array(items, pa.binary())}))
    return cut(table.join(found, "number", "left").fillna(0, ["b0", "b1"]).drop("number"))


def _batch(counts: tuple[Counter, ...], names: tuple[str, ...]) -> pa.RecordBatch:
    items = list(set().union(*counts))
    columns = [pa.array(items, pa.binary()), *(pa.array([c[i] for i in items], pa.int64()) for c in counts)]
    return pa.RecordBatch.from_arrays(columns, ["item", *names])


def _covered(word: bytes, top: set[bytes]) -> list[bytes]:
    """The stretches of a word that consist of fragments in `top`."""
    spans: list[list[int]] = []
    hits = ((i, i + size) for i in range(len(word) - min(SIZES) + 1) for size in SIZES if word[i : i + size] in top)
    for i, end in hits:
        if spans and i <= spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([i, end])
    return [word[a:b] for a, b in spans]


def _thresholds(rows: DataFrame) -> tuple[int, int]:
    """The bytes and the number of windows that make the fewest mistakes (ties: the most bytes, the fewest windows)."""
    counts = np.zeros((2, MOST_BYTES, MOST_WINDOWS + 1))
    each = rows.select("toxic", F.posexplode("found").alias("m", "n"))
    for r in each.groupBy("toxic", "m", F.least("n", F.lit(MOST_WINDOWS)).alias("n")).agg(F.count("*").alias("rows")).collect():
        counts[r.toxic, r.m, r.n] += r.rows
    # mistakes when n or more windows mean toxic, n = 1, 2, ...
    wrong = counts[1].cumsum(axis=1)[:, :-1] + counts[0][:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
    saved, windows = min(np.argwhere(wrong == wrong.min()).tolist(), key=lambda x: (-x[0], x[1]))
    return saved + 1, windows + 1


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.5 on).

    Null and empty texts have no evidence. Rows with a null doc_id are scored too; repeated rows
    stay; columns other than doc_id and text are ignored.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = with_evidence(rows, model).select("doc_id", score(model, F.col("_found")).alias("score"))
    rows = rows.select("doc_id", (crc("doc_id") % FOLDS == HELD_OUT).alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that are not predicted to be toxic.

    Null and empty texts stay, repeated rows and rows without a doc_id are judged one by one, an
    empty table stays empty, and other columns may have any names.
    """
    model = train(docs, labels)
    (found,) = free_names(docs.columns, "found")
    return with_evidence(docs, model, found).where(score(model, F.col(found)) < 0.5).drop(found)
