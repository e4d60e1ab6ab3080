"""Language-model scores by context-tree weighting over bytes.

A text is coded as its lower-cased words, single spaces between them and one end mark. Every byte
is eight binary decisions; each has a tree of contexts, the last 0, 1, ... DEPTH bytes. A node
estimates by Krichevsky-Trofimov from its training counts, and the tree mixes the estimates of
all depths, each with the weight that the training counts give to stopping there.

Nothing of the model is sent whole to a task. Counts are grams (DEPTH context bytes and the byte)
of blocks of documents, kept as one compressed array per block and bucket, and summed by bucket.
The trees are worked out two depths at a time: below depth 4 in buckets of grams, where those with
the same four last context bytes, 2^24 at most, stay together; from depth 4 to 2 per two last
context bytes; the rest at once. Chances then go back the same way, and each block gets those of
just the grams it holds, as arrays in the order of its own grams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.text import crc_of, lowered, steps
from precinct.runtime import cut, scratch, send_to_workers, spread

# Context bytes, 5 or 6: a gram and its node are one 64-bit number, and those that share four bytes are bounded.
DEPTH = 6
MIDDLE = 4
END = b"\n"

FOLDS, HELD_OUT = 7, 2

# Text bytes whose grams fill one bucket, on average.
BUCKET = 2 << 20

# Occurrences of grams that are sorted at once, grams that are summed at once, and grams (or those of one context of MIDDLE
# bytes) whose nodes are worked out at once.
SORTED = 1 << 22
MERGE = 1 << 20
NODES = 1 << 16

# Parts of a log10 probability that are sent; a byte's error is half of one at most.
PARTS = float(1 << 32)

# Text bytes of one block of documents, and of one step of counting or scoring.
BLOCK_BYTES = 8 << 20
PART_BYTES = 1 << 20

# Texts of one step of scoring: a gram of seven bytes and the number of its text are one 64-bit number.
OWNERS = 256

LN2 = float(np.log(2.0))

send_to_workers(__name__)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """The log of the gamma function for x > 0: Stirling's series after a shift by eight."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    return series - np.log(shift)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def mixed(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """The log of the weighted probability of a node from its own and its children's."""
    return np.logaddexp(own, children) - LN2


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of coded texts, and where each text's grams begin."""
    pad = END * DEPTH
    raw = np.frombuffer(b"".join(chain.from_iterable((pad, t) for t in texts)), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    grams = np.zeros(max(0, len(raw) - DEPTH), np.int64)
    for k in range(DEPTH + 1):
        grams <<= 8
        grams |= raw[k : len(raw) - DEPTH + k]
    start = (sizes + DEPTH).cumsum() - (sizes + DEPTH)
    keep = np.ones(len(grams), bool)
    for k in range(DEPTH):  # what ends inside the next text's padding
        at = start[1:] - DEPTH + k
        keep[at] = False
    return grams[keep], sizes.cumsum() - sizes


def coded(text: str | None) -> tuple[list[bytes], bytes]:
    """The words of a text and the bytes that are scored."""
    words = lowered(text).split()
    return words, b" ".join(words) + END


def coded_column(texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[bytes]]:
    """The words of a column of texts one after another, how many each text has, and the bytes that are scored, as `coded` gives them."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))))
    ended = pc.binary_join_element_wise(pc.binary_join(words, " "), END.decode(), "").cast(pa.binary()).to_pylist()
    sizes, words = pc.list_value_length(words).to_numpy().astype(np.int64), words.flatten().cast(pa.binary())
    # a text without words is split into one empty word
    sizes[np.array([t == END for t in ended], bool)] = 0
    return words.filter(pc.not_equal(words, b"")), sizes, ended


def _coded_words(parts: list[pa.Array]) -> tuple[list[np.ndarray], pa.Array]:
    """The numbers of the words of some arrays, and the distinct ones by number; the end mark is number 0."""
    words = pa.concat_arrays([pa.array([b""], pa.binary()), *parts]).dictionary_encode()
    return np.split(words.indices.to_numpy()[1:], np.cumsum([len(p) for p in parts])[:-1]), words.dictionary


def _expanded(grams: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context, decision) and bits of the eight decisions of each gram."""
    symbol = grams & 255
    keys, bits = [], []
    for k in range(8):
        keys.append((context << 8) | (1 << k) | (symbol >> (8 - k)))
        bits.append((symbol >> (7 - k)) & 1)
    return np.stack(keys), np.stack(bits)


class Level:
    """The nodes of one depth: sorted keys, counts, own and weighted log probabilities."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        at, self.keys = _numbered(keys.ravel())
        self.n0, self.n1 = (np.bincount(at, x.ravel(), len(self.keys)) for x in (n0, n1))
        self.own = kt(self.n0, self.n1)
        self.weighted = self.own if below is None else mixed(self.own, np.bincount(at, below.ravel(), len(self.keys)))

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chance of a one, weight of stopping here) at each key; a half each where nothing was seen."""
        if not len(self.keys):
            return np.full(keys.shape, 0.5), np.full(keys.shape, 0.5)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        one = np.where(there, (self.n1[at] + 0.5) / (self.n0[at] + self.n1[at] + 1), 0.5)
        return one, np.where(there, np.exp(self.own[at] - LN2 - self.weighted[at]), 0.5)


def _deep(grams: np.ndarray, n: np.ndarray) -> list[Level]:
    """The nodes of depth DEPTH to MIDDLE over grams; keys are (context, decision), the last byte lowest."""
    keys, bits = _expanded(grams, grams >> 8)
    levels = [Level(keys, n * (1.0 - bits), n * (1.0 * bits), None)]
    for depth in range(DEPTH - 1, MIDDLE - 1, -1):
        levels.append(_shorter(levels[-1], depth))
    return levels


def _shorter(level: Level, depth: int) -> Level:
    """The nodes of a depth from those one deeper."""
    return Level(level.keys & _mask(depth), level.n0, level.n1, level.weighted)


def _mask(depth: int) -> int:
    """The bits of a context of some bytes and a decision."""
    return (1 << 8 * (depth + 1)) - 1


def _upper(rows: pd.DataFrame) -> tuple[Level, Level]:
    """The nodes of depth 3 and 2 over nodes of depth 4 that share their two last context bytes."""
    three = Level(rows["key"].to_numpy() & _mask(3), *(rows[c].to_numpy() for c in ("n0", "n1", "weighted")))
    return three, _shorter(three, 2)


def _chances(grams: np.ndarray, n: np.ndarray, above: np.ndarray, done: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context; `done` and `rest` are what the depths under MIDDLE give, by sorted key."""
    levels = _deep(grams, n)
    keys, bits = _expanded(grams, grams >> 8)
    at = np.searchsorted(above, keys & _mask(MIDDLE))
    one, _ = levels[0].look(keys)
    for depth, level in zip(range(DEPTH - 1, MIDDLE - 1, -1), levels[1:], strict=True):
        p, stop = level.look(keys & _mask(depth))
        one = stop * p + (1 - stop) * one
    one = done[at] + rest[at] * one
    return np.log10(np.where(bits == 1, one, 1 - one)).sum(axis=0)


def _top(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For (last byte, decision): what depths 0 and 1 add to the chance of a one, and the weight left.

    `rows` are the sums over depth 2 by last byte and decision, 256 * 255 at most.
    """
    keys = (rows["last"].to_numpy(np.int64) << 8) | rows["node"].to_numpy(np.int64)
    one = Level(keys, rows["n0"].to_numpy(float), rows["n1"].to_numpy(float), rows["weighted"].to_numpy(float))
    zero = Level(one.keys & 0xFF, one.n0, one.n1, one.weighted)
    every = np.arange(1 << 16).reshape(256, 256)
    (p0, q0), (p1, q1) = zero.look(every & 0xFF), one.look(every)
    return q0 * p0 + (1 - q0) * q1 * p1, (1 - q0) * (1 - q1)


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes of equal weight."""
    planes = np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T
    return np.ascontiguousarray(planes).view("<i8").ravel()


def _turned(grams: np.ndarray) -> np.ndarray:
    """Grams with their four last context bytes first, so that those of one context follow each other."""
    return ((grams >> 8 & 0xFFFFFFFF) << 24) | (grams >> 40 << 8) | (grams & 255)


def _back(turned: np.ndarray) -> np.ndarray:
    return (turned >> 8 & 0xFFFF) << 40 | (turned >> 24) << 8 | (turned & 255)


def _bucket(last: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of four context bytes."""
    spun = last.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((spun >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(turned: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of sorted turned grams by bucket, the buckets there are, and where each begins."""
    of = _bucket(turned >> 24, buckets)
    order = np.argsort(of, kind="stable")
    own, begins = np.unique(of[order], return_index=True)
    return order, own, begins


def _words_by_bucket(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of distinct words by bucket and then by their bytes, the buckets there are, and where each begins."""
    of = np.fromiter(map(zlib.crc32, words.to_numpy(zero_copy_only=False)), np.int64, len(words)) % buckets
    order = pc.sort_indices(words).to_numpy()
    order = order[np.argsort(of[order], kind="stable")]
    own, begins = np.unique(of[order], return_index=True)
    return order, own, begins


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Whether each of some sorted values is the first of its kind."""
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return first


def _tallied(marked: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct turned grams and their training counts, of grams with a lowest bit that is 1 in training texts."""
    keys = np.concatenate([np.zeros(0, np.int64), *marked])
    marked.clear()
    keys.sort()
    grams = keys >> 1
    keys &= 1
    begins = np.flatnonzero(_firsts(grams))
    return grams[begins], np.add.reduceat(keys, begins) if len(begins) else keys


def _numbered(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each gram among the sorted distinct ones, and these."""
    order = np.argsort(grams)
    grams = grams[order]
    first = _firsts(grams)
    codes = np.empty(len(grams), np.int32)
    codes[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return codes, grams[first]


def _owned(turned: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct turned grams of OWNERS texts at most, how often each stands, and the text of each occurrence, by gram."""
    keys = turned.view(np.uint64) << np.uint64(8)
    keys |= np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    keys.sort()
    owners = keys.astype(np.uint8)
    keys >>= np.uint64(8)
    begins = np.flatnonzero(_firsts(keys))
    return keys[begins].view(np.int64), np.diff(begins, append=len(keys)).astype(np.int32), owners


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The sorted distinct values of some arrays."""
    keys = np.concatenate(parts)
    keys.sort()
    return keys[_firsts(keys)]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in parts)])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])[order]
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[begins], np.add.reduceat(counts, begins) if len(begins) else counts


def _summed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct turned grams of a bucket's blocks and their training counts, merged step by step."""
    whole, waiting, size = _merged([]), [], 0
    for packed, n in zip(pdf["items"], pdf["n"], strict=True):
        waiting.append((np.cumsum(unpack(packed)), unpack(n)))
        size += len(waiting[-1][0])
        if size >= max(MERGE, len(whole[0])):
            whole, waiting, size = _merged([whole, *waiting]), [], 0
    return _merged([whole, *waiting])


def _stretches(keys: np.ndarray) -> Iterator[slice]:
    """Stretches of sorted turned grams of about NODES, each with all grams of its contexts of MIDDLE bytes."""
    ends = np.append(np.flatnonzero(np.diff(keys >> 24)) + 1, len(keys))
    start = 0
    while start < len(keys):
        end = int(ends[min(np.searchsorted(ends, start + NODES), len(ends) - 1)])
        yield slice(start, end)
        start = end


def chances(held: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, values): the chances of each block's grams of a bucket, in their order, in PARTS of log10.

    `held` has the grams and training counts of blocks by bucket, as `_counted` packs them.
    """

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = _summed(pdf)
        tops = (_deep(_back(keys[part]), n[part])[-1] for part in _stretches(keys))
        return pd.concat([pd.DataFrame({"key": t.keys, "n0": t.n0, "n1": t.n1, "weighted": t.weighted}) for t in tops])

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        two = _upper(pdf)[1]
        return pd.DataFrame({"last": two.keys >> 8 & 255, "node": two.keys & 255, "n0": two.n0, "n1": two.n1, "weighted": two.weighted})

    with scratch(held.sparkSession):
        # grams without training counts have nodes too, which change nothing and weigh a half
        nodes = cut(spread(held, "bucket").groupBy("bucket").applyInPandas(up, "key bigint, n0 double, n1 double, weighted double"))
        nodes = nodes.withColumn("two", F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)))
        by_last = nodes.groupBy("two").applyInPandas(sums, "last int, node int, n0 double, n1 double, weighted double")
        top = _top(by_last.groupBy("last", "node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "weighted"))).toPandas())

        def down(pdf: pd.DataFrame) -> pd.DataFrame:
            keys, (three, two) = pdf["key"].to_numpy(), _upper(pdf)
            (p3, q3), (p2, q2) = three.look(keys & _mask(3)), two.look(keys & _mask(2))
            last = (keys >> 8) & 255
            done, rest = top[0][last, keys & 255], top[1][last, keys & 255]
            done, rest = done + rest * (q2 * p2 + (1 - q2) * q3 * p3), rest * (1 - q2) * (1 - q3)
            return pd.DataFrame({"bucket": _bucket(keys >> 8 & 0xFFFFFFFF, buckets), "key": keys, "done": done, "rest": rest})

        above = cut(nodes.groupBy("two").applyInPandas(down, "bucket bigint, key bigint, done double, rest double"), keep=True)

    def each(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        keys, n = _summed(pdf)
        above = above.sort_values("key")
        above = [above[c].to_numpy() for c in ("key", "done", "rest")]
        p = np.concatenate([_chances(_back(keys[part]), n[part], *above) for part in _stretches(keys)])
        p = np.rint(p * -PARTS).astype(np.int64)
        values = [pack(p[np.searchsorted(keys, np.cumsum(unpack(packed)))]) for packed in pdf["items"]]
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "values": values})

    sides = (spread(x, "bucket").groupBy("bucket") for x in (held.select("block", "bucket", "items", "n"), above))
    return next(sides).cogroup(next(sides)).applyInPandas(each, "block bigint, bucket bigint, values binary")


def word_counts(held: DataFrame) -> DataFrame:
    """(block, bucket, values, n, v): the training counts of each block's words of a bucket, in their order.

    One row of a bucket has the sum n of its counts and the number v of its words with a count, the others zeros.
    """

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        items = pa.array([zstandard.decompress(packed) for packed in pdf["items"]], pa.binary())
        words = pc.split_pattern(items, b" ")
        encoded = words.flatten().dictionary_encode()
        codes, total = encoded.indices.to_numpy(), np.zeros(len(encoded.dictionary), np.int64)
        np.add.at(total, codes, np.concatenate([unpack(n) for n in pdf["n"]]))
        ends = pc.list_value_length(words).to_numpy().cumsum()
        values = [pack(own) for own in np.split(total[codes], ends[:-1])]
        sums = {"n": total.sum(), "v": (total > 0).sum()}
        first = np.arange(len(pdf)) == 0
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "values": values} | {k: x * first for k, x in sums.items()})

    return spread(held, "bucket").groupBy("bucket").applyInPandas(count, "block bigint, bucket bigint, values binary, n bigint, v bigint")


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc_id, text) of a partition: blocks are stretches of it of about BLOCK_BYTES of text."""
    read, first = 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        total = read + np.cumsum(sizes, dtype=np.int64)
        read = int(total[-1]) if len(total) else read
        yield pa.RecordBatch.from_arrays([pa.array(first + total // BLOCK_BYTES), batch.column(0), batch.column(1)], ["block", "doc_id", "text"])


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, text), read twice.

    Both uses of `_in_blocks` run on the same narrow plan over the same rows in the same order, so
    they agree; a block without the chances it needs is an error.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _counted(docs: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, is_gram, items, n): what each block holds, with its training counts, packed by bucket.

    Grams are turned, sorted and stored by their differences; words are sorted and joined by spaces.
    """
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("is_gram", pa.bool_()), ("items", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, grams, marked, tokens = None, [], [], []
        for batch in steps(_in_blocks(batches)):
            for own, rows in _by_block(batch):
                if own != block and block is not None:
                    yield from _counts(block, [*grams, _tallied(marked)], tokens, buckets, schema)
                    grams, tokens = [], []
                block = own
                for part in steps(iter([rows]), size=PART_BYTES):
                    known = np.array([crc_of(i) % FOLDS != HELD_OUT for i in part.column("doc_id").to_pylist()])
                    words, sizes, texts = coded_column(part.column("text"))
                    turned = _turned(grams_of(texts)[0])
                    turned <<= 1
                    turned |= np.repeat(known, [len(t) for t in texts])
                    marked.append(turned)
                    if sum(map(len, marked)) >= SORTED:
                        grams.append(_tallied(marked))
                    tokens.append((words, np.repeat(known, sizes), int(known.sum())))
        if block is not None:
            yield from _counts(block, [*grams, _tallied(marked)], tokens, buckets, schema)

    return _read(docs).mapInArrow(run, "block bigint, bucket bigint, is_gram boolean, items binary, n binary")


def _by_block(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each block, for rows in the order of their blocks."""
    blocks = batch.column("block").to_numpy()
    begins = np.flatnonzero(_firsts(blocks))
    for start, end in zip(begins.tolist(), [*begins[1:].tolist(), len(blocks)], strict=True):
        yield int(blocks[start]), batch.slice(start, end - start)


def _counts(block: int, grams: list, tokens: list, buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    distinct, n = _merged(grams)
    order, own, begins = _by_bucket(distinct, buckets)
    rows = [
        (block, int(b), True, pack(np.diff(distinct[part], prepend=0)), pack(n[part]))
        for b, part in zip(own, np.split(order, begins[1:]), strict=True)
    ]
    codes, words = _coded_words([w for w, *_ in tokens])
    n = np.zeros(len(words), np.int64)
    for c, (_, known, ends) in zip(codes, tokens, strict=True):
        n += np.bincount(c[known], minlength=len(n))
        # the end mark counts once a text
        n[0] += ends
    order, own, begins = _words_by_bucket(words, buckets)
    ends = pa.array(np.append(begins, len(words)), pa.int32())
    lists = pc.binary_join(pa.ListArray.from_arrays(ends, words.take(pa.array(order))), b" ").to_pylist()
    for b, text, part in zip(own, lists, np.split(order, begins[1:]), strict=True):
        rows.append((block, int(b), False, zstandard.compress(text, 1), pack(n[part])))
    for start in range(0, len(rows), 1000):
        columns = zip(*rows[start : start + 1000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def scored(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the documents whose crc32(doc_id) mod FOLDS is not HELD_OUT. `base_score` is the
    add-one unigram score of the words and an end token; `score` the context tree's log10
    probability of the same words, `bits_per_byte` its code length. A null text is empty and
    scores its end mark; repeated rows count as often as they stand; other columns are ignored.
    """
    spark = docs.sparkSession
    size = docs.select(F.octet_length(F.col("text").cast("string")).cast("bigint").alias("size")).agg(F.sum("size")).first()[0]
    buckets = max(1, -(-(size or 0) // BUCKET))
    with scratch(spark):
        held = cut(_counted(docs, buckets))
        words = cut(word_counts(held.where("NOT is_gram").drop("is_gram")), keep=True)
        grams = cut(chances(held.where("is_gram").drop("is_gram"), buckets), keep=True)
    total = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v"))).first()
    n, v = int(total.n), int(total.v)
    needed = grams.withColumn("is_gram", F.lit(True)).unionByName(words.drop("n", "v").withColumn("is_gram", F.lit(False)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        is_gram = right.column("is_gram").to_numpy()
        sent, counts = (np.concatenate([unpack(x) for x in right.column("values").filter(pa.array(kind)).to_pylist()]) for kind in (is_gram, ~is_gram))
        ids, words, sizes, lengths, parts = left.column("doc_id").to_pylist(), [], [], [], []
        for batch in steps(iter(left.select(["text"]).to_batches()), size=PART_BYTES):
            for start in range(0, batch.num_rows, OWNERS):
                own, size, texts = coded_column(batch.slice(start, OWNERS).column("text"))
                words.append(own)
                sizes.append(size)
                lengths.append(np.array([len(t) for t in texts]))
                parts.append(_owned(_turned(grams_of(texts)[0]), lengths[-1]))
        # the block's grams and words in the order in which they were counted
        keys = _distinct([p[0] for p in parts])
        codes, distinct = _coded_words(words)
        if len(sent) != len(keys) or len(counts) != len(distinct):
            raise RuntimeError("the documents changed between two reads of them")
        values, count_of = np.empty(len(keys)), np.empty(len(counts), np.int64)
        values[_by_bucket(keys, buckets)[0]] = sent / -PARTS
        count_of[_words_by_bucket(distinct, buckets)[0]] = counts
        sums = [
            np.bincount(owners, np.repeat(values[np.searchsorted(keys, grams)], often), len(length))
            for (grams, often, owners), length in zip(parts, lengths, strict=True)
        ]
        p, length, size = (np.concatenate(x) for x in (sums, lengths, sizes))
        # the end mark stands behind each text's words
        c = np.insert(count_of[np.concatenate(codes)], size.cumsum(), count_of[0])
        size += 1
        starts = size.cumsum() - size
        base = np.add.reduceat(np.log10(c + 1) - np.log10(n + v + 1), starts)
        seen = np.add.reduceat((c > 0).astype(np.int64), starts)
        held_out = [crc_of(i) % FOLDS == HELD_OUT for i in ids]
        columns = [ids, held_out, size, seen, np.full(len(ids), n), base, p, -p / np.log10(2) / length]
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    fields = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_())]
        + [(k, pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")]
        + [(k, pa.float64()) for k in ("base_score", "score", "bits_per_byte")]
    )
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    blocks = _read(docs).mapInArrow(_in_blocks, "block bigint, doc_id bigint, text string")
    sides = (spread(x, "block").groupBy("block") for x in (blocks, needed))
    return next(sides).cogroup(next(sides)).applyInArrow(score, schema)
