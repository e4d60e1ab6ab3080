"""Byte-level BPE over length-bucketed padded matrices.

A text is split by the tokenizer's pattern; each piece that is not a token itself becomes one
row of ids, one per byte. Rows of like length share a padded matrix. In each round every row
looks up the ranks of its neighbouring pairs in a hash table, merges its leftmost pair of
minimum rank, and closes the gap; rows without a pair to merge leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.text import in_worker, steps
from precinct.runtime import send_to_workers

NONE = np.int32(2**31 - 1)  # the rank of a pair that never merges

# Pieces of more bytes take one round per merge over the whole row, which is quadratic; they go
# through a heap with the same order of merges instead.
MATRIX_BYTES = 128

# Words that make a task begin a new generation of those it remembers (it keeps two, each with a step's words more at
# most), and the longest word that it remembers.
MEMORY_WORDS = 200_000
MEMORY_CHARS = 64

# Bytes of text that a task encodes at a time, and new words that it splits and merges at a time.
STEP_BYTES = 4 << 20
NEW_WORDS = 1 << 15

SCHEMA = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

send_to_workers(__name__)


class Ranks:
    """The vocabulary of a rank file: base64 of a token's bytes and its rank in each line."""

    def __init__(self, lines: list[str]):
        self.id_of = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.single = np.array([self.id_of[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in self.id_of.items():
            for k in range(1, len(token)):
                a, b = self.id_of.get(token[:k]), self.id_of.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self._build(_key(np.array(left, np.int64), np.array(right, np.int64)), np.array(merged, np.int32))

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open-addressing table, filled in rounds: of the keys at one free slot the last one stays."""
        self.mask = np.uint64((1 << int(2 * len(keys) + 1).bit_length()) - 1)
        self.keys = np.full(int(self.mask) + 1, -1, np.int64)
        self.ranks = np.full(int(self.mask) + 1, NONE, np.int32)
        slots, left = _slot(keys, self.mask), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & int(self.mask)
        placed = _slot(keys, self.mask)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.keys[placed[todo]] == keys[todo]
            self.ranks[placed[todo[found]]] = ranks[todo[found]]
            todo = todo[~found]
            placed[todo] = (placed[todo] + 1) & int(self.mask)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank (and so the id) of each merged pair, NONE where the pair is no token."""
        keys = _key(left.astype(np.int64), right.astype(np.int64)).ravel()
        slots = _slot(keys, self.mask)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[slots[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[slots[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            slots[todo] = (slots[todo] + 1) & int(self.mask)
        return out.reshape(left.shape)


def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left << 32) | right


def _slot(keys: np.ndarray, mask: np.uint64) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) & mask).astype(np.int64)


def encode_pieces(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of each piece as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = ranks.id_of.get(piece)
        if whole is not None:
            out[i] = whole.to_bytes(4, "little")
        elif len(piece) > MATRIX_BYTES:
            out[i] = _long_piece(piece, ranks)
        elif piece:
            # widths 4, 8, 16, ...: at most half of a matrix is padding
            buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
    for width, members in buckets.items():
        for start in range(0, len(members), rows := max(1, (1 << 18) // width)):
            part = members[start : start + rows]
            for i, ids in zip(part, _matrix([pieces[i] for i in part], width, ranks), strict=True):
                out[i] = ids
    return out


def _matrix(pieces: list[bytes], width: int, ranks: Ranks) -> list[bytes]:
    sizes = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
    ids = ranks.single[raw]
    columns = np.arange(width)
    pair = ranks.pairs(ids[:, :-1], ids[:, 1:])
    pair[columns[None, 1:] >= sizes[:, None]] = NONE
    done, length = np.zeros(ids.shape, "<u4"), np.zeros(len(ids), np.int64)
    alive = np.arange(len(pieces))
    while len(alive):
        at = pair.argmin(axis=1)  # the leftmost of the minimum rank
        rows = np.arange(len(alive))
        best = pair[rows, at]
        settled = best == NONE
        if settled.any():
            done[alive[settled], :width] = ids[settled]
            length[alive[settled]] = sizes[settled]
            keep = ~settled
            ids, pair, sizes, alive, at, best = ids[keep], pair[keep], sizes[keep], alive[keep], at[keep], best[keep]
            if not len(alive):
                break
            width = int(sizes.max())
            ids, pair, rows = ids[:, :width], pair[:, : width - 1], np.arange(len(alive))
        # compaction: everything right of the merged pair moves one place to the left
        columns = np.arange(width)
        source = columns[None, :] + (columns[None, :] > at[:, None])
        ids = np.take_along_axis(ids, np.minimum(source, width - 1), axis=1)
        ids[rows, at] = best
        sizes = sizes - 1
        source = np.minimum(columns[None, : width - 1] + (columns[None, : width - 1] > at[:, None]), width - 2)
        pair = np.take_along_axis(pair, source, axis=1)
        for where, first in ((at - 1 >= 0, at - 1), (at + 1 < sizes, at)):
            r = rows[where]
            pair[r, first[where]] = ranks.pairs(ids[r, first[where]], ids[r, first[where] + 1])
        pair[columns[None, 1:width] >= sizes[:, None]] = NONE
    flat, row = done.tobytes(), 4 * done.shape[1]
    return [flat[i * row : i * row + 4 * n] for i, n in enumerate(length.tolist())]


def _long_piece(piece: bytes, ranks: Ranks) -> bytes:
    """The same merges for one long piece: a linked list and a heap of (rank, place)."""
    ids = ranks.single[np.frombuffer(piece, np.uint8)]
    first = ranks.pairs(ids[:-1], ids[1:]).tolist()
    ids = ids.tolist()
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(rank, i) for i, rank in enumerate(first) if rank != NONE]
    heapq.heapify(heap)
    current = first + [int(NONE)]
    known: dict[tuple[int, int], int] = {}

    def rank_of(i: int) -> int:
        j = after[i]
        if j >= len(ids):
            return int(NONE)
        pair = (ids[i], ids[j])
        if pair not in known:
            known[pair] = ranks.id_of.get(ranks.bytes_of[pair[0]] + ranks.bytes_of[pair[1]], int(NONE))
        return known[pair]

    while heap:
        rank, i = heapq.heappop(heap)
        if current[i] != rank:
            continue  # one of the two has been merged since
        j = after[i]
        ids[i], after[i], current[j] = rank, after[j], -1
        if after[i] < len(ids):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0:
                current[k] = rank_of(k)
                if current[k] != NONE:
                    heapq.heappush(heap, (current[k], k))
    out, i = [], 0
    while i < len(ids):
        out.append(ids[i])
        i = after[i]
    return np.array(out, "<u4").tobytes()


class Coder:
    """Encodes and decodes texts; remembers the ids of a bounded number of short words.

    With the patterns of byte-level tokenizers no match runs across a space that has something
    else than white space behind it, so a text may be cut before each of these spaces and the
    pattern applied to every cut-off word alone.
    """

    def __init__(self, lines: list[str], pattern: str):
        self.ranks = Ranks(lines)
        self.split = regex.compile(pattern).findall
        self.odd_space = regex.compile(r" (?!\S)").search
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.odd_space(text):
            return regex.split(r"(?= \S)", text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + word for word in rest]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        # texts are cut twice, since all their words at once take some ten times their bytes
        words: set[str] = set()
        for text in texts:
            words.update(self._words(text))
        if len(self.memory) > MEMORY_WORDS:
            self.memory, self.older = {}, self.memory
        words -= self.memory.keys()
        self.memory.update((w, self.older[w]) for w in words & self.older.keys())
        new, long = list(words - self.older.keys()), {}
        del words
        for start in range(0, len(new), NEW_WORDS):
            for w, ids in self._merged(new[start : start + NEW_WORDS]):
                (self.memory if len(w) <= MEMORY_CHARS else long)[w] = ids
        known = ChainMap(self.memory, long) if long else self.memory
        return [b"".join(map(known.__getitem__, self._words(t))) for t in texts]

    def _merged(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids."""
        split = [self.split(w) for w in words]
        pieces = list({p for row in split for p in row})
        ids_of = dict(zip(pieces, encode_pieces([p.encode() for p in pieces], self.ranks), strict=True))
        return ((w, b"".join(map(ids_of.__getitem__, row))) for w, row in zip(words, split, strict=True))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.ranks.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def rank_lines(spark, path: str) -> list[str]:
    """The lines of a rank file on the driver's disk or, with a scheme, in any store Spark reads.

    A vocabulary is a fixed table of some 50,000 lines, whatever the corpus.
    """
    if "://" in path:
        return [r.value for r in spark.read.text(path).toLocalIterator()]
    with open(path, encoding="ascii") as file:
        return file.read().splitlines()


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, digests of the ids and of the bytes they decode to.

    With `with_ids` also the ids themselves. A null text counts as empty,
    repeated rows stay repeated, all other columns are ignored. Every text is encoded whole.
    """
    lines = docs.sparkSession.sparkContext.broadcast(rank_lines(docs.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = in_worker(("bpe", path, pattern), lambda: Coder(lines.value, pattern))
        for batch in steps(batches, size=STEP_BYTES):
            ids = coder.encode(batch.column(1).to_pylist())
            plain = [coder.decode(i) for i in ids]
            out = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in plain]),
            }
            if with_ids:
                out["ids"] = pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32()))
            out = pa.RecordBatch.from_pydict(out)
            del ids, plain
            yield out

    schema = f"doc_id bigint, {SCHEMA}" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)
