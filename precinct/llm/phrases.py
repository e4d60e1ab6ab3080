"""Removal of passages that earlier documents already have, by repeated-phrase automata.

1. Anchors. Of the word 5-grams inside a window of 13 words the one with the smallest hash is its
   anchor (winnowing), so documents that share a window share its anchor. Only anchors found
   under two or more doc_ids go on; their windows are cut out as short pieces of text.
2. Automata. The distinct pieces are dealt out by anchor. Each shard confirms the windows that
   recur, compiles them into an Aho-Corasick automaton over words, and streams its pieces
   through it, which locates every recurring window and the first document that has it.
3. Removal. Each occurrence in a document that is not the first removes the window's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.text import steps, words_of
from precinct.runtime import BROADCAST_ROWS, attach, cut, scratch, send_to_workers, small

WINDOW = 13
GRAM = 5

# Pieces that one automaton is compiled from: small, as a node's children are searched one by one.
SHARD_PIECES = 250

# Distinct pieces from which on an anchor is dealt out window by window.
HOT_PIECES = 10_000

send_to_workers(__name__)


def word_hashes(flat: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word; each distinct word is hashed once."""
    words = np.empty(len(flat), object)
    words[:] = flat
    codes, distinct = pd.factorize(words)
    return np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)[codes]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _anchors(hashes: np.ndarray, doc: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, hash, first window, number of windows) of each anchor, documents laid end to end."""
    n = len(hashes) - gram + 1
    if len(hashes) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    grams = np.zeros(n, np.uint64)
    for k in range(gram):
        grams += hashes[k : k + n] * np.uint64((2 * k + 3) ** 11)
    grams = mixed(grams)
    inside = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    at = np.concatenate([inside[i : i + 65536].argmin(axis=1) for i in range(0, len(inside), 65536)])
    at += np.arange(len(at))  # the leftmost minimum: never moves back
    starts = np.flatnonzero(doc[: len(at)] == doc[window - 1 :])
    at = at[starts]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(starts) != 1)]) if len(at) else np.zeros(0, int)
    counts = np.diff(np.r_[new, len(at)])
    return doc[starts[new]], grams[at[new]].view(np.int64), starts[new], counts


def anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, h, places): each anchor of a text and the windows that chose it.

    The places of an anchor that a text repeats are packed into one row. A place is the first
    window times `window`, plus how many windows follow it; fewer than `window` share an anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words = [words_of(t) for t in batch.column(2).to_pylist()]
            sizes = np.array([len(w) for w in words], np.int64)
            doc = np.repeat(np.arange(len(words)), sizes)
            row, h, start, n = _anchors(word_hashes(list(chain.from_iterable(words))), doc, window, gram)
            order = np.lexsort((h, row))
            row, h, start, n = row[order], h[order], start[order], n[order]
            start = start - (sizes.cumsum() - sizes)[row]
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(row) else np.zeros(0, int)
            ends = pa.array(np.r_[new, len(row)].astype(np.int32))
            rows = pa.array(row[new])
            places = pa.ListArray.from_arrays(ends, pa.array(start * window + n - 1))
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h[new]), places]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "h", "places"])

    return docs.mapInArrow(run, "doc_id bigint, th bigint, h bigint, places array<bigint>")


def shared(found: DataFrame) -> DataFrame:
    """(h, n): the anchors found under several doc_ids and their numbers of rows."""
    ids = found.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return ids.where("low < high").select("h", "n")


def pieces(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, h, start, piece): the words around each anchor found under several doc_ids.

    A row here is one anchor of one text. Anchors are counted with partial sums before the
    shuffle, and the rows of a hot one meet it by broadcast, so they are never in one task. The
    written anchors go before the texts are shuffled to meet theirs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            row, h, place = _places(batch.column(3))
            words = [words_of(t) for t in batch.column(2).to_pylist()]
            before = np.r_[0, np.cumsum([len(w) for w in words])]
            flat = list(chain.from_iterable(words))
            ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1)
            start, more = np.divmod(place, window)
            first = before[row] + start
            text = b" ".join(flat)
            # a piece is a stretch of the batch's words joined by single spaces
            starts, stops = np.r_[0, ends][first], ends[first + more + window - 1] - 1
            piece = pa.array([text[i:j] for i, j in zip(starts.tolist(), stops.tolist(), strict=True)], pa.string())
            rows = pa.array(row)
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h), pa.array(start.astype(np.int32)), piece]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "h", "start", "piece"])

    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):
            found = cut(anchors(docs, window, gram))
            known = cut(shared(found))
            n = known.count()
            found = attach(found, known, ["h"], "n") if n > BROADCAST_ROWS else found.join(small(known, n), "h")
            spots = cut(found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "places")).alias("spots")), keep=True)
        joined = docs.join(spots, ["doc_id", "th"]).select("doc_id", "th", "text", "spots")
        cut_out = cut(joined.mapInArrow(run, "doc_id bigint, th bigint, h bigint, start int, piece string"), keep=True)
    return _spread(cut_out, window)


def _places(spots: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, anchor, place), once each, of a column of lists of anchors with their places."""
    h, places = spots.flatten().flatten()
    row = np.repeat(np.arange(len(spots)), pc.list_value_length(spots).to_numpy(zero_copy_only=False))
    sizes = pc.list_value_length(places).to_numpy(zero_copy_only=False)
    row, h = np.repeat(row, sizes), np.repeat(h.to_numpy(zero_copy_only=False), sizes)
    place = places.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((place, row))
    row, h, place = row[order], h[order], place[order]
    # repeated rows bring the same places, and a place has one anchor
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1])]) if len(row) else np.zeros(0, int)
    return row[new], h[new], place[new]


def _spread(rows: DataFrame, window: int) -> DataFrame:
    """Anchors with too many distinct pieces for one automaton are dealt out window by window."""
    counts = rows.groupBy("h").agg(F.approx_count_distinct(F.xxhash64("piece")).alias("n"))
    hot = cut(counts.where(F.col("n") > HOT_PIECES).select("h"))
    n = hot.count()
    if not n:
        return rows
    parts = rows.join(small(hot, n), "h", "left_semi").withColumn("words", F.split("piece", " "))
    parts = parts.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - window)))
    parts = parts.withColumns({"piece": F.array_join(F.slice("words", F.col("at") + 1, window), " "), "start": F.col("start") + F.col("at")})
    parts = parts.withColumn("h", F.xxhash64("piece")).select(rows.columns)
    return rows.join(small(hot, n), "h", "left_anti").unionByName(parts)


def located(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, piece_hash, spots): the recurring windows in each distinct piece and their first doc_id."""
    distinct = found.groupBy("h", "piece").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("h", F.xxhash64("piece").alias("piece_hash"), "piece", "low", "high")
    dealt = dealt.repartition(parts, "h").sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if len(shard) >= SHARD_PIECES and row[0] != shard[-1][0]:
                    yield from _locate(shard, window)
                    shard = []
                shard.append(row)
        yield from _locate(shard, window)

    return dealt.mapInArrow(run, "h bigint, piece_hash bigint, spots array<struct<at:int,first:bigint>>")


def _locate(shard: list[tuple], window: int) -> Iterator[pa.RecordBatch]:
    """Compile the recurring windows of a shard and stream its pieces through the automaton."""
    codes: dict[str, str] = {}
    texts, seen = [], {}
    for _, _, piece, low, high in shard:
        # a word is one character of the automaton's alphabet; the surrogates are left out
        text = "".join([codes.get(w) or codes.setdefault(w, chr(len(codes) + (2048 if len(codes) >= 0xD800 else 0))) for w in piece.split(" ")])
        texts.append(text)
        for i in range(len(text) - window + 1):
            phrase = text[i : i + window]
            known = seen.get(phrase)
            if known is None:
                seen[phrase] = (low, high)
            elif low < known[0] or high > known[1]:
                seen[phrase] = (min(low, known[0]), max(high, known[1]))
    automaton = ahocorasick.Automaton()
    for phrase, (low, high) in seen.items():
        if low < high:
            automaton.add_word(phrase, low)
    if not len(automaton):
        return
    automaton.make_automaton()
    ends, firsts, bounds, kept = [], [], [0], []
    for i, text in enumerate(texts):
        for end, low in automaton.iter(text):
            ends.append(end)
            firsts.append(low)
        if len(ends) > bounds[-1]:
            bounds.append(len(ends))
            kept.append(i)
    at = pa.array(np.array(ends, np.int32) - np.int32(window - 1))
    spots = pa.StructArray.from_arrays([at, pa.array(firsts, pa.int64())], ["at", "first"])
    columns = [pa.array([shard[i][k] for i in kept], pa.int64()) for k in (0, 1)]
    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spots))
    yield pa.RecordBatch.from_arrays(columns, ["h", "piece_hash", "spots"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for).

    A word goes if it lies in a run of `window` words that also starts in a document with a
    smaller doc_id; runs are judged on the input. The kept words are joined by single spaces.
    Texts of fewer words lose nothing; a null text is empty; rows that share a doc_id do not
    remove from each other; a row without doc_id loses nothing and removes nothing. Repeated
    rows stay and other columns are ignored.
    """
    rows = _keyed(docs)
    numbered = rows.where("doc_id IS NOT NULL")
    kept_schema = "doc_id bigint, th bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out: dict[str, list] = {name.split()[0]: [] for name in kept_schema.split(", ")}
            gone_of = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            for doc_id, th, text, gone in zip(*(batch.column(i).to_pylist() for i in range(3)), gone_of, strict=True):
                words = words_of(text)
                left = words
                if gone:
                    covered = np.zeros(len(words) + 1, np.int64)
                    np.add.at(covered, gone, 1)
                    np.add.at(covered, np.array(gone) + window, -1)
                    left = [w for w, c in zip(words, covered.cumsum()[:-1].tolist(), strict=True) if not c]
                text = b" ".join(left)
                values = (doc_id, th, len(words), len(words) - len(left), hashlib.sha256(text).hexdigest(), text.decode())
                for column, value in zip(out.values(), values, strict=False):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=False)], list(out))

    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    keys = ["doc_id", "th"]
    plain = rows.mapInArrow(run, kept_schema)
    with scratch(docs.sparkSession):
        found = pieces(numbered, window, gram)
        spots = located(found, window)
        hits = found.select("doc_id", "th", "h", "start", F.xxhash64("piece").alias("piece_hash")).join(cut(spots), ["h", "piece_hash"])
        earlier = F.filter("spots", lambda s: s["first"] < F.col("doc_id"))
        hits = hits.withColumn("gone", F.transform(earlier, lambda s: s["at"] + F.col("start"))).where("size(gone) > 0")
        hits = cut(hits.groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))
        n = hits.count()
        changed = rows.join(small(hits.select(keys), n), keys, "left_semi").dropDuplicates(keys)
        changed = cut(changed.join(hits, keys).select("doc_id", "th", "text", "gone").mapInArrow(run, kept_schema), keep=True)
    names = [c for c in changed.columns if c not in keys and c != "n_words"]
    changed = changed.select(*keys, *(F.col(c).alias(f"new_{c}") for c in names))
    whole = plain.join(small(changed, n) if not with_text else changed, keys, "left")
    return whole.select("doc_id", "n_words", *(F.coalesce(f"new_{c}", c).alias(c) for c in names))
