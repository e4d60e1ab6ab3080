"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document into one bit; the measurements stay beside it. What a
policy keeps is then a bitwise test of the ledger, and the effect of leaving a rule out comes
from one count per distinct bit pattern. Changing a policy never reads a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.llm.text import steps, words_of
from precinct.runtime import send_to_workers

WINDOW = 8  # words that count as repeated when found twice in a text

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint, n_capitals bigint, n_echoes bigint"

send_to_workers(__name__)


class Rule(NamedTuple):
    """A named rule and the SQL condition over the measurements under which a document fails it."""

    name: str
    fails: str


# The place of a rule is its bit: new rules go to the end, none is ever moved or reused.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines AND n_dup_lines >= 3"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars"),
    Rule("word_length", "word_chars > 25 * n_words OR word_chars < 2 * n_words"),
    Rule("echoes", "100 * n_echoes > 30 * n_words"),
)

# Policies by version: the names of the rules that they enforce.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "word_length", "echoes"),
}


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of the named rules."""
    places = {rule.name: 1 << i for i, rule in enumerate(rules)}
    return sum(places[name] for name in set(names))


def repeated(codes: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of words that its document holds twice or more.

    `codes` are word numbers, `doc` the document of each word. Windows get equal numbers exactly
    if their words are equal: numbers of 2, 4, 8 words are made from pairs of shorter ones.
    """
    assert window & (window - 1) == 0, "the window is a power of two"
    covered = np.zeros(len(codes) + 1, np.int64)
    span, names = 1, codes.astype(np.int64)
    while span < window and len(names) > span:
        names = pd.factorize(names[:-span] * (len(codes) + 1) + names[span:])[0].astype(np.int64)
        span *= 2
    if span == window and len(names):
        start = np.flatnonzero(doc[: len(names)] == doc[window - 1 :])
        twice = start[pd.Series(doc[start] * (len(codes) + 1) + names[start]).duplicated(keep=False).to_numpy()]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + window, -1)
    return covered.cumsum()[:-1] > 0


def _measure(texts: list[str | None]) -> dict[str, list[int]]:
    words = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    flat = np.empty(len(doc), object)
    flat[:] = list(chain.from_iterable(words))
    codes = pd.factorize(flat)[0] if len(flat) else np.zeros(0, np.int64)
    again = repeated(codes, doc)
    echo = np.flatnonzero((codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])) + 1  # a word that repeats the one before
    out = {"n_words": counts, "n_repeat_words": np.bincount(doc[again], minlength=len(texts))}
    out["n_echoes"] = np.bincount(doc[echo], minlength=len(texts))
    plain = [(t or "", (t or "").encode()) for t in texts]
    lines = [[line for line in t.split("\n") if line.strip(SPACE.decode())] for t, _ in plain]
    out["word_chars"] = [len(t) - len(b) + len(b.translate(None, SPACE)) for t, b in plain]
    out["n_symbols"] = [len(b) - len(b.translate(None, SYMBOLS)) for _, b in plain]
    out["n_capitals"] = [len(b) - len(b.translate(None, CAPITALS)) for _, b in plain]
    out["n_lines"] = [len(x) for x in lines]
    out["n_dup_lines"] = [len(x) - len(set(x)) for x in lines]
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each whole text; a null text measures as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in MEASURES.split(", ")]
        for batch in steps(batches):
            found = _measure(batch.column(1).to_pylist())
            values = {name: pa.array(np.asarray(found[name], np.int64)) for name in names}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **values})

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id bigint, {MEASURES}"
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, the measurements and `fail_bits` (bit i: rule i failed).

    One narrow pass without a shuffle. Repeated rows stay, a null doc_id stays null, columns
    other than doc_id and text are ignored, an empty table gives an empty ledger.
    """
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, r in enumerate(rules)]
    whole = bits[0]
    for bit in bits[1:]:
        whole = whole.bitwiseOR(bit)
    return measured(docs).withColumn("fail_bits", whole)


def passes(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a row of the ledger passes all of the named rules."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(names, rules))) == 0


def ablations(
    kept_in: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """What every policy keeps, whole and without each of its rules.

    One row per policy and left-out rule (null: the whole policy): policy, without, n_docs,
    n_kept, n_words_kept. Only the sums per bit pattern are tested, at most 2^rules rows.
    """
    patterns = kept_in.groupBy("fail_bits").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    cases = []
    for policy, names in policies.items():
        for without in (None, *names):
            bits = mask(tuple(n for n in names if n != without), rules)
            cases.append(F.struct(F.lit(policy).alias("policy"), F.lit(without).cast("string").alias("without"), F.lit(bits).cast("bigint").alias("bits")))
    kept = F.col("fail_bits").bitwiseAND(F.col("case.bits")) == 0
    return (
        patterns.withColumn("case", F.explode(F.array(*cases)))
        .groupBy(F.col("case.policy").alias("policy"), F.col("case.without").alias("without"))
        .agg(
            F.sum("n").alias("n_docs"),
            F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("n_kept"),
            F.coalesce(F.sum(F.when(kept, F.col("words"))), F.lit(0)).alias("n_words_kept"),
        )
    )
