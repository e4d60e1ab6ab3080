"""Small helpers shared by the text operators."""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from precinct.runtime import send_to_workers

# Bytes of text that one step inside a task works on at a time (a longer text is a step of its own).
STEP_BYTES = 8 << 20

# Words are runs of anything but the ASCII space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

send_to_workers(__name__)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; `bytes.split` splits at exactly the bytes that WORD leaves out."""
    return text.encode().split() if text else []


def lowered(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z in lower case; `bytes.lower` touches no other letter."""
    return text.encode().lower() if text else b""


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of a bounded number of text bytes, at least one row each."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, own in enumerate(sizes):
            if i > start and total + own > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += own
        if start < len(sizes):
            yield batch.slice(start)


def in_worker(key: tuple, make: Callable[[], object]) -> object:
    """A value kept in each Python worker for its later tasks; one at a time, so another key takes its place."""
    kept = sys.modules.setdefault("_precinct_kept", types.ModuleType("_precinct_kept")).__dict__
    if kept.get("key") != key:
        # the former value goes before the next one is made
        kept["key"] = kept["value"] = None
        kept["value"] = make()
        kept["key"] = key
    return kept["value"]


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores put before it until no column (in any case) bears it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_of(doc_id: int | None) -> int:
    """crc32 of an id as text (null: of the empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc(column: str) -> Column:
    """The same inside Spark."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
