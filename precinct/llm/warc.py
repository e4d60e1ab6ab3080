"""Web archives as chunked record tables.

An archive is a Parquet table of rows (record_no, chunk_no, data): the `data` of its rows in the
order of record_no and chunk_no are the bytes of a WARC 1.1 file. A record whose payload fits
into one chunk is one row; a larger one is streamed as many rows of bounded size, so neither the
writer's rows nor the reader's digests ever hold a whole record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.runtime import checkpoint_dir, cut, send_to_workers, small

CHUNK_BYTES = 64 << 10

# Payloads shorter than this are always written out.
REVISIT_BYTES = 1000

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

send_to_workers(__name__)

_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def write_archive(pages: DataFrame, folder: str, date: str = DATE, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write one record per row of `pages` (page_id, url, html) to an archive table at `folder`.

    A null html is an empty payload, a null url leaves its header out. Of the records with equal
    payloads of REVISIT_BYTES or more, the one with the largest page_id is the response and the
    others are revisits of it; rows that repeat that page_id are responses too, and payloads of
    which no page has an id are all responses. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload")})
    # groups of copies collapse before the shuffle; only page ids, lengths and digests move
    groups = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes")
    copied = cut(groups.agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    rows = rows.join(small(copied, copied.count()), ["digest", "bytes"], "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col("page_id"))
    rows = rows.withColumns({"revisit": revisit, "record_no": F.monotonically_increasing_id()})

    body = F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.concat(F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id"), F.col("record_no"))),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(
            F.col("revisit"),
            F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("refers_to"), None)),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (body + len(_HTTP)).cast("string"),
        F.lit("\r\n\r\n" + _HTTP),
    )
    last = F.greatest(F.ceil(body / chunk_bytes) - 1, F.lit(0)).cast("int")
    rows = rows.withColumns({"head": head.cast("binary"), "last": last})
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), "last")).alias("chunk_no"))
    empty = F.lit("").cast("binary")
    part = F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    data = F.concat(
        F.when(F.col("chunk_no") == 0, F.col("head")).otherwise(empty),
        F.when(F.col("revisit"), empty).otherwise(part),
        F.when(F.col("chunk_no") == F.col("last"), F.lit("\r\n\r\n").cast("binary")).otherwise(empty),
    )
    rows.select("record_no", "chunk_no", data.alias("data")).write.parquet(folder)


def _urn(page_id: Column, record_no: Column | None) -> Column:
    shown = F.coalesce(page_id.cast("string"), F.lit("none"))
    if record_no is None:
        return F.concat(F.lit("<urn:page:"), shown, F.lit(">"))
    return F.concat(F.lit("<urn:page:"), shown, F.lit("#"), record_no.cast("string"), F.lit(">"))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of an archive table, from its bytes alone.

    page_id, url, record_type, refers_to, payload_bytes, payload_digest (both measured on the
    bytes read; a revisit takes those of the response it refers to) and digest_ok (the header's
    digest equals the measured one).
    """
    chunks = spark.read.schema("record_no bigint, chunk_no int, data binary").parquet(folder)
    # the head ends at the first empty line and the HTTP head at the second; the bytes may end inside a character
    text = F.col("data").cast("string")
    start = F.octet_length(F.substring_index(text, "\r\n\r\n", 2)) + 4
    head = F.substring_index(text, "\r\n\r\n", 1)
    first = chunks.where("chunk_no = 0").select("*", head.alias("head"), start.alias("start"))
    size = F.regexp_extract("head", r"Content-Length: (\d+)", 1).cast("bigint")
    first = first.withColumn("body", size - (F.col("start") - F.octet_length("head") - 4))
    whole = F.col("start") + F.col("body") + 4 == F.octet_length("data")
    payload = F.substring(F.col("data"), F.col("start") + 1, F.col("body").cast("int"))
    short = first.where(whole).select("head", F.col("body").alias("n"), F.sha1(payload).alias("sha1"))
    # only the chunks of oversized records meet, in order, and pass one by one through a running digest
    long = chunks.join(_oversized(chunks), "record_no", "left_semi")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = long.repartition(parts, "record_no").sortWithinPartitions("record_no", "chunk_no")
    records = short.unionByName(long.mapInArrow(_digests, "head string, n bigint, sha1 string"))

    def field(name: str, value: str = "(.*)") -> Column:
        return F.nullif(F.regexp_extract("head", rf"\r\n{name}: {value}", 1), F.lit(""))

    records = cut(
        records.select(
            field("WARC-Record-ID", r"<urn:page:(-?\d+)").cast("bigint").alias("page_id"),
            field("WARC-Target-URI").alias("url"),
            field("WARC-Type").alias("record_type"),
            field("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("bigint").alias("refers_to"),
            field("WARC-Payload-Digest", "sha1:(.*)").alias("stated"),
            "n",
            "sha1",
        )
    )
    answers = records.where(f"record_type = 'response' AND n >= {REVISIT_BYTES}").groupBy("page_id", "stated")
    answers = answers.agg(F.max("n").alias("of_n"), F.max("sha1").alias("of_sha1"))
    answers = answers.withColumnsRenamed({"page_id": "refers_to"})
    again = records.where("record_type = 'revisit'").join(cut(answers), ["refers_to", "stated"], "left")
    again = again.withColumns({"n": F.col("of_n"), "sha1": F.col("of_sha1")}).drop("of_n", "of_sha1")
    return (
        records.where("record_type <> 'revisit'")
        .unionByName(again)
        .select(
            "page_id",
            "url",
            "record_type",
            "refers_to",
            F.col("n").alias("payload_bytes"),
            F.col("sha1").alias("payload_digest"),
            F.col("stated").eqNullSafe(F.col("sha1")).alias("digest_ok"),
        )
    )


def _oversized(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_no = 1").select("record_no")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Head, payload bytes and digest of each record from its chunks in order."""
    open_record, head, digest, left, n = None, "", hashlib.sha1(), 0, 0
    for batch in batches:
        done = []
        columns = (batch.column(i) for i in range(3))
        for record_no, chunk_no, data in zip(*columns, strict=True):
            view = memoryview(data.as_buffer())
            if chunk_no.as_py() == 0:
                raw = bytes(view[: 64 << 10])
                end = raw.index(b"\r\n\r\n")
                start = raw.index(b"\r\n\r\n", end + 4) + 4
                open_record, head, digest, n = record_no.as_py(), raw[:end].decode(), hashlib.sha1(), 0
                left = int(re.search(r"Content-Length: (\d+)", head)[1]) - (start - end - 4)
                view = view[start:]
            if record_no.as_py() != open_record:
                raise ValueError(f"record {record_no} has no first chunk")
            piece = view[:left]
            digest.update(piece)
            n, left = n + len(piece), left - len(piece)
            if not left and len(view) > len(piece):  # the record's closing empty lines
                done.append((head, n, digest.hexdigest()))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("head", "n", "sha1"), d, strict=True)) for d in done])


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared scratch space."""
    return f"{checkpoint_dir(spark)}/precinct-warc/{uuid.uuid4().hex}"
