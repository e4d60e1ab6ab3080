"""Quality ledger, byte-level BPE and web archives against brute force."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from precinct.llm import bpe, quality, warc
from precinct.llm.queries import TOKENIZER

TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h " * 4, "The cat's whiskers  are\r\nlong and 123 \U0001f600 grün.",
    "same line\nsame line\n\n\nsame line", "x" * 3000, " ".join(f"w{i % 97}" for i in range(20000)), "### | $$ &&",
    "naïve   \x1c x\x85y", "  lead and trail  ", "STOP STOP STOP STOP", "á" * 300,
]
ROWS = [(i, t, "en", i) for i, t in enumerate(TEXTS)] + [(3, "one", "de", 1), (None, "no id here", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, n_words string, words int")


def _repeats(words):
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(hit)


def _measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), _repeats(words),
    )


def test_measures(docs):
    got = quality.ledger(docs).collect()
    want = [(i, *_measures(t)) for i, t, *_ in ROWS]
    found = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    for r in got:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert bool(r.fail_bits & quality.mask(quality.POLICIES["base"])) == failed


def test_ablations(docs):
    kept_in = quality.ledger(docs)
    rows = kept_in.collect()
    for r in quality.ablations(kept_in).collect():
        names = [n for n in quality.POLICIES[r.policy] if n != r.without]
        kept = [x for x in rows if not x.fail_bits & quality.mask(tuple(names))]
        assert (r.n_docs, r.n_kept, r.n_words_kept) == (len(rows), len(kept), sum(x.n_words for x in kept))


def test_empty_tables(docs):
    none = docs.where("false")
    assert quality.ledger(none).count() == 0
    assert quality.ablations(quality.ledger(none)).count() == 0
    assert bpe.encoded(none, TOKENIZER, public_tokenizers.PATTERN).count() == 0


def test_bpe_equals_the_library(docs):
    ranks = bpe.Ranks(bpe.rank_lines(docs.sparkSession, TOKENIZER)).id_of
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encoded(docs, TOKENIZER, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == len(ROWS)
    texts = dict((i, t or "") for i, t, *_ in ROWS)
    for r in got:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_long_pieces_and_matrix_agree():
    ranks = bpe.Ranks(bpe.rank_lines(None, TOKENIZER))
    rng = np.random.default_rng(0)
    for _ in range(50):
        piece = bytes(rng.choice(list(b"abetthing"), int(rng.integers(2, 120))).tolist())
        width = max(4, len(piece))
        assert bpe._matrix([piece], width, ranks) == [bpe._long_piece(piece, ranks)]


def test_bpe_holds_no_words_of_all_texts():
    """A step holds its distinct words and the ids, not an object for each word that stands in it."""
    coder = bpe.Coder(bpe.rank_lines(None, TOKENIZER), public_tokenizers.PATTERN)
    texts = [" ".join(f"w{(i * k) % 997}" for i in range(5000)) for k in range(1, 41)]
    plain = [t.encode() for t in texts]
    tracemalloc.start()
    try:
        ids = coder.encode(texts)
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [coder.decode(i) for i in ids] == plain
    assert held < 2 * sum(map(len, ids)) + 4_000_000


def test_bpe_generations(monkeypatch):
    """Words that are forgotten, kept over a generation, too long to keep or in several portions get the same ids."""
    lines = bpe.rank_lines(None, TOKENIZER)
    texts = [" ".join([f"word{i % 7}", f"rare{i}", "x" * 70, f"é{i % 50}  two"]) for i in range(300)]
    want = bpe.Coder(lines, public_tokenizers.PATTERN).encode(texts)
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 20)
    monkeypatch.setattr(bpe, "NEW_WORDS", 3)
    coder = bpe.Coder(lines, public_tokenizers.PATTERN)
    got = [coder.encode(texts[start : start + 10]) for start in range(0, 300, 10)]
    assert [i for part in got for i in part] == want
    assert len(coder.memory) < 60 and len(coder.older) < 60


A, B = "<p>" + "copy " * 400, "é" * 100_000
PAGES = [
    (1, "http://a/1", A, "x"), (2, "http://a/\r\n2", A, "x"), (9, None, A, "x"), (3, "http://b", B, "x"), (4, "u", B, "x"),
    (5, "u", None, "x"), (6, "u", "", "x"), (7, "u", "short", "x"), (8, "u", "short", "x"), (10, "u", "y" * 1000, None),
    (11, "u", "y" * 1000, None), (12, "u", "z\r\n\r\nWARC/1.1\r\n" * 9000, None), (13, "u", "p" * 65536, None),
    (9, "again", A, "x"), (None, "u", A, "x"), (None, "u", "q" * 2000, "x"), (None, "u", "q" * 2000, "x"),
]


@pytest.mark.parametrize("chunk", [1000, 65536])
def test_archive(spark, chunk):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string, payload string").repartition(3)
    folder = warc.new_folder(spark)
    warc.write_archive(pages, folder, chunk_bytes=chunk)
    assert spark.read.parquet(folder).selectExpr("max(octet_length(data)) AS n").first().n <= chunk + 1000
    want = []
    for page_id, url, html, _ in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h, _ in PAGES if h == html and p is not None] if len(raw) >= 1000 else []
        top = max(same, default=None)
        again = top is not None and top != page_id
        url = url and re.sub(r"[\r\n]", "", url)
        want.append((page_id, url, "revisit" if again else "response", top if again else None, len(raw), hashlib.sha1(raw).hexdigest(), True))
    got = [tuple(r) for r in warc.read_archive(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_archive_bytes_are_a_warc_file(spark):
    folder = warc.new_folder(spark)
    warc.write_archive(spark.createDataFrame(PAGES, "page_id bigint, url string, html string, payload string").coalesce(1), folder)
    raw = b"".join(bytes(r.data) for r in spark.read.parquet(folder).orderBy("record_no", "chunk_no").collect())
    n = 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: re")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[size : size + 4] == b"\r\n\r\n"
        raw, n = rest[size + 4 :], n + 1
    assert n == len(PAGES)


def test_empty_archive(spark):
    folder = warc.new_folder(spark)
    warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), folder)
    assert warc.read_archive(spark, folder).count() == 0
