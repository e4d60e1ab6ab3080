"""Toxicity, decontamination, main text, language model and pipeline on small fixtures."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from precinct.llm import decontaminate, html, lm, toxicity


def _words(rng, n, v=300):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(3 + x % 5)) if rng.random() < 0.3 else f"word{x}" for x in (rng.randrange(v) for _ in range(n)))


# ---- toxicity ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = _words(rng, rng.randrange(30, 120)).split()
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grumblefoot", "Snortwhelp", "vilecreature"]) + rng.choice(["", ",", "ish"]))
        rows.append((i, " ".join(words), "x", 1.0))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(bad), 1))
    rows += [(1000, None, "x", 0.0), (1001, "", "x", 0.0), (None, "plain words", "x", 0.0), (1002, "z" * 100_000, "x", 0.0), (0, rows[0][1], "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, predicted string, score double")
    return docs, spark.createDataFrame([*labels, (5, None, None)], "doc_id bigint, toxic int, quality int")


def test_toxicity(labelled):
    docs, labels = labelled
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        crc = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode())
        assert r.held_out == (crc % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 400]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in known]) > 0.95
    assert all(r.predicted == 0 for r in got if r.doc_id is None or r.doc_id >= 1000)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == 0 for r in got)


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    assert {r.predicted for r in toxicity.scored(docs, labels.where("false")).collect()} == {0}
    assert toxicity.scored(docs.where("false"), labels).count() == 0


# ---- decontamination ---------------------------------------------------------------


def test_benchmark_passages(spark):
    rng = random.Random(2)
    fresh = iter(range(10**6))
    words = lambda n: [f"t{next(fresh)}" for _ in range(n)]
    items = [(i, words(n)) for i, n in enumerate((40, 25, 14, 9, 6, 4))]
    changed = [w if k % 9 != 4 else "other" for k, w in enumerate(items[0][1])]
    texts = {
        1: (words(50) + items[0][1] + words(9), [0]),
        2: (words(5) + changed, [0]),
        3: (items[1][1][:20], [1]),
        4: (items[1][1][:9] + words(30), []),
        5: (items[2][1] + words(3) + items[3][1] + words(2) + items[4][1] + items[5][1], [2, 3, 4]),
        6: (words(500), []),
        7: ([w.upper() + "," for w in items[0][1]], [0]),
        8: ([w if k % 3 else "other" for k, w in enumerate(items[0][1])], []),
        9: (items[0][1] * 300, [0]),
    }
    rows = [(i, " ".join(w), "x", "y") for i, (w, _) in texts.items()]
    rows += [(20, None, "x", "y"), (21, "", "x", "y"), (1, rows[0][1], "x", "y"), (None, rows[0][1], "x", "y"), (6, rows[0][1], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string, row string")
    bench = spark.createDataFrame([(i, " ".join(w), 0) for i, w in items] + [(90, None, 0), (91, "", 0)], "item_id bigint, text string, doc_id int")
    got = sorted(((r.doc_id, r["items"], r.contaminated) for r in decontaminate.report(docs, bench).collect()), key=str)
    want = [(i, found, bool(found)) for i, (_, found) in texts.items()]
    want += [(20, [], False), (21, [], False), (1, [0], True), (None, [0], True), (6, [0], True)]
    assert got == sorted(want, key=str)
    kept = decontaminate.without_benchmark(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _, hit in want if not hit), key=str)
    assert decontaminate.report(docs, bench.where("false")).where("contaminated").isEmpty()
    assert decontaminate.report(docs.where("false"), bench).count() == 0


def test_best_stretch():
    """Against all stretches: the most equal tokens at the stated share, also when replacements split them into runs."""
    rng = random.Random(3)
    lost = np.ones(16, bool)
    lost[[6, 12]] = False
    cases = [lost, np.zeros(5, bool), np.ones(7, bool)]
    cases += [np.array([rng.random() < share for _ in range(n)]) for n in range(1, 41) for share in (0.6, 0.75, 0.8, 0.9) for _ in range(4)]
    for equal in cases:
        spans = [(a, b) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if 5 * equal[a:b].sum() >= 4 * (b - a)]
        start, end, same = decontaminate._best(equal)
        assert same == max((equal[a:b].sum() for a, b in spans), default=0)
        assert equal[start:end].sum() == same and 5 * same >= 4 * (end - start)


def _found(items, words):
    tokens = decontaminate.tokens_of(" ".join(words))
    hashes, size = decontaminate.word_hashes(tokens), np.array([len(tokens)])
    return items.overlaps(hashes, np.zeros(len(tokens), np.int64), np.zeros(1, np.int64), size)


def test_every_overlap_has_a_seed():
    """All sets of replaced places that the rule allows, for items of 5 to 20 tokens."""
    for n in range(5, 21):
        words = [f"w{k}" for k in range(n)]
        items = decontaminate.Items([(0, " ".join(words))])
        needed = min(13, -(-4 * n // 5))
        for places in itertools.combinations(range(n), min(n - needed, n // 5)):
            got = _found(items, ["a", *("other" if k in places else w for k, w in enumerate(words)), "b"])
            assert len(got) == 1 and got[0][4] >= needed, (n, places)
        assert not _found(items, words[: needed - 1]) and not _found(items, ["b", *words[1:needed], "a"])


def test_items_without_spaces():
    item = "\u5b57\u6bcd\u8868\u793a\u58f0\u97f3\u548c\u610f\u601d"
    items = decontaminate.Items([(0, item)])
    assert len(_found(items, ["x" + item[:4] + "\u4e0d" + item[5:] + "\u4e86", "y"])) == 1
    assert not _found(items, [item[:6] + "\u4e0d" * 9])
    assert decontaminate.tokens_of("ab\u5b57\u6bcdc \u00e9t\u00e9") == [x.encode() for x in ("ab", "\u5b57", "\u6bcd", "c", "\u00e9t\u00e9")]


# ---- main text ---------------------------------------------------------------------


def _page(body, host="a.example", path="p"):
    return f"http://{host}/{path}", f'<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style></head><body>{body}</body></html>'


def test_main_text(spark):
    shell = (
        '<header><h1>Site</h1></header><nav><ul><li><a href="/">Home {n}</a></li></ul></nav><div class="cookie-notice">We use</div>'
        '<div id="content"><div class="post"><h2>Title {n}</h2><p class="share-line">Written by the staff of this site</p>{body}</div>'
        '<section class="comments"><p>I agree {n}</p></section></div><aside>See also {n}</aside><form><p>Search</p></form>'
        '<div class="ad">Buy {n}</div><footer>&copy; 2020</footer><script>var t="</p>{n}";</script>'
    )
    rows, want = [], {}
    for n in range(8):
        body = "".join(f"<p>Body {n} text &amp; more\n  of it {k} <b>bold</b><br>line<!-- no --></p>" for k in range(n + 1)) + f"<ul><li>one {n}<li>two {n}</ul>"
        rows.append((n, *_page(shell.replace("{n}", str(n)).replace("{body}", body)), "x"))
        blocks = [f"Title {n}", *(f"Body {n} text & more of it {k} bold line" for k in range(n + 1)), f"one {n}", f"two {n}"]
        want[n] = "\n".join(blocks)
    article = "<nav>menu</nav><article><h1>Only one</h1><p><b>Lead<br><p>rest &eacute; a < b</article><footer>f</footer>"
    rows += [(20, *_page(article, "b.example"), "x"), (21, "http://c.example/", None, "x"), (22, None, "", "x"), (23, None, "plain", "x"), (24, "http://d.example/", "<p>" + "long " * 50_000, "x")]
    want |= {20: "Only one\nLead\nrest é a < b", 21: "", 22: "", 23: "plain", 24: ("long " * 50_000).strip()}
    rows += [(30 + k, *_page(article, "e.example", str(k)), "x") for k in range(5)]
    want |= {30 + k: want[20] for k in range(5)}
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string").repartition(3)
    for r in html.main_text(pages).collect():
        assert r.text == want[r.page_id], r.page_id
        assert r.n_chars == len(r.text)
    assert html.main_text(pages.where("false")).count() == 0


def _texts(spark, bodies):
    rows = [(n, *_page(body, path=str(n))) for n, body in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    return [r.text for r in sorted(html.main_text(pages).collect(), key=lambda r: r.page_id)]


def test_template_slots_keep_other_text(spark):
    """A slot that most pages fill alike loses that text only, and a container's constant words only themselves."""
    bodies = [f"<article>By <b>staff</b><h1>Head {n}</h1><p>{'Same words' if n < 5 else f'Other words {n}'}</p><p>Body {n} is long enough</p>end</article>" for n in range(8)]
    want = [f"Head {n}\n" + (f"Other words {n}\n" if n >= 5 else "") + f"Body {n} is long enough" for n in range(8)]
    assert _texts(spark, bodies) == want


def test_all_varying_text_is_content(spark):
    """Leads and headlines beside the longest part stay, and names of what wraps most of the text leave nothing out."""
    long = " ".join(["word"] * 60)
    main = '<div id="top"><p>Our site</p></div><div id="main"><h1>Head {n}</h1><div class="lead">Lead {n}</div><div class="body"><p>Body {n} {long}</p></div></div>'
    wrapped = '<div class="page with-sidebar menu-open"><div class="sidebar">Links {n}</div>{main}</div>'
    fill = lambda body, n: body.replace("{main}", main).replace("{n}", str(n)).replace("{long}", long)
    want = [f"Head {n}\nLead {n}\nBody {n} {long}" for n in range(6)]
    assert _texts(spark, [fill("{main}", n) for n in range(6)]) == want
    assert _texts(spark, [fill(wrapped, n) for n in range(6)]) == want
    assert _texts(spark, [fill(wrapped, 0)]) == ["Our site\n" + want[0]]
    # only some pages have the wrapper
    assert _texts(spark, [fill(wrapped if n % 2 else "{main}", n) for n in range(6)])[1::2] == [f"Our site\n{x}" for x in want[1::2]]
    # a comment section beside a longer article stays out
    assert _texts(spark, [fill('{main}<div class="comments"><p>I agree {n}</p></div>', n) for n in range(6)]) == want


# ---- language model ----------------------------------------------------------------


def _plain_ctw(train, text):
    """log10 probability by plain recursion over context trees with the counts of `train`."""
    counts = {}
    for t in train:
        data = b"\n" * lm.DEPTH + t
        for i in range(lm.DEPTH, len(data)):
            for k in range(8):
                node = (1 << k) | (data[i] >> (8 - k))
                for d in range(lm.DEPTH + 1):
                    key = (data[i - d : i], node)
                    counts.setdefault(key, [0, 0])[(data[i] >> (7 - k)) & 1] += 1
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[1:], node), []).append((context, node))
    memory = {}

    def kt(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    def weighted(key):
        if key not in memory:
            own = kt(*counts[key])
            below = sum(weighted(c) for c in children.get(key, ()))
            memory[key] = own if len(key[0]) == lm.DEPTH else np.logaddexp(own, below) - math.log(2)
        return memory[key]

    def one(data, i, node, d=0):
        key = (data[i - d : i], node)
        if key not in counts:
            return 0.5
        n0, n1 = counts[key]
        p = (n1 + 0.5) / (n0 + n1 + 1)
        if d == lm.DEPTH:
            return p
        stop = math.exp(kt(n0, n1) - math.log(2) - weighted(key))
        return stop * p + (1 - stop) * one(data, i, node, d + 1)

    data, total = b"\n" * lm.DEPTH + text, 0.0
    for i in range(lm.DEPTH, len(data)):
        for k in range(8):
            p = one(data, i, (1 << k) | (data[i] >> (8 - k)))
            total += math.log10(p if (data[i] >> (7 - k)) & 1 else 1 - p)
    return total


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    rng = random.Random(4)
    texts = [None, "", " \t", "One", "Ünï cödé  words\nhere"] + [_words(rng, rng.randrange(1, 60), 20) for _ in range(35)]
    rows = [(i, t, "x", 0.0) for i, t in enumerate(texts)] + [(3, "one", "x", 0.0), (None, "no id", "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, token string, score double").repartition(2)
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, *_ in rows}
    coded = [(i, *lm.coded(t)) for i, t, *_ in rows]
    train = [t for i, _, t in coded if not held[i]]
    counts = {}
    for i, words, _ in coded:
        if not held[i]:
            for w in [*words, b""]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, words, text in coded:
        c = [counts.get(w, 0) for w in [*words, b""]]
        base = sum(math.log10((x + 1) / (n + 1 * (v + 1))) for x in c)
        want.append((i, held[i], len(c), sum(x > 0 for x in c), n, round(base, 6), round(_plain_ctw(train, text), 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.scored(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lm.scored(docs.where("false")).count() == 0


def test_grams_by_sorting():
    """Training counts from marked grams sorted in several portions, and numbers of grams, against plain counts."""
    rng = np.random.default_rng(5)
    portions = [(rng.integers(0, 1 << 56, 40)[rng.integers(0, 40, n)], rng.integers(0, 2, n)) for n in (500, 300, 1, 0)]
    keys, n = lm._merged([lm._tallied([g << 1 | known]) for g, known in portions])
    want = {}
    for g, known in portions:
        for x, k in zip(g.tolist(), known.tolist(), strict=True):
            want[x] = want.get(x, 0) + k
    assert list(zip(keys.tolist(), n.tolist(), strict=True)) == sorted(want.items())
    numbered = [lm._numbered(g) for g, _ in portions]
    assert all((distinct[codes] == g).all() for (codes, distinct), (g, _) in zip(numbered, portions, strict=True))
    assert (lm._distinct([distinct for _, distinct in numbered]) == keys).all()


def test_blocks_sorted_in_portions(spark, monkeypatch):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, _words(rng, 80, 40)) for i in range(40)], "doc_id bigint, text string").coalesce(1)
    whole = sorted(map(tuple, lm.scored(docs).collect()))
    monkeypatch.setattr(lm, "PART_BYTES", 300)
    monkeypatch.setattr(lm, "SORTED", 1000)
    for got, want in zip(sorted(map(tuple, lm.scored(docs).collect())), whole, strict=True):
        assert got == pytest.approx(want)


def test_columns_are_coded_like_texts():
    """Words and coded bytes of a column against the plain ones, white space of all kinds and letters beyond ASCII among them."""
    texts = [None, "", " \t\x0b\x0c\r\n", "One", " TWO  words\n", "\x1c\x85\u00a0 \u2003Ä ÉÀ\u0130", "a\x00b  \x7f", "x " * 300]
    words, sizes, ended = lm.coded_column(pa.array(texts, pa.string()))
    want = [lm.coded(t) for t in texts]
    assert np.split(np.array(words.to_pylist(), object), sizes.cumsum()[:-1])[-1].tolist() == want[-1][0]
    assert words.to_pylist() == [w for own, _ in want for w in own]
    assert sizes.tolist() == [len(own) for own, _ in want] and ended == [t for _, t in want]
    codes, distinct = lm._coded_words([words, words.slice(0, 0), words.slice(0, 3)])
    assert distinct[0].as_py() == b"" and [distinct.take(pa.array(c)).to_pylist() for c in codes] == [words.to_pylist(), [], words.to_pylist()[:3]]
    order, own, begins = lm._words_by_bucket(distinct, 3)
    buckets = [[w.as_py() for w in distinct.take(pa.array(part))] for part in np.split(order, begins[1:])]
    assert buckets == [sorted(w for w in distinct.to_pylist() if zlib.crc32(w) % 3 == b) for b in own]


def test_grams_of_texts_by_one_sort():
    """Grams of several texts, numbered with the text of each occurrence, against plain counts; the highest bits are in use."""
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 30, lm.OWNERS)
    grams = rng.integers(0, 1 << 56, 50)[rng.integers(0, 50, sizes.sum())]
    grams[:2] = (1 << 56) - 1
    distinct, often, owners = lm._owned(grams, sizes)
    got = sorted(zip(np.repeat(distinct, often).tolist(), owners.tolist(), strict=True))
    assert got == sorted(zip(grams.tolist(), np.repeat(np.arange(lm.OWNERS), sizes).tolist(), strict=True))
    assert distinct.tolist() == sorted(set(grams.tolist()))


def test_more_texts_than_one_step_scores(spark):
    """Texts of a block beyond OWNERS, equal ones and empty ones among them, score what they score in any other order."""
    rng = random.Random(10)
    rows = [(i, None if i % 97 == 0 else _words(rng, i % 7, 12)) for i in range(2 * lm.OWNERS + 30)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got, want = ({r.doc_id: tuple(r) for r in lm.scored(frame(x)).collect()} for x in (rows, rows[::-1]))
    assert len(got) == len(rows) and all(got[i] == pytest.approx(want[i]) for i in want)


def test_contexts_beyond_four_bytes(spark):
    """A byte that only the fifth and sixth byte before it tell is learnt, over several buckets as over one."""
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["axbbbbx", "aybbbby", "xcddddx", "ycddddy"]) for _ in range(60))
    docs = spark.createDataFrame([(i, text()) for i in range(60)], "doc_id bigint, text string").repartition(2)
    whole = {r.doc_id: r.bits_per_byte for r in lm.scored(docs).collect()}
    # two bits a word of eight bytes are all there is to tell
    assert max(whole.values()) < 0.3
    size, lm.BUCKET = lm.BUCKET, 20
    try:
        parts = {r.doc_id: r.bits_per_byte for r in lm.scored(docs).collect()}
    finally:
        lm.BUCKET = size
    assert parts == pytest.approx(whole)


# ---- pipeline ----------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    items = [(0, " ".join(f"bench{k}" for k in range(30)))]
    clean = {i: "\n".join(_words(rng, 60, 5000) for _ in range(4)) for i in range(40)}
    rows = [(i, t, "en", "s", len(t)) for i, t in clean.items()]
    rows += [(100, clean[3], "en", "s", 1), (101, clean[4] + " tail", "en", "s", 1), (102, _words(rng, 50, 5000) + " " + items[0][1], "en", "s", 1)]
    insults = "grumblefoot snortwhelp vilecreature grumblefoot"
    rows += [(200 + k, f"{_words(rng, 40, 5000)} {insults}", "en", "s", 1) for k in range(30)]
    labels = [(i, 0, 1) for i in range(40)] + [(200 + k, 1, 1) for k in range(30)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # the near copy keeps its changed line only, which is a text of its own
    assert set(got) - {101} == set(range(40))
    assert all(got[i].decoded_sha256 == hashlib.sha256(clean[i].encode()).hexdigest() for i in range(40))


def test_toxicity_learns_from_all_labelled_rows(spark):
    docs = spark.range(21_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    known = spark.range(21_000).selectExpr("id AS doc_id", "0 AS toxic")
    assert toxicity._labelled(docs, known).count() == 21_000


@pytest.mark.parametrize("first, counted, most", [(1 << 15, 200_000, 200_000), (40, 30, 20), (400, 30, 0)])
def test_toxicity_counts_equal_plain_ones(spark, labelled, monkeypatch, first, counted, most):
    """Both trainings of one set of passes against plain counts, with few, some and all fragments counted in ordinary rows."""
    monkeypatch.setattr(toxicity, "FIRST", first)
    monkeypatch.setattr(toxicity, "COUNTED", counted)
    monkeypatch.setattr(toxicity.runtime, "BROADCAST_ROWS", most)
    docs, labels = labelled
    texts = docs.where("doc_id < 400").dropDuplicates(["doc_id"])
    known = labels.where("toxic IS NOT NULL").selectExpr("doc_id", "toxic", "CAST(doc_id % 3 = 0 AS INT) AS part")
    rows = toxicity._labelled(texts.select("doc_id", "text"), known)
    plain = [(r.toxic, r.part, toxicity.lowered(r.text).split()) for r in rows.collect()]
    assert len(plain) == known.count()
    for got, most_part in zip(toxicity._contents(rows), (0, 1), strict=True):
        mine = [(t, set(words)) for t, part, words in plain if part <= most_part]
        n = [sum(t == label for t, _ in mine) for label in (0, 1)]
        counts = [toxicity.Counter(x for t, words in mine if t == label for x in set().union(*map(toxicity._fragments, words))) for label in (0, 1)]
        weights = {}
        for x, a in counts[1].items():
            odds = math.log((a + 0.5) / (n[1] + 1)) - math.log((counts[0][x] + 0.5) / (n[0] + 1))
            if a >= toxicity.MIN_ROWS and odds > toxicity.MIN_LOG_ODDS:
                weights[x] = round(a * odds, 9)
        top = set(sorted(weights, key=lambda x: (-weights[x], x))[: toxicity.FRAGMENTS])
        parts = toxicity.Counter(p for t, words in mine if t for w in words for p in toxicity._covered(b" " + w + b" ", top))
        frequent = toxicity.Counter(b" " + w + b" " for t, words in mine if not t for w in words if not toxicity._covered(b" " + w + b" ", top))
        for content, items, limit in zip(got, (parts, frequent), (toxicity.TOXIC_BYTES, toxicity.ORDINARY_BYTES), strict=True):
            want = b""
            for x in sorted(items, key=lambda x: (-items[x], x))[: limit // min(toxicity.SIZES)]:
                want = x + want if len(want) + len(x) <= limit else want
            assert content == want


def test_toxicity_shuffles_few_texts_without_labels(spark, monkeypatch):
    """Beyond a broadcast, bitmaps of the ids keep all labelled rows and few of the others, so their texts are not shuffled."""
    docs = spark.range(40_000).selectExpr("id * 7919 - 5 AS doc_id", "CAST(id AS STRING) AS text")
    known = docs.where("text % 5 = 0").selectExpr("doc_id", "CAST(text % 2 AS INT) AS toxic")
    monkeypatch.setattr(toxicity.runtime, "BROADCAST_ROWS", 100)
    assert toxicity._labelled(docs, known).count() == 8_000
    perhaps = toxicity._perhaps(docs, known, 8_000)
    assert perhaps.join(known, "doc_id").count() == 8_000 and perhaps.count() < 8_000 + 0.2 * 32_000
