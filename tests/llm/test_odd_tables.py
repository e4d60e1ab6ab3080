"""Pages under unlucky names, and stages on tables with clashing columns or no rows."""

import pytest

import corpus_pipeline
from precinct.llm import decontaminate, html, lines, simhash, toxicity
from precinct.llm.text import free_names

BODY = ["The quick brown fox {0} jumps over the lazy dog and runs away into the deep forest.", "Its owner {0} looked for it for days."]


def _texts(spark, wrap, n=6):
    """What is found on pages of one host whose body stands in `wrap`."""
    bodies = ["".join(f"<p>{p.format('x' * (i + 1))}</p>" for p in BODY) for i in range(n)]
    rows = [(i, f"http://h/{i}", f"<html><body><div class=nav>Home</div>{wrap.format(b, i)}</body></html>") for i, b in enumerate(bodies)]
    got = html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    want = {i: "\n".join(p.format("x" * (i + 1)) for p in BODY) for i in range(n)}
    return {r.page_id: r.text for r in got}, want


WORDS = "share related sidebar notice widget promo banner sponsored ad social".split()


@pytest.mark.parametrize("words", [WORDS[:5], WORDS[5:]])
def test_an_unlucky_class_does_not_outvote_an_article(spark, words):
    for word in words:
        got, want = _texts(spark, '<article><h1>Title</h1><div class="entry-content ' + word + '-on">{0}</div></article>')
        assert all(got[i].endswith(want[i]) for i in want), word


def test_sections_forms_and_boxes(spark):
    section = '<article><p>First of all.</p>{0}<section class="related-work"><p>What others did before, told at some length in paper {1}.</p></section></article>'
    got, _ = _texts(spark, section)
    assert all("What others did before" in t for t in got.values())
    got, want = _texts(spark, "<form id=aspnetForm>{0}</form>")
    assert got == want
    box = '<article>{0}<div class=related><a href=x>Read the other long story about foxes and dogs</a></div><div class=share>Share</div><form>Mail</form></article>'
    got, want = _texts(spark, box)
    assert got == want
    talk = "<article>{0}<div class=comments><p>" + "A reader has much to say about all this. " * 20 + "</p></div></article>"
    got, want = _texts(spark, talk)
    assert got == want


CLASH = "_removed _of _found _text _first _fp _row _doc_id dup of number gone new found at same mine row fp th key".split()


def _stages(spark, docs):
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "a passage of the test that has more than thirteen words in it as it must have here")], "item_id bigint, text string")
    yield "toxicity", lambda d: toxicity.without_toxic(d, labels)
    yield "lines", lambda d: lines.without_repeats(d, short_copies=True)
    yield "simhash", simhash.one_per_class
    yield "decontamination", lambda d: decontaminate.without_benchmark(d, items)


def test_clashing_columns_and_empty_tables(spark):
    texts = ["awful nasty words here" if i % 3 == 0 else f"a calm text number {i} about the weather and the sea" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, ""), (None, texts[1]), (3, texts[3]), (3, "another text of the same id")]
    plain = spark.createDataFrame([(*r, "en", "web", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    clashing = plain.selectExpr("*", *[f"'kept' AS `{c}`" for c in CLASH])
    for name, stage in _stages(spark, plain):
        want = sorted(stage(plain).select("doc_id", "text").collect(), key=str)
        got = stage(clashing)
        assert got.columns == clashing.columns, name
        assert sorted(got.select("doc_id", "text").collect(), key=str) == want, name
        assert {tuple(r) for r in got.select(*[f"`{c}`" for c in CLASH]).distinct().collect()} <= {("kept",) * len(CLASH)}, name
        none = stage(clashing.limit(0))
        assert none.columns == clashing.columns and none.count() == 0, name


def test_the_pipeline_on_an_empty_table(spark, tmp_path):
    for name, schema in (
        ("documents", "doc_id bigint, text string, lang string, source string, n_chars int"),
        ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_free_names():
    assert free_names(["a", "_A", "b"], "a", "c", "c") == ["__a", "c", "_c"]
