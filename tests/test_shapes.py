"""WKT of every kind, malformed texts, and centres."""

import pytest
from pyspark.sql import functions as F

from precinct.functions import shapes
from precinct.sources import store

# text -> (kind, points of each ring of each part, centre)
GOOD = {
    "POINT (1 2)": ("POINT", [[1]], (1, 2)),
    "point z(1 2 3)": ("POINT", [[1]], (1, 2)),
    "LINESTRING (0 0, 4 0)": ("LINESTRING", [[2]], (2, 0)),
    "LINESTRING (0 0, 4 0, 4 2)": ("LINESTRING", [[3]], (8 / 3, 1 / 3)),
    "LINESTRING (3 1, 3 1)": ("LINESTRING", [[2]], (3, 1)),
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))": ("POLYGON", [[5]], (2, 2)),
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 2 0, 2 4, 0 4, 0 0))": ("POLYGON", [[5, 5]], (3, 2)),
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 0 4, 2 4, 2 0, 0 0))": ("POLYGON", [[5, 5]], (3, 2)),
    "POLYGON ((0 0, 2 0, 4 0, 0 0))": ("POLYGON", [[4]], (2, 0)),
    "MULTIPOINT (1 2, 3 4)": ("MULTIPOINT", [[1], [1]], (2, 3)),
    "MULTIPOINT ((1 2), ( 3 4 ), (8 0))": ("MULTIPOINT", [[1], [1], [1]], (4, 2)),
    "MULTIPOINT (1 2)": ("MULTIPOINT", [[1]], (1, 2)),
    "MULTILINESTRING ((0 0, 2 0), (0 1, 0 7))": ("MULTILINESTRING", [[2], [2]], (0.25, 3)),
    "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((10 0, 12 0, 12 2, 10 2, 10 0)))": ("MULTIPOLYGON", [[5], [5]], (6, 1)),
    " MultiPolygon(((-1e0 -.5,1. -.5,1 +0.5,-1 .5,-1e0 -.5)))\n": ("MULTIPOLYGON", [[5]], (0, 0)),
    "POLYGON EMPTY": ("POLYGON", [], None),
    "MULTIPOINT EMPTY": ("MULTIPOINT", [], None),
}
BAD = [
    None, "", "nan", "POINT", "POINT (1)", "POINT (1 x)", "POINT (1 2, 3 4)", "POINT (1 2 3 4 5)", "POINT ()", "POINT ((1 2))",
    "LINESTRING (0 0)", "LINESTRING (0 0, 1)", "LINESTRING (0 0,, 1 1)", "LINESTRING (0 0, 1 1,)", "LINESTRING ((0 0, 1 1))",
    "LINESTRING (0 0, 1 1), (2 2, 3 3)", "POLYGON (0 0, 4 0, 4 4, 0 0)", "POLYGON ((0 0, 4 0, 4 4))", "POLYGON ((0 0, 4 0, 4 4, 1 1))",
    "POLYGON ((0 0, 4 0, 4 4, 0 0)", "POLYGON ((0 0, 4 0, 4 4, 0 0)) ((0 0, 4 0, 4 4, 0 0))", "POLYGON ((0 0, 4 0, 4 4, 0 0)), ((0 0, 4 0, 4 4, 0 0))",
    "MULTIPOLYGON ((0 0, 4 0, 4 4, 0 0))", "MULTIPOINT ()", "MULTIPOINT ((1 2) (3 4))", "MULTIPOINT (((1 2)))",
    "GEOMETRYCOLLECTION (POINT (1 2))", "CIRCLE (1 2)",
]


@pytest.fixture(scope="module")
def read(spark):
    texts = [*GOOD, *BAD]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    df = df.withColumn("shape", shapes.from_wkt("t")).withColumn("c", shapes.centre("shape"))
    return {texts[r.i]: r for r in df.collect()}


@pytest.mark.parametrize("text", GOOD)
def test_shape_and_centre(read, text):
    kind, sizes, centre = GOOD[text]
    got = read[text]
    assert got.shape.kind == kind and [[len(ring) for ring in part] for part in got.shape.parts] == sizes
    assert got.c == centre if centre is None else (got.c.x, got.c.y) == pytest.approx(centre)


@pytest.mark.parametrize("text", BAD)
def test_malformed_text_is_null(read, text):
    assert read[text].shape is None and read[text].c is None


def test_long_ring_and_small_shape_far_away(spark):
    n, side = 20000, 1e-5
    ring = [(i / n, 0) for i in range(n)] + [(1, i / n) for i in range(n)] + [(1 - i / n, 1) for i in range(n)] + [(0, 1 - i / n) for i in range(n + 1)]
    text = "POLYGON ((" + ", ".join(f"{-74 + x * side!r} {40 + y * side!r}" for x, y in ring) + "))"
    c = spark.createDataFrame([(text,)], "t string").select(shapes.centre(shapes.from_wkt("t")).alias("c")).first().c
    assert c.x == pytest.approx(-74 + side / 2, abs=1e-9) and c.y == pytest.approx(40 + side / 2, abs=1e-9)


def test_stored_shapes_stand_at_their_centre(spark):
    rows = spark.createDataFrame([(1, "POINT (1 2)"), (2, "LINESTRING (0 0, 4 0)"), (3, None), (4, "POLYGON EMPTY")], "id int, area_wkt string")
    got = {r.id: r.geometry for r in store.with_geometry(rows).collect()}
    assert (got[1].x, got[1].y, got[2].x, got[2].y, got[3], got[4]) == (1, 2, 2, 0, None, None)


def test_area_centre_of_degenerate_polygons(spark):
    kind = "array<array<array<struct<x:double,y:double>>>>"
    got = spark.range(1).select(*[shapes.area_centre(F.lit(None).cast(kind) if v is None else F.from_json(F.lit(v), kind)).alias(f"c{i}") for i, v in enumerate([None, "[]", "[[]]", "[[[]]]"])]).first()
    assert list(got) == [None] * 4


def test_a_text_is_matched_once(spark):
    df = spark.createDataFrame([("LINESTRING (0 0, 2 0)",)], "t string").select(shapes.from_wkt(F.concat("t", F.lit(""))).alias("s"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == 2 and plan.count("concat(t") == 1 and plan.count("from_json") == 1
    assert df.first().s.kind == "LINESTRING"
