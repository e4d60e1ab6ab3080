"""Geometries beyond points as column expressions: WKT of lines, polygons and their multiples, and centres.

A shape is struct<kind, parts>, where parts holds parts of rings of points: a polygon is a part with
its outer ring first, a line a part of one ring, a point a part of one ring of one point.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from precinct.functions.geo import NUMBER, col

# How many levels of brackets a kind's text lacks to be parts of rings of points.
_MISSING_LEVELS = {
    "POINT": 2, "LINESTRING": 2, "MULTIPOINT": 2, "POLYGON": 1, "MULTILINESTRING": 1, "MULTIPOLYGON": 0,
}
_TEXT = rf"(?i)^\s*({'|'.join(_MISSING_LEVELS)})\s*(?:ZM|Z|M)?(?:\s*(\([-+0-9.eE,()\s]*\))|\s+EMPTY)\s*$"
_POSITION = rf"({NUMBER})\s+({NUMBER})(?:\s+{NUMBER}){{0,2}}"


def from_wkt(text: Column | str) -> Column:
    """The shape of a WKT text in any case, null if it is blank, malformed or a collection.

    Third and fourth coordinates are dropped; EMPTY gives no parts. A line needs two points, a
    ring four of which the last is the first. Positions become JSON pairs and brackets JSON arrays, so
    that Spark's own parser checks the nesting, however many points there are.
    """

    def matched(t: Column) -> Column:
        return F.struct(F.upper(F.regexp_extract(t, _TEXT, 1)).alias("kind"), F.regexp_extract(t, _TEXT, 2).alias("body"))

    # a lambda's body is evaluated as written, so that the text and its match are worked out before they are used
    return _once(_once(col(text), matched), lambda m: _shape(m["kind"], m["body"]))


def _shape(kind: Column, body: Column) -> Column:
    """The shape of a text's kind, "" if there is none, and the brackets after it."""
    body = F.when(kind == "MULTIPOINT", F.regexp_replace(body, rf"\(\s*({_POSITION})\s*\)(?=\s*[,)])", "$1")).otherwise(body)
    pairs = F.regexp_replace(body, _POSITION, '["$1","$2"]')
    levels = F.lit(0)
    for name, missing in _MISSING_LEVELS.items():
        levels = F.when(kind == name, missing).otherwise(levels)
    nested = F.concat(F.repeat(F.lit("["), levels + 1), F.translate(pairs, "()", "[]"), F.repeat(F.lit("]"), levels + 1))
    parsed = F.from_json(nested, "array<array<array<array<array<string>>>>>")

    def read(wrapped: Column) -> Column:
        parts = F.get(wrapped, 0)
        points = F.flatten(F.flatten(parts))
        whole = (F.size(wrapped) == 1) & F.forall(points, lambda p: (F.size(p) == 2) & F.get(p, 1).isNotNull())
        whole &= kind.isin("MULTIPOLYGON") | (F.size(parts) == 1)
        whole &= kind.isin("POLYGON", "MULTIPOLYGON", "MULTILINESTRING") | (F.size(F.get(parts, 0)) == 1)
        rings = F.flatten(parts)
        long_enough = F.when(kind == "POINT", F.size(points) == 1).when(kind == "MULTIPOINT", F.size(points) > 0)
        long_enough = long_enough.when(kind.endswith("LINESTRING"), F.forall(rings, lambda r: F.size(r) > 1))
        closed = F.forall(rings, lambda r: (F.size(r) > 3) & (F.get(r, 0) == F.element_at(r, -1)))
        whole &= long_enough.otherwise(closed)
        places = F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, _place)))
        # several points or lines are parts of their own
        spots = F.transform(F.flatten(F.flatten(places)), lambda p: F.array(F.array(p)))
        lines = F.transform(F.flatten(places), lambda line: F.array(line))
        places = F.when(kind == "MULTIPOINT", spots).when(kind == "MULTILINESTRING", lines).otherwise(places)
        return F.when(whole, places)

    empty = F.array().cast("array<array<array<struct<x:double,y:double>>>>")
    parts = F.when(body == "", empty).otherwise(_once(parsed, read))
    return _once(parts, lambda p: F.when((kind != "") & p.isNotNull(), F.struct(kind.alias("kind"), p.alias("parts"))))


def centre(shape: Column | str) -> Column:
    """struct<x, y> of a shape's centroid, null for none or an empty one.

    Polygons weigh by area, holes taken away; lines by length; points count one each. A polygon
    without area counts as its lines, and lines without length as their first points.
    """

    def of(s: Column) -> Column:
        kind, parts = s["kind"], s["parts"]
        rings = F.flatten(parts)
        by_length = F.when(~kind.endswith("POINT"), _line_centre(rings))
        dots = F.transform(F.filter(rings, lambda r: F.size(r) > 0), lambda r: _weight(F.lit(1.0), F.get(r, 0)["x"], F.get(r, 0)["y"]))
        by_area = F.when(kind.endswith("POLYGON"), area_centre(parts))
        return F.coalesce(by_area, by_length, _mean(dots, F.lit(0.0), F.lit(0.0)))

    return _once(col(shape), of)


def area_centre(polygons: Column | str) -> Column:
    """struct<x, y> of polygons' centroid by area, holes taken away; null without area.

    Sums run from the first point, so that small shapes far from the origin keep their digits.
    """

    def of(parts: Column) -> Column:
        start = F.get(F.get(F.get(parts, 0), 0), 0)
        x0, y0 = start["x"], start["y"]

        def step(p: Column, q: Column) -> Column:
            twice = (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0)
            return _weight(twice / 2, (p["x"] + q["x"] - x0 * 2) * twice / 6, (p["y"] + q["y"] - y0 * 2) * twice / 6)

        def signed(ring: Column, n: Column) -> Column:
            # outer rings count, holes do not, whichever way round they are written
            return _once(_sums(_along(ring, step)), lambda s: _turned(s, F.signum(s["w"]) * F.when(n == 0, 1).otherwise(-1)))

        rings = F.flatten(F.transform(parts, lambda part: F.transform(part, signed)))
        return _mean(rings, x0, y0)

    return _once(col(polygons), of)


def _line_centre(rings: Column) -> Column:
    def step(p: Column, q: Column) -> Column:
        length = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
        return _weight(length, length * (p["x"] + q["x"]) / 2, length * (p["y"] + q["y"]) / 2)

    return _mean(F.flatten(F.transform(rings, lambda ring: _along(ring, step))), F.lit(0.0), F.lit(0.0))


def _place(pair: Column) -> Column:
    return F.struct(F.get(pair, 0).try_cast("double").alias("x"), F.get(pair, 1).try_cast("double").alias("y"))


def _along(ring: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What `step` gives for each two neighbouring points."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), step)


def _weight(w: Column, mx: Column, my: Column) -> Column:
    return F.struct(w.alias("w"), mx.alias("mx"), my.alias("my"))


def _turned(s: Column, sign: Column) -> Column:
    return _weight(s["w"] * sign, s["mx"] * sign, s["my"] * sign)


def _sums(weights: Column) -> Column:
    zero = _weight(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return F.aggregate(weights, zero, lambda t, s: _weight(t["w"] + s["w"], t["mx"] + s["mx"], t["my"] + s["my"]))


def _mean(weights: Column, x0: Column, y0: Column) -> Column:
    """The weighted mean place, from (x0, y0); null without weight."""
    at = lambda t: F.struct((x0 + t["mx"] / t["w"]).alias("x"), (y0 + t["my"] / t["w"]).alias("y"))
    return _once(_sums(weights), lambda t: F.when(t["w"] != 0, at(t)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)
