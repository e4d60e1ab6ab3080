"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

A line is cut into one segment more than the edits allowed, so of two lines within that distance
one has a whole segment of the other, at nearly the same place. Segments are indexed by line
length, number and content; a line probes the index of each length it may match with the few
substrings that can be that segment. Where many lines share a segment, masks of their characters
rule out most pairs in the join itself. Candidates are verified by a bit-parallel automaton that
follows only the band of diagonals within the distance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.llm.text import WORD, free_names
from precinct.runtime import cut, light, ranked, scratch, small, spread

EDITS = 2

# Shorter lines are not compared by edits: a few would turn many of them into each other. With
# `short_copies` they still go as exact copies, if they have a word.
MIN_CHARS = 20


def told_apart(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a column `name` that tells rows of one doc_id, and rows without one, apart.

    It is 0 where the id is a row's own. Other rows are numbered by a hash of their text and, if that
    is equal too, in the order in which the table is written for it.
    """
    ids = F.col("doc_id").cast("bigint")
    odd = cut(docs.groupBy(ids.alias("of")).agg(F.count("*").alias("n")).where("n > 1"))
    n_odd = odd.count()
    if not n_odd:
        return docs.withColumn(name, F.lit(0).cast("bigint"))
    (row,) = free_names([*docs.columns, name], "row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    narrow = rows.select(ids.alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.col(row).alias("row"))
    narrow = narrow.join(small(odd, n_odd), F.col("id").eqNullSafe(F.col("of")), "left_semi")
    narrow = narrow.withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("")))
    numbers = cut(ranked(narrow, ["hash", "row"], "number", within="id").select(F.col("row").alias(row), F.col("number").alias(name)))
    return rows.join(small(numbers, numbers.count()), row, "left").fillna(0, [name]).drop(row)


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, dup, text of the rows."""
    (dup,) = free_names(docs.columns, "dup")
    return _narrow(told_apart(docs, dup), dup)


def _narrow(rows: DataFrame, dup: str) -> DataFrame:
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(dup).alias("dup"), F.col("text").cast("string").alias("text"))


def _place() -> Column:
    """Where a line stands: by doc_id (null last), then `dup`, then line number, in one number of 126 bits."""
    wide = "decimal(38,0)"
    of = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    within = F.col("dup").cast("decimal(18,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")
    return (of * F.lit(str(1 << 62)).cast("decimal(19,0)")).cast(wide) + within.cast(wide)


def _occurrences(plain: DataFrame, min_chars: int, short_copies: bool) -> DataFrame:
    """(doc_id, dup, line_no, line) of every line long enough to be compared, or with `short_copies` of every one with a word; lines end at \\n."""
    rows = plain.select("doc_id", "dup", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    long = F.char_length("line") >= min_chars
    return rows.where(long | F.col("line").rlike(WORD) if short_copies else long)


def distinct_lines(docs: DataFrame, min_chars: int = MIN_CHARS, short_copies: bool = False) -> DataFrame:
    """One row per distinct line: id, line, chars, n, and its first place as `rank`.

    Ranks order places by doc_id (null last), rows of one id by `told_apart`, and line number; a line
    of many copies collapses before the shuffle. The table is written, which fixes the ids.
    """
    return _distinct(_plain(docs), min_chars, short_copies)


def _distinct(plain: DataFrame, min_chars: int, short_copies: bool) -> DataFrame:
    rows = _occurrences(plain, min_chars, short_copies).select("line", _place().cast("decimal(38,0)").alias("rank"))
    found = rows.groupBy("line").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    return cut(found.withColumns({"id": F.monotonically_increasing_id(), "chars": F.char_length("line")}))


def _segment(chars: Column, number: Column, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of a segment (from 0); the last ones take the odd characters."""
    base, odd = F.floor(chars / (edits + 1)).cast("int"), (chars % (edits + 1)).cast("int")
    plain = edits + 1 - odd  # segments of the base length come first
    return base * number + F.greatest(number - plain, F.lit(0)), base + (number >= plain).cast("int")


def _keys(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """id and `keys` of each line: (key, probe) of each segment (probe false) and of each further substring that may be one (true)."""
    own, others = [], []
    for shorter in range(edits + 1):
        for number in range(edits + 1):
            # a first common segment has at most `number` edits before it and the others behind it
            left = max(-number, shorter - (edits - number))
            right = min(number, shorter + (edits - number))
            for shift in range(left, right + 1):
                place = F.struct(F.lit(number).alias("number"), F.lit(shorter).alias("shorter"), F.lit(shift).alias("shift"))
                (others if shorter or shift else own).append(place)

    def hashed(code: Column, places: list[Column]) -> Column:
        def key(at: Column) -> Column:
            chars = F.col("chars") - at["shorter"]
            start, length = _segment(chars, at["number"], edits)
            start = start + at["shift"]
            fits = (chars >= min_chars) & (start >= 0) & (start + length <= F.col("chars"))
            return F.when(fits, F.xxhash64(chars, at["number"], F.substring(code, start * 4 + 1, length * 4)))

        return F.transform(F.array(*places), key)

    def both(code: Column) -> Column:
        pair = F.struct(hashed(code, own).alias("own"), hashed(code, others).alias("others"))
        return _bound(pair, lambda x: F.concat(
            F.transform(x["own"], lambda k: F.struct(k.alias("key"), F.lit(False).alias("probe"))),
            F.transform(F.array_compact(F.array_except(x["others"], x["own"])), lambda k: F.struct(k.alias("key"), F.lit(True).alias("probe"))),
        ))

    # four bytes a character, so that a substring is cut out without counting characters
    keys = _bound(F.encode("line", "UTF-32"), both)
    return lines.select("id", keys.alias("keys"))


def _traits(line: Column) -> Column:
    """Two bit masks of a line: the parities of its characters and of its pairs of neighbours, by hash."""

    def mask(buckets: Column) -> Column:
        one = F.lit(1).cast("bigint")
        return F.aggregate(buckets, F.lit(0).cast("bigint"), lambda m, k: m.bitwiseXOR(F.call_function("shiftleft", one, k.cast("int"))))

    def both(chars: Column) -> Column:
        pairs = F.transform(chars, lambda c, i: F.pmod(F.xxhash64(c, F.get(chars, i + 1)), F.lit(64)))
        return F.struct(mask(F.transform(chars, lambda c: F.pmod(F.xxhash64(c), F.lit(64)))).alias("chars"), mask(pairs).alias("pairs"))

    return _bound(F.split(line, ""), both)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once, however often `use` mentions it."""
    return F.transform(F.array(value), use)[0]


def _alike(edits: int) -> Column:
    """Whether the masks of lines `a` and `b` allow `edits`.

    An edit changes the parity of at most two characters (one, if it changes the length) and of
    at most four pairs of neighbours.
    """
    apart = F.abs(F.col("a.chars") - F.col("b.chars"))
    chars = F.bit_count(F.col("a.traits.chars").bitwiseXOR(F.col("b.traits.chars")))
    pairs = F.bit_count(F.col("a.traits.pairs").bitwiseXOR(F.col("b.traits.pairs")))
    return (apart <= edits) & (chars <= 2 * edits - apart) & (pairs <= 4 * edits)


def candidates(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b) ids, a < b, of distinct lines that share a segment; every pair within `edits` is among them.

    Keys are first counted, with partial counts before the shuffle. A key of two lines is their
    pair. Lines under a key of more are joined within it, on condition that their masks allow the
    edits, so variants of one long line that only share a segment make no pairs.
    """
    # worked out once and written, as they are read twice: to count them, and to join those of several lines
    keys = cut(_keys(lines, edits, min_chars)).select("id", F.explode("keys").alias("k")).select("k.key", "id", "k.probe")
    found = keys.groupBy("key").agg(
        F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.bool_and("probe").alias("probes")
    )
    shared = cut(found.where("n > 1 AND NOT probes"))
    two = shared.where("n = 2").select("a", "b")
    more = shared.where("n > 2").select("key")
    rows = cut(keys.join(small(more, more.count()), "key"))
    ids = cut(rows.select("id").distinct())
    traits = cut(lines.join(small(ids, ids.count()), "id", "left_semi").select("id", "chars", _traits(F.col("line")).alias("traits")))
    rows = cut(rows.join(traits, "id"))
    a, b = rows.alias("a"), rows.where("NOT probe").alias("b")
    other = (F.col("a.id") < F.col("b.id")) | (F.col("a.probe") & (F.col("a.id") != F.col("b.id")))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & other & _alike(edits))
    pairs = pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
    return two.unionByName(pairs).distinct()


def _common(a: Column, b: Column, most: Column) -> Column:
    """The length of the common start of two texts, up to `most`, by halving steps."""
    steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))

    def further(done: Column, step: Column) -> Column:
        same = (step <= most - done) & (F.substring(a, done + 1, step) == F.substring(b, done + 1, step))
        return F.when(same, done + step).otherwise(done)

    return F.aggregate(steps, F.lit(0), further)


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two texts are within `edits` insertions, deletions and replacements of code points.

    Their common start and end change nothing and are left out before the automaton runs.
    """

    def middle(x: Column) -> Column:
        most = F.least(F.char_length(x["a"]), F.char_length(x["b"]))
        return _bound(
            F.struct(x["a"], x["b"], _common(x["a"], x["b"], most).alias("start")),
            lambda y: _bound(
                F.struct(y["a"], y["b"], y["start"], _common(F.reverse(y["a"]), F.reverse(y["b"]), most - y["start"]).alias("end")),
                lambda z: _bound(
                    F.struct(*(F.substring(z[c], z["start"] + 1, F.char_length(z[c]) - z["start"] - z["end"]).alias(c) for c in ("a", "b"))),
                    lambda m: _near(m["a"], m["b"], edits),
                ),
            ),
        )

    near = _bound(F.struct(a.alias("a"), b.alias("b")), middle)
    return F.when(F.abs(F.char_length(a) - F.char_length(b)) <= edits, near).otherwise(F.lit(False))


def _near(a: Column, b: Column, edits: int) -> Column:
    chars = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), F.char_length(a).alias("n"), F.char_length(b).alias("m"))
    near = _bound(chars, lambda x: near_chars(x["a"], x["b"], x["n"], x["m"], edits))
    return F.when(F.char_length(b) == 0, F.char_length(a) <= edits).otherwise(near)


def near_chars(left: Column, right: Column, n_left: Column, n_right: Column, edits: int = EDITS) -> Column:
    """The same for arrays of characters, the second not empty; give stored arrays, as each step reads them.

    Row d of the automaton is a bit mask over the diagonals -edits..edits that d edits reach.
    Reading one character of `right` moves all diagonals of a row at once: along matches, by a
    replacement or an inserted character from the row above, and by a deleted one from the new
    row above.
    """
    width = 2 * edits + 1
    every = (1 << width) - 1

    def down(above: Column) -> Column:
        return F.shiftleft(above, 1)

    rows = [F.lit(1 << edits)]
    for _ in range(edits):
        rows.append(rows[-1].bitwiseOR(down(rows[-1])).bitwiseAND(F.lit(every)))
    names = [f"r{d}" for d in range(edits + 1)]
    start = F.struct(*(r.cast("int").alias(n) for r, n in zip(rows, names, strict=True)))

    def read(row: Column, at: Column) -> Column:
        char = F.get(right, at)
        match = F.lit(0)
        for k in range(width):
            same = F.coalesce(F.get(left, at + (k - edits)) == char, F.lit(False))
            match = match.bitwiseOR(F.when(same, F.lit(1 << k)).otherwise(F.lit(0)))
        # the match mask is worked out once and handed to the rows as a one-element array
        return F.transform(F.array(match), lambda m: _stepped(row, m, names, every))[0]

    final = n_left - n_right + edits
    last = F.aggregate(F.sequence(F.lit(0), n_right - 1), start, read)[names[-1]]
    reached = F.call_function("shiftright", last, final.cast("int")).bitwiseAND(F.lit(1)) == 1
    return (F.abs(n_left - n_right) <= edits) & reached


def _stepped(row: Column, match: Column, names: list[str], every: int) -> Column:
    new: list[Column] = []
    for d, name in enumerate(names):
        state = row[name].bitwiseAND(match)
        if d:
            above = row[names[d - 1]]
            state = state.bitwiseOR(above).bitwiseOR(F.shiftright(above, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
        new.append(state.bitwiseAND(F.lit(every)))
    return F.struct(*(x.cast("int").alias(n) for x, n in zip(new, names, strict=True)))


def links(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b) ids, a < b, of exactly the pairs of distinct lines within `edits`."""
    pairs = cut(candidates(lines, edits, min_chars))
    ids = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    # only lines that take part are read again; their number decides between broadcast and shuffle
    texts = cut(lines.join(small(ids, ids.count()), "id", "left_semi").select("id", "line"))
    pairs = pairs.join(texts.withColumnsRenamed({"id": "a", "line": "left"}), "a")
    pairs = spread(pairs.join(texts.withColumnsRenamed({"id": "b", "line": "right"}), "b"), "a", "b")
    return cut(pairs.where(within(F.col("left"), F.col("right"), edits)).select("a", "b"))


def _judged(plain: DataFrame, edits: int, min_chars: int, short_copies: bool) -> DataFrame:
    """The distinct lines with `n_links`, the lines within `edits`, and `first`: none of them comes earlier."""
    lines = _distinct(plain, min_chars, short_copies)
    pairs = links(lines.where(F.col("chars") >= min_chars), edits, min_chars)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ranks = lines.select(F.col("id").alias("b"), F.col("rank").alias("other"))
    linked = both.join(ranks, "b").groupBy("a").agg(F.count("*").alias("n_links"), F.min("other").alias("lowest"))
    joined = lines.join(linked.withColumnRenamed("a", "id"), "id", "left")
    return joined.select(
        "id", "line", "n", "rank",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce(F.col("lowest") > F.col("rank"), F.lit(True)).alias("first"),
    )


def _removed(plain: DataFrame, edits: int, min_chars: int, short_copies: bool) -> DataFrame:
    """(doc_id, dup, removed, n_linked): for rows with such lines, the sorted numbers of those that go.

    A line goes when the same line stands at an earlier place, or when a line within `edits` of
    it stands first at an earlier place. n_linked counts the row's lines that have links.
    """
    spark = plain.sparkSession
    with scratch(spark):
        lines = _judged(plain, edits, min_chars, short_copies).where("n > 1 OR n_links > 0")
        # a digest stands for the text, so what is sent to all tasks is some 60 bytes a line
        digest = F.md5(F.col("line").cast("binary"))
        lines = cut(lines.select(digest.alias("digest"), "rank", "n_links", "first"))
        rows = _occurrences(plain, min_chars, short_copies).withColumn("digest", digest)
        rows = rows.join(small(lines, lines.count()), "digest")
        gone = ~F.col("first") | (_place() > F.col("rank"))
        found = rows.groupBy("doc_id", "dup").agg(
            F.sort_array(F.collect_set(F.when(gone, F.col("line_no")))).alias("removed"),
            F.countDistinct(F.when(F.col("n_links") > 0, F.col("line_no"))).alias("n_linked"),
        )
        return cut(found, keep=True)


def report(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short_copies: bool = False) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_linked, removed (line numbers from 0).

    Null and empty texts have no lines to remove. Every row counts by itself, whether or not its
    doc_id is null or repeats; rows without one come last, rows of one id in the order of
    `told_apart`, so of equal rows one keeps its lines. An empty table gives no rows. Other
    columns, of whatever names, are ignored.
    """
    plain = _plain(docs)
    lines = F.greatest(F.coalesce(F.size(F.split("text", "\n")), F.lit(0)), F.lit(0))
    rows = plain.select("doc_id", "dup", lines.cast("bigint").alias("n_lines"))
    found = _removed(plain, edits, min_chars, short_copies).withColumnsRenamed({"doc_id": "of", "dup": "number"})
    whole = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("dup") == F.col("number")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return whole.select("doc_id", "n_lines", F.size(removed).cast("bigint").alias("n_removed"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), removed.alias("removed"))


def without_repeats(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short_copies: bool = False) -> DataFrame:
    """The documents, all columns, without the lines that go.

    A document of which all lines with a word went goes too; others, null and empty texts included,
    stay. Rows, ids and other columns as in `report`.
    """
    dup, of, number, gone, new = free_names(docs.columns, "dup", "of", "number", "gone", "new")
    rows = told_apart(docs, dup)
    found = _removed(_narrow(rows, dup), edits, min_chars, short_copies).where("size(removed) > 0")
    weight = found.agg(F.sum(64 + 4 * F.size("removed"))).first()[0] or 0
    found = found.select(F.col("doc_id").alias(of), F.col("dup").alias(number), F.col("removed").alias(gone))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(of)) & (F.col(dup) == F.col(number))
    whole = rows.join(light(found, weight), same, "left")
    kept = F.filter(F.split(F.col("text").cast("string"), "\n"), lambda x, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    emptied = F.col(gone).isNotNull() & ~F.coalesce(F.col(new).rlike(WORD), F.lit(False))
    whole = whole.withColumn(new, text).where(~emptied)
    return whole.select(*(F.col(new).alias(c) if c == "text" else F.col(c) for c in docs.columns))
