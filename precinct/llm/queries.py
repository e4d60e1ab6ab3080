"""One thin query per operator, over whole tables with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from precinct.llm import bpe, collocations, decontaminate, html, lines, lm, phrases, quality, simhash, topk, toxicity, warc
from precinct.llm import centroids as centroids_

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with SQL that gives the same rows where there is any."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql.strip()
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query()
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, the base rule, the verdict of policy v1 and the failure bits of each document."""
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base = ~quality.passes(quality.POLICIES["base"])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), quality.passes(quality.POLICIES["v1"]).alias("kept"), "fail_bits",
    )


@query()
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.encoded(table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN)


@query(
    """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
    ), g AS (SELECT d, n, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d, n)
    SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
        CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN top <> page_id THEN top END AS refers_to
    FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n
    """
)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the archives written of all pages."""
    folder = warc.new_folder(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of each document."""
    rows = simhash.near_classes(table(spark, sf_dir, "documents"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.select("doc_id", shown.alias("fingerprint"), "component_id")


@query()
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the passages that earlier documents have."""
    return phrases.without_repeats(table(spark, sf_dir, "documents"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document, learnt outside the held-out fold."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return html.main_text(table(spark, sf_dir, "pages"))


@query()
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that repeat an earlier line, up to a few edits."""
    return lines.report(table(spark, sf_dir, "documents"), short_copies=True)


@query()
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and context-tree scores of each document, learnt outside the held-out fold."""
    return lm.scored(table(spark, sf_dir, "documents"))


@query()
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each vector after ten rounds, with its distance, inertias and a digest of its centroid."""
    members, centroids = centroids_.lloyd(table(spark, sf_dir, "embeddings"))
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    digests = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # a row for each centroid
    sums = members.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    return members.join(F.broadcast(sums.join(digests, "cluster")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


@query(
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
    ), r AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """
)
def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best others of every 50th vector by integer inner product."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query(
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
            unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), words AS (
        SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
    ), grams AS (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM words, range(1, 6) t(k) WHERE len(w) >= k
    ), f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL),
    total AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    often AS MATERIALIZED (SELECT * FROM f WHERE c >= 100),
    covered AS (
        SELECT DISTINCT s.lang, s.phrase FROM often s JOIN (
            SELECT lang, c, k, unnest(list_transform(range(2, k), lambda j: list_transform(range(1, k - j + 2),
                lambda i: array_to_string(string_split(phrase, ' ')[i:i + j - 1], ' ')))) AS parts FROM often WHERE k > 2
        ) l ON l.lang = s.lang AND list_contains(l.parts, s.phrase) AND l.k > s.k AND 100 * l.c >= 100 * s.c
    ), cuts AS (
        SELECT lang, phrase, c AS a, k, unnest(range(1, k)) AS cut FROM often WHERE k > 1
            AND (lang, phrase) NOT IN (SELECT (lang, phrase) FROM covered)
    ), scored AS (
        SELECT cuts.lang, cuts.phrase, a, cut, x.c AS l, y.c AS r, n,
            CAST((1000 * CAST(a AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(x.c AS HUGEINT) * CAST(y.c AS HUGEINT)) AS BIGINT) AS score
        FROM cuts JOIN total USING (lang)
        JOIN often x ON x.lang = cuts.lang AND x.phrase = array_to_string(string_split(cuts.phrase, ' ')[1:cut], ' ')
        JOIN often y ON y.lang = cuts.lang AND y.phrase = array_to_string(string_split(cuts.phrase, ' ')[cut + 1:cuts.k], ' ')
    ), best AS (
        SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM scored
    ), listed AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE o = 1
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM listed WHERE rank <= 2000
    """
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each language."""
    found = collocations.top(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
