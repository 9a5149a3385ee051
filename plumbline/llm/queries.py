"""Registered queries of the corpus operators and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, html_extract, language_id, minhash_dedup, packing, quality, suffix_dedup, token_binary, toxicity
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without 50-byte strings that start in a document of smaller id."""
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), length=50).drop("kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal but for ASCII white space."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_id.predicted(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents by two-word shingles."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    return token_binary.token_files(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_suffix_dedup, op3_exact_dedup, op4_html_extraction, op5_language_id, op6_minhash_dedup, op7_quality, op8_toxicity, op9_token_binary, op10_decontamination)
}

ORACLES: dict[str, str] = {
    "op2_suffix_dedup": r"""
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ), g AS (
            SELECT doc_id, off + i AS i, hash(substr(piece, 2 * i + 1, 100)) AS h
            FROM (SELECT doc_id, off, piece, unnest(range(0, octet_length(encode(piece)) // 2 - 49)) AS i
                  FROM (SELECT doc_id, off, substr(hx, 2 * off + 1, 2 * (256 + 49)) AS piece FROM (SELECT doc_id, hx, unnest(range(0, n - 49, 256)) AS off FROM d WHERE n >= 50)))
        ), f AS (
            SELECT h, min(doc_id) AS least FROM g GROUP BY h
        ), hit AS (
            SELECT doc_id, i FROM g JOIN f USING (h) WHERE least < doc_id
        ), run AS (
            SELECT doc_id, grp, min(i) AS a, max(i) + 50 AS b FROM (
                SELECT doc_id, i, sum(CASE WHEN i - prev <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp
                FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM hit)
            ) GROUP BY doc_id, grp
        ), span AS (
            SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS removed, count(*) AS spans FROM run GROUP BY doc_id
        ), kept AS (
            SELECT d.doc_id, string_agg(substr(hx, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS rest
            FROM (SELECT span.doc_id, unnest(list_concat([0], span.b)) AS f, unnest(list_concat(span.a, [d.n])) AS t FROM span JOIN d USING (doc_id)) x JOIN d USING (doc_id)
            GROUP BY d.doc_id
        )
        SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(rest, CASE WHEN removed IS NULL THEN hx ELSE '' END))) AS kept_sha256
        FROM d LEFT JOIN span USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op3_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
        ), g AS (
            SELECT body, count(*) AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id FROM n GROUP BY body
        )
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
        FROM n JOIN g USING (body)
    """,
    "op6_minhash_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS sh
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), hs AS (
            SELECT doc_id, hash(sh) AS h FROM s
        ), pairs AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM hs x JOIN hs y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2
        ), link AS (
            SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)
        ), edge AS (
            SELECT a, b FROM link UNION SELECT b, a FROM link
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
        ), c AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
    """,
    "op10_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
        ), dw AS (
            SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
        ), hit AS (
            SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, win)
        ), words AS (
            SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id
        )
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
}
