"""The operators of this folder as registered queries over the given tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jabcheck.llm import (
    alignment,
    bpe,
    exact,
    fingerprint,
    language,
    linededup,
    mixing,
    neardup,
    negatives,
    packing,
    quality,
    substrings,
    warc,
)
from jabcheck.llm.common import table

#: The tokenizer file; the variable names another place.
TOKENIZER = "word_bpe_49k.json"
#: The vocabularies that are aligned.
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path() -> str:
    import public_tokenizers

    return os.environ.get("JABCHECK_TOKENIZER") or public_tokenizers.path(TOKENIZER)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.archive(table(spark, sf_dir, "pages"))
    page = r"<urn:page:(-?\d+)>"
    return warc.read(files, payloads=False).select(
        F.nullif(F.regexp_extract("record_id", page, 1), F.lit("")).cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.nullif(F.regexp_extract("refers_to", page, 1), F.lit("")).cast("bigint").alias("refers_to"),
    )


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(exact.normalised(docs["text"]), 256)
    return exact.exact_groups(docs, {"text_sha256": digest})


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.score(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_substrings": op3_substrings,
    "op4_warc": op4_warc,
    "op5_jaccard": op5_jaccard,
    "op6_exact": op6_exact,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_lines": op9_lines,
    "op10_fingerprint": op10_fingerprint,
    "op11_alignment": op11_alignment,
    "op12_mixing": op12_mixing,
    "op13_negatives": op13_negatives,
}

ORACLE = {
    "op4_warc": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        g AS (SELECT html, max(page_id) AS stored FROM p WHERE n >= 1000 GROUP BY html)
        SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
          CASE WHEN g.stored IS NULL OR g.stored = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN g.stored <> p.page_id THEN g.stored END AS refers_to
        FROM p LEFT JOIN g ON p.html = g.html AND p.n >= 1000""",
    "op6_exact": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n_chars,
            regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
          count(*) OVER (PARTITION BY norm) AS group_size,
          doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)""",
    "op9_lines": r"""
        WITH l AS (
          SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
            unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
        k AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l),
        p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
        c AS (
          SELECT k.source, key FROM k JOIN p USING (source) WHERE key <> ''
          GROUP BY k.source, key HAVING count(DISTINCT doc_id) >= 2
            AND count(DISTINCT doc_id) > 0.05 * any_value(pages)),
        r AS (
          SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(c.key) AS INTEGER) AS n_dropped,
            string_agg(CASE WHEN c.key IS NULL THEN line END, chr(10) ORDER BY place) AS kept
          FROM k LEFT JOIN c USING (source, key) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
          CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS text_sha256
        FROM documents LEFT JOIN r USING (doc_id)""",
    "op13_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
            CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
          SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
            CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
          FROM p JOIN s USING (anchor_id)
          WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
