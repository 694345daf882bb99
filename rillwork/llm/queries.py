"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm import (
    decontaminate,
    fingerprints,
    hilbert_shards,
    jaccard_join,
    language_id,
    secret_scan,
    substring_dedup,
    token_matrix,
    vector_packing,
    warc,
)
from rillwork.llm.common import table
from rillwork.llm.tokens import default_vocabulary


def op1_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows as the written files hold them; of the ids, their checksum."""
    packed = token_matrix.pack_tokens(table(spark, sf_dir, "documents"), default_vocabulary())
    return token_matrix.write_packed(packed).select(
        "sequence_id",
        "n_tokens",
        F.crc32("input_ids").alias("row_crc32"),
        "cu_seqlens",
        "position_resets",
        "resets",
        "doc_ids",
        "pieces",
    )


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_vectors(table(spark, sf_dir, "documents"), default_vocabulary())


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.spans_text(spans, base_only=True), 256).alias("base_sha256"),
        secret_scan.spans_text(spans).alias("spans"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.hilbert_shards(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_matrix": op1_token_matrix,
    "op2_vector_packing": op2_vector_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_language_id": op6_language_id,
    "op7_fingerprints": op7_fingerprints,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op4_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(
                regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[\x20\x09-\x0D]+'
                ), lambda x: x <> '') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
            FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i)
            WHERE len(w) > 0
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
            FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
        ), e AS (
            SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
            WHERE 100 * k >= 80 * (x.n + y.n - k)
        ), u AS (
            SELECT a, b FROM e UNION ALL SELECT b, a FROM e
        ), r(doc_id, c) AS (
            SELECT doc_id, doc_id FROM d
            UNION
            SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id WHERE r.c < u.b
        ), least_label AS (
            SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id
        FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN least_label ON d.doc_id = least_label.doc_id
    """,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (
            SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
    """,
    "op10_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), words AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d
        ), grown AS (
            SELECT doc_id, p, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS run
            FROM words
            WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
        ), repeated AS (
            SELECT run FROM grown WHERE n = 35 GROUP BY run HAVING count(*) > 1
        ), covered AS (
            SELECT DISTINCT doc_id, p + j AS p
            FROM (SELECT doc_id, p FROM grown SEMI JOIN repeated USING (run) WHERE n = 35), range(35) AS t(j)
        ), kept AS (
            SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept, count(*) AS n
            FROM words ANTI JOIN covered ON words.doc_id = covered.doc_id AND words.p = covered.p
            GROUP BY words.doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
}
