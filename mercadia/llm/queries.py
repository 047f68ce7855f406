"""The queries of the training-data operators and their SQL, for the entry module."""

from __future__ import annotations

import os
from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm import embedding_dedup, jaccard_join
from mercadia.llm._common import table
from mercadia.llm.decontamination import decontaminate
from mercadia.llm.exact_dedup import deduplicate
from mercadia.llm.fill_in_middle import fill_in_middle, restored
from mercadia.llm.mixing import mix
from mercadia.llm.secrets import secrets
from mercadia.llm.substring_dedup import remove_repeats
from mercadia.llm.surrogates import pseudonymise
from mercadia.llm.token_alignment import align
from mercadia.llm.token_counts import token_counts, vocabulary
from mercadia.llm.toxicity import toxicity
from mercadia.llm.warc import archive_pages

#: A folder of public vocabularies; the file's pieces and scores serve as the unigram vocabulary.
VOCABULARY = os.environ.get("MERCADIA_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
#: The two tokenizers that are aligned.
TOKENIZER_A = os.environ.get("MERCADIA_TOKENIZER_A", "/opt/tokenizers/byte_bpe_50k.json")
TOKENIZER_B = os.environ.get("MERCADIA_TOKENIZER_B", "/opt/tokenizers/piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archive_pages(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("ranges")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # without a key of the user's, one that nobody holds: no surrogate can be undone by trying, and runs differ
    return pseudonymise(table(spark, sf_dir, "documents"), os.environ.get("MERCADIA_SURROGATE_KEY") or token_hex(32))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).drop("text_md5")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("sources")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), TOKENIZER_A, TOKENIZER_B, with_groups=False)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark, f"{sf_dir}/documents.parquet")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}).drop("output")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_warc, op3_repeats, op4_embeddings, op5_surrogates, op6_token_counts, op7_decontaminate, op8_jaccard, op9_secrets, op10_mix, op11_token_alignment, op12_exact_dedup, op13_fill_in_middle)}

ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        m AS (SELECT body, max(page_id) AS last FROM p WHERE octet_length(body) >= 1000 GROUP BY body)
        SELECT p.page_id, CAST(octet_length(p.body) AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
               CASE WHEN m.last <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN m.last <> p.page_id THEN m.last END AS refers_to
        FROM p LEFT JOIN m ON p.body = m.body
    """,
    "op7_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), iw AS (
            SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(w[k : k + 9], ' ') AS win, least(len(w), 10) AS n
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
        ), dw AS (
            SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))
        ), h AS (
            SELECT doc_id, k, iw.n, item FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n
        ), hits AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id
        ), ids AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
    """,
    "op9_secrets": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        found AS (
            SELECT r, 0 AS k, 6 AS least, regexp_extract_all(t, p, 0) AS m, regexp_extract_all(t, p, 1) AS g, string_split_regex(t, p) AS gap
            FROM d, (SELECT '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p)
            UNION ALL SELECT r, 1, 20, regexp_extract_all(t, p, 0), regexp_extract_all(t, p, 0), string_split_regex(t, p) FROM d, (SELECT 'AKIA[A-Z0-9]+' AS p)
            UNION ALL SELECT r, 2, 24, regexp_extract_all(t, p, 0), regexp_extract_all(t, p, 0), string_split_regex(t, p) FROM d, (SELECT '[0-9a-f]+' AS p)
            UNION ALL SELECT r, 3, 0, regexp_extract_all(t, p, 0), regexp_extract_all(t, p, 0), string_split_regex(t, p) FROM d, (SELECT '[A-Za-z0-9+/]+' AS p)
            UNION ALL SELECT r, 4, 0, regexp_extract_all(t, p, 0), regexp_extract_all(t, p, 1), string_split_regex(t, p)
            FROM d, (SELECT '(^|[^A-Za-z])(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9._@-]{3,}' AS p)
            UNION ALL SELECT r, 5, 0, regexp_extract_all(t, p, 0), regexp_extract_all(t, p, 0), string_split_regex(t, p)
            FROM d, (SELECT 'https?://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9._~/?&=%-]*' AS p)
        ), one AS (
            SELECT r, k, least, unnest(m) AS m, unnest(g) AS g, unnest(gap[1 : len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM found WHERE len(m) > 0
        ), placed AS (
            SELECT r, k, least, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY r, k ORDER BY i) AS e FROM one
        ), spans AS (
            SELECT r, k, CAST(e - length(m) + CASE WHEN k = 4 THEN length(g) ELSE 0 END AS BIGINT) AS s, CAST(e AS BIGINT) AS e,
                   CASE WHEN k IN (0, 3) THEN 's' WHEN k IN (1, 4) THEN 'i' WHEN k = 5 THEN 'e' END AS role
            FROM placed
            WHERE length(g) >= least AND (k <> 3 OR (length(m) BETWEEN 32 AND 64 AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')))
        ), linked AS (
            SELECT a.r, a.k, a.s, a.e FROM spans a JOIN spans b ON a.r = b.r AND a.k >= 3 AND b.role IS NOT NULL AND b.role <> a.role AND abs(a.s - b.s) <= 200
            GROUP BY a.r, a.k, a.s, a.e, a.role
            HAVING CASE a.role WHEN 's' THEN true WHEN 'i' THEN bool_or(b.role = 's') ELSE bool_or(b.role = 's') AND bool_or(b.role = 'i') END
        ), listed AS (
            SELECT r, k, s, e, (['assign', 'access', 'hex', 'secret', 'identifier', 'endpoint'])[k + 1] || ':' || s || ':' || e AS t
            FROM (SELECT r, k, s, e FROM spans WHERE k < 3 UNION ALL SELECT r, k, s, e FROM linked)
        ), texts AS (
            SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k > 2) AS n_linked,
                   string_agg(t, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(t, ',' ORDER BY s, k, e) AS spans
            FROM listed GROUP BY r
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
        FROM d LEFT JOIN texts USING (r)
    """,
    "op12_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op13_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
        ), h AS (
            SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                        WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), c AS (
            SELECT *, left(t, least(c1, c2)) AS p, substring(t, least(c1, c2) + 1, abs(c1 - c2)) AS m, substring(t, greatest(c1, c2) + 1) AS s FROM h
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(c1, c2) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(c1 - c2) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM c
    """,
}
