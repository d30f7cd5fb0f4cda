"""The opN_<name> queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinbridge.llm import bpe, decontaminate, lpf_dedup, quality_cnn, quality_rules, resharding, secret_scan, simhash, substring_dedup, warc_archive
from kinbridge.llm.common import shared_path, table

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_documents(table(spark, sf_dir, "documents"), RANK_FILE, public_tokenizers.PATTERN, with_ids=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op4_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old shards: sixteen by source, so a hot source is a large shard; new: eight of near equal bytes."""
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(16))
    placed, _ = resharding.reshard(table(spark, sf_dir, "documents"), 8, old)
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select(
        "doc_id", F.when(F.col("text").isNull(), F.lit(1)).otherwise(F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_cnn.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc_archive.write(table(spark, sf_dir, "pages"), path)
    records = warc_archive.read(spark, path)
    refers = F.regexp_extract(warc_archive.field(F.col("header"), "WARC-Refers-To"), r"<urn:record:(-?\d+)>", 1)
    return records.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest",
        warc_archive.field(F.col("header"), "WARC-Type").alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op8_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lpf_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=400, mode="all")
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20, mode="later")
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_secret_scan": op3_secret_scan,
    "op4_resharding": op4_resharding,
    "op5_quality_cnn": op5_quality_cnn,
    "op6_warc_archive": op6_warc_archive,
    "op7_simhash": op7_simhash,
    "op8_lpf_dedup": op8_lpf_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_secret_scan": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        pats(ord, p, g, least) AS (VALUES
          (0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
          (1, 'AKIA[A-Z0-9]+', 0, 18), (2, '[0-9a-f]+', 0, 16), (3, '[A-Za-z0-9+/_-]{20,}={0,2}', 0, 20)),
        lists AS (
          SELECT doc_id, source, 0 AS ord, 12 AS least, string_split_regex(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)') AS gaps,
                 regexp_extract_all(t, (SELECT p FROM pats WHERE ord = 0), 0) AS ms, regexp_extract_all(t, (SELECT p FROM pats WHERE ord = 0), 2) AS vs FROM d
          UNION ALL
          SELECT doc_id, source, ord, least, string_split_regex(t, p), regexp_extract_all(t, p), regexp_extract_all(t, p) FROM d, pats WHERE ord > 0),
        flat AS (
          SELECT doc_id, source, ord, least, unnest(range(1, len(ms) + 1)) AS i, unnest(gaps[1 : len(ms)]) AS gap, unnest(ms) AS m, unnest(vs) AS v FROM lists),
        ends AS (
          SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS BIGINT) AS e FROM flat),
        spans AS (
          SELECT doc_id, source, ord, e - length(m) AS s, e, v FROM ends WHERE length(v) >= least
            AND (ord < 3 OR (length(regexp_replace(v, '[^0-9]', '', 'g')) >= 3 AND length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 3
                 AND len(list_distinct(string_split(v, ''))) >= 10))),
        outside AS (
          SELECT * FROM (SELECT *, max(CASE WHEN ord < 3 THEN e END) OVER (PARTITION BY doc_id ORDER BY s, ord, e, v ROWS UNBOUNDED PRECEDING) AS reach FROM spans)
          WHERE ord < 3 OR reach IS NULL OR s >= reach),
        owners AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS n, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) AS r FROM outside GROUP BY v),
        judged AS (SELECT o.doc_id, ord, s, e, n < 3 AND r < 50 AS live FROM outside o JOIN owners USING (v) WHERE ord < 3 OR (n < 3 AND r < 50)),
        names AS (SELECT ['assign', 'access', 'hex', 'owned'] AS ns),
        agg AS (
          SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
                 string_agg(ns[ord + 1] || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS base,
                 string_agg(ns[ord + 1] || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans,
                 count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, count(*) FILTER (ord = 3) AS n_owned
          FROM judged, names GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
               coalesce(n_example, 0) AS n_example, coalesce(n_owned, 0) AS n_owned
        FROM d LEFT JOIN agg ON d.doc_id = agg.doc_id""",
    "op6_warc_archive": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, b, sha1(b) AS x FROM p),
        n AS (SELECT page_id, b, x, [CAST('0x' || x[5 * i + 1 : 5 * i + 5] AS INTEGER) for i in range(8)] AS ns FROM h),
        c AS (
          SELECT page_id, octet_length(b) AS payload_bytes, min(page_id) OVER (PARTITION BY x) AS first_id,
                 array_to_string(flatten([['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s) & 31) + 1] for s in [15, 10, 5, 0]] for v in ns]), '') AS payload_digest
          FROM n)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM c""",
    "op8_lpf_dedup": r"""
        WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
        w AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 - 399 AS BIGINT))) AS i FROM d)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
        runs AS (
          SELECT doc_id, i, sum(CASE WHEN i <= prev + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
          FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM r)),
        spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY doc_id, run),
        cuts AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed FROM spans GROUP BY doc_id),
        pieces AS (
          SELECT s.doc_id, lag(b, 1, 0) OVER (PARTITION BY s.doc_id ORDER BY a) AS x, a AS y FROM spans s
          UNION ALL SELECT d.doc_id, coalesce(max(b), 0), max(len(h)) // 2 FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id),
        kept AS (
          SELECT doc_id, string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x) AS k FROM pieces JOIN d USING (doc_id) WHERE y > x GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
        FROM d LEFT JOIN cuts USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op10_substring_dedup": r"""
        WITH w AS (
          SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
          FROM documents),
        windows AS (
          SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS win
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
        repeated AS (
          SELECT doc_id, i FROM (
            SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS rn FROM windows)
          WHERE rn > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM repeated),
        gone_by AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
        each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
        kept AS (
          SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS kept, count(*) AS n
          FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
               CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id""",
}
