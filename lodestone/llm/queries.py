"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from . import exact, fingerprint, licenses, mixing, near, packing, secrets, substrings, toxicity, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_docs(spark, sf_dir)).drop("n_novel")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_docs(spark, sf_dir))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(_docs(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(_docs(spark, sf_dir))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """`query`, after its package has been made known to Python workers."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": _shipped(op1_mixing),
    "op2_toxicity": _shipped(op2_toxicity),
    "op3_warc": _shipped(op3_warc),
    "op4_substrings": _shipped(op4_substrings),
    "op5_secrets": _shipped(op5_secrets),
    "op6_packing": _shipped(op6_packing),
    "op7_licenses": _shipped(op7_licenses),
    "op8_fingerprints": _shipped(op8_fingerprints),
    "op9_near_dedup": _shipped(op9_near_dedup),
    "op10_exact_dedup": _shipped(op10_exact_dedup),
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLES: dict[str, str] = {
    "op3_warc": f"""
        WITH rows AS (
            SELECT page_id, coalesce(html, '') AS payload, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                   list_transform(range(8), lambda g: CAST('0x' || substr(sha1(coalesce(html, '')), 5 * g + 1, 5) AS BIGINT)) AS parts,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
            FROM pages)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(parts, lambda n:
                   substr('{_BASE32}', CAST(n // 32768 + 1 AS BIGINT), 1) || substr('{_BASE32}', CAST(n // 1024 % 32 + 1 AS BIGINT), 1)
                   || substr('{_BASE32}', CAST(n // 32 % 32 + 1 AS BIGINT), 1) || substr('{_BASE32}', CAST(n % 32 + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM rows""",
    "op1_mixing": r"""
        WITH rows AS (
            SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
            FROM rows GROUP BY source),
        filled AS (
            SELECT *, 2 * source_size AS cap,
                   coalesce(CAST(sum(2 * source_size) OVER before AS DOUBLE), 0) AS capped,
                   CAST(sum(w) OVER after AS DOUBLE) AS rest,
                   1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS total
            FROM sources
            WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   after AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        level AS (SELECT max(CASE WHEN (total - capped) / rest * w < cap THEN (total - capped) / rest END) AS level FROM filled),
        targets AS (
            SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(level, 0) * w) AS target
            FROM filled, level),
        summed AS (
            SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
                   CAST(sum(size) OVER (PARTITION BY rows.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
            FROM rows JOIN targets ON rows.source IS NOT DISTINCT FROM targets.source)
        SELECT doc_id, size, source_size, target,
               CAST(coalesce(budget // nullif(source_size, 0), 0) * size
                    + least(size, greatest(0, budget - coalesce(budget // nullif(source_size, 0), 0) * source_size - start)) AS BIGINT) AS taken
        FROM summed""",
    "op4_substrings": r"""
        WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        windows AS (
            SELECT doc_id, start, array_to_string(words[start:start + 12], ' ') AS gram
            FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS start FROM texts)),
        covered AS (
            SELECT DISTINCT doc_id, unnest(generate_series(start, start + 12)) AS place
            FROM windows JOIN (SELECT gram, min(doc_id) AS low FROM windows GROUP BY gram) USING (gram) WHERE low < doc_id),
        places AS (SELECT doc_id, unnest(generate_series(1, len(words))) AS place, unnest(words) AS word FROM texts),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
            FROM places ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (doc_id)""",
    "op10_exact_dedup": """
        WITH rows AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, CAST(count(*) OVER same AS BIGINT) AS group_size,
               coalesce(doc_id = max(doc_id) OVER same, true) AS kept, sha256(t) AS text_sha256
        FROM rows WINDOW same AS (PARTITION BY t)""",
}
