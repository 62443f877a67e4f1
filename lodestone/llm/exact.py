"""Exact deduplication by skew-safe combining, with full texts compared at every stage.

Texts are equal when identical after lower-casing A-Z only. Three combining stages, each grouping by the whole
normalised text beside its digest, so that a digest collision can't merge different texts:

1. local: Spark's partial aggregation merges equal texts inside each task before anything moves;
2. salted: digests that hold more than 1 / `HOT_SHARE` of all rows (at most `HOT_SHARE` of them, so the list may be
   broadcast) are split over `SALTS` salts, others have salt 0;
3. global: the salts' winners are combined; other groups are already whole.

Documents find their group by digest. If a digest should stand for several texts, the documents with it find their
group by digest and text instead; the rest of the plan is the same.

Defined results: null counts as empty; rows that share doc_id and text belong to one group and are all marked with
its keep_id, and exactly the rows whose doc_id is the keep_id are kept; a group whose ids are all null has keep_id
null, and its rows are kept. An empty table gives an empty result. Columns other than doc_id and text aren't read;
`kept_documents` keeps one row of a group and returns its columns unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, numbered, skew_join, written

SALTS = 64


def normalised(text: Column) -> Column:
    """`text` with A-Z lower-cased and null as empty; all-ASCII texts take the quick way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def groups(docs: DataFrame, digest: Callable[[Column], Column], more: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(documents, groups): doc_id, `more` and digest (_d) of each document; digest, keep_id, size and another digest (_s) of each group."""
    keys = written(docs.select(*more, "doc_id", F.unhex(digest(normalised(F.col("text")))).alias("_d")), "digests")
    total = keys.count()
    hot = keys.groupBy("_d").count().filter(F.col("count") > max(1, total // HOT_SHARE)).select("_d", F.lit(True).alias("_hot"))
    texts = docs.select("doc_id", normalised(F.col("text")).alias("_t"))
    texts = texts.withColumn("_d", F.unhex(digest(F.col("_t")))).join(F.broadcast(hot), "_d", "left")  # at most HOT_SHARE rows
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salted = texts.withColumn("_salt", salt).groupBy("_d", "_salt", "_t", F.coalesce("_hot", F.lit(False)).alias("_hot"))
    salted = salted.agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    short = F.sha2("_t", 512)  # with the digest it names the text where only names are needed
    # winners of salts are combined by full text; all other groups are whole
    winners = written(salted.select("_d", "_salt", "_hot", "keep_id", "group_size", short.alias("_s"), F.when(F.col("_hot"), F.col("_t")).alias("_t")), "winners")
    whole = winners.filter("not _hot").select("_d", "keep_id", "group_size", "_s")
    merged = winners.filter("_hot").groupBy("_d", "_t", "_s").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return keys, written(whole.unionByName(merged.drop("_t")), "groups")


def _grouped(docs: DataFrame, digest: Callable[[Column], Column], more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `more`, keep_id, group_size, text_sha256 and both digests of every document of `docs` (doc_id, text, more)."""
    keys, found = groups(docs, digest, more)
    shared = found.groupBy("_d").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_d")
    if digest is sha256 and shared.isEmpty():
        return skew_join(keys, found.withColumn("_n", F.col("group_size")), "_d").withColumn("text_sha256", F.lower(F.hex("_d")))
    text = normalised(F.col("text"))
    rows = docs.select(*more, "doc_id", F.unhex(digest(text)).alias("_d"), F.sha2(text, 512).alias("_s"), sha256(text).alias("text_sha256"))
    return rows.join(found, ["_d", "_s"])


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document.

    `digest` (hexadecimal) finds candidates; results are the same with any, as texts are compared in full.
    """
    out = _grouped(docs.select("doc_id", "text"), digest)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each text, with all of its columns, whatever their names: one whose doc_id is the text's keep_id."""
    copy = numbered(docs)
    rows = _grouped(copy.select("row", "doc.doc_id", "doc.text"), sha256, ("row",))
    heads = rows.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("_d", "_s").agg(F.min("row").alias("row"))
    return copy.join(heads.select("row"), "row", "left_semi").select("doc.*")
