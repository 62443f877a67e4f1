"""A training corpus from `documents`: five stages, each on all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents.

* toxicity: documents that score `THRESHOLD` or more go; labels come from the labels table;
* exact dedup: of equal texts the largest doc_id stays;
* near dedup: of each class of near-duplicates the document that names it stays;
* mixing: sources are taken to their weights; documents taken twice come twice, the last one of a source's budget
  with its first words only;
* packing: a row for each piece of a document in a window of 4096 tokens.

Defined results, of every stage: a null text counts as empty; null and repeated doc_ids are rows of their own until a
dedup stage finds their texts equal or alike; an empty table gives an empty result; columns beyond those of documents,
whatever their names, come through the first four stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exact, mixing, near, packing, toxicity
from lodestone.llm.common import written
from lodestone.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. Empty texts score as texts without matches, repeated rows alike."""
    return toxicity.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text, letters A-Z in either case: of the largest doc_id; a null one only where all are null."""
    return exact.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each class of near-duplicates: of the least doc_id; texts without words are one class."""
    return near.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; empty texts are never taken, a null source is one of its own."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece in a window; an empty text has the one end id."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The classifier, the sampled signatures and the tokenizer can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
