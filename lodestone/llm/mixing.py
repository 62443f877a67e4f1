"""Mixing sources to target weights, by hash-random order, distributed prefix sums and exact cuts.

Each document gets a key hashed from its id; within a source documents are ordered by that key. A source's word
budget is its target, rounded down: whole epochs of the source first, the rest cut from the start of the order,
so the last document taken may be taken in part. Only ids, sources and sizes are moved, never texts.

Prefix sums are distributed: rows are range-partitioned and sorted by (source, key, doc_id, size) and, where these are
equal, by a number of the row, so neither a source that holds most rows nor an id that repeats stays in one task.
Sums run inside (partition, source), and the partitions' totals are summed up once more.

Defined results: a null text has size 0; a null source is a source of its own, the last in order; a null doc_id is
hashed as the text "null"; repeated rows are separate documents, ordered by (key, doc_id, size), and rows equal in
all three are interchangeable. An empty table gives an empty result. Columns other than doc_id, text and source
aren't read; `mixed_documents` returns them unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, global_rank, numbered, written

def allocate(sizes: DataFrame, weights: tuple[int, ...], share: float, repeat: int) -> DataFrame:
    """Targets of the sources in `sizes` (_s, source_size): by weight, capped at `repeat` times the source.

    Excess over a cap is shared again by weight until no target is above its cap. Only sums come to the driver.
    """
    rank = F.col("rank") % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank + 1).cast("int"))
    ranked = written(
        global_rank(sizes, ["_s"]).select("_s", "source_size", weight.alias("_w"), (F.col("source_size") * repeat).alias("_cap")),
        "sources",
    )
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("_cap") <= F.lit(level) * F.col("_w")
        row = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, F.col("_cap")).otherwise(0)).alias("capped"),
            F.sum(F.when(capped, 0).otherwise(F.col("_w"))).alias("w"),
        ).first()
        if row["all"] is None or not row["w"]:
            break
        new = max(0.0, share * row["all"] - row["capped"]) / row["w"]
        if level is not None and new <= level:
            break
        level = new
    target = F.least(F.col("_cap").cast("double"), F.lit(level if level is not None else 0.0) * F.col("_w"))
    return ranked.select("_s", "source_size", target.alias("target"))


def _source(name: str) -> Column:
    """A source as text that sorts in code-point order, null last."""
    return F.coalesce(F.concat(F.lit("a"), name), F.lit("z"))


def _mixed(docs: DataFrame, weights: tuple[int, ...], share: float, repeat: int) -> DataFrame:
    """`mix` of `docs` (row, doc_id, source, text), with the row of each document."""
    if share > repeat:
        raise ValueError("share can't exceed repeat: the sources can't fill it")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = written(docs.select("row", "doc_id", _source("source").alias("_s"), size.alias("size")), "sizes").withColumn("_key", key)
    order = ["_s", "_key", "doc_id", "size", "row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_key").withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "ordered").withColumn("_part", F.shiftright("_at", 33))
    totals = placed.groupBy("_s", "_part").agg(F.sum("size").alias("_sum"))
    targets = allocate(totals.groupBy("_s").agg(F.sum("_sum").alias("source_size")), weights, share, repeat)
    earlier = F.sum("_sum").over(Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.withColumn("_start", F.coalesce(earlier, F.lit(0))).drop("_sum").join(targets, "_s")
    inside = Window.partitionBy("_part", "_s").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("_budget") - F.col("_epochs") * F.col("source_size") - F.col("_before")
    return (
        placed.withColumn("_upto", F.sum("size").over(inside))
        .join(starts, ["_part", "_s"])
        .withColumn("_before", F.col("_start") + F.col("_upto") - F.col("size"))
        .withColumn("_budget", F.floor("target"))
        .withColumn("_epochs", epochs.cast("long"))
        .select(
            "row",
            "doc_id",
            F.when(F.col("_s") != "z", F.substring("_s", 2, 1 << 30)).alias("source"),
            "size",
            "source_size",
            "target",
            (F.col("_epochs") * F.col("size") + F.least("size", F.greatest(F.lit(0), rest))).cast("long").alias("taken"),
        )
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes, repeats counted) of each document.

    Sources in code-point order, null last, weigh `weights`, repeating, and share `share` times all words; a target
    is at most `repeat` times its source.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text")
    return _mixed(rows, weights, share, repeat).drop("row")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2) -> DataFrame:
    """The mix itself: each document as many times as it is taken whole, then the cut document's first words.

    Returns the columns of `docs`, whatever their names; n_chars, where there is such a column, follows the text.
    """
    copy = numbered(docs)
    taken = _mixed(copy.select("row", "doc.doc_id", "doc.source", "doc.text"), weights, share, repeat).filter("taken > 0").select("row", "size", "taken")
    size = F.nullif("size", F.lit(0))
    whole, cut = (F.col("taken") / size).cast("int"), F.col("taken") % size
    copies = F.flatten(F.array(F.array_repeat(F.lit(None).cast("long"), whole), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<bigint>"))))
    out = copy.join(taken.select("row", copies.alias("copies")), "row").select("doc", F.explode("copies").alias("cut"))
    start = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)), 1, F.col("cut").cast("int")), " ")
    text = F.when(F.col("cut").isNull(), F.col("doc.text")).otherwise(start)
    changed = {"text": text, "n_chars": F.when(F.col("cut").isNull(), F.col("doc.n_chars")).otherwise(F.char_length(start).cast("long"))}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"doc.`{c}`") for c in docs.columns))
