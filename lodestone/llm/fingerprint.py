"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a run between line feeds. Each paragraph is hashed to a wide vector of `LANES` bits (four seeded
64-bit hashes, 60 bits of each); a document's fingerprint is the sum of its paragraphs' vectors, lane by lane
modulo 2**19, together with their number. Sums commute and have inverses, so equality doesn't depend on the order
of paragraphs, and `insert` and `delete` update a fingerprint from the changed paragraph alone.

Three lanes of 20 bits share a long: 19 bits of sum and a guard bit, masked after each addition, so no addition
overflows and no lane runs into its neighbour. Likeness: read as lane sums of +1 and -1 (twice the sum less the
number), the vectors estimate inner products of paragraph multisets; likeness is the cosine of two of them, cut to
0..1, and exactly 1 for equal fingerprints. Its error is about 1 / sqrt(LANES) = 0.065.

All of it is DataFrame expressions. `edited_documents` finds each document's neighbour with one move of the texts:
rows are ranked by (descending id, hash of the text), which moves neither texts nor more than three longs a row;
every `CELL_ROWS`-th of them, or more for at most `CELLS` of them, begins a cell, so cells are of equal size whatever
ids are null or repeat. Texts move once to their cell, found by binary search, and the head of each cell visits the
cell before it. `fingerprints` takes the inner products from exploded lanes, added up by generated code.

Defined results: a null text is the empty text, which has one empty paragraph; a null doc_id comes last in the
descending order; rows that share a doc_id are ordered by their texts' hash, and rows equal in both are
interchangeable; an empty table gives an empty result. Columns other than doc_id and text aren't read, so extra ones
may have any name.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import global_rank, written

SEEDS = 4
LONGS = 20  # of each seed: bits i, i + 20 and i + 40 of its hash
LANES = SEEDS * LONGS * 3
ONES = 1 | 1 << 20 | 1 << 40
MASK = (2**19 - 1) * ONES
SHIFTS = (0, 20, 40)
CELLS = 1 << 16
CELL_ROWS = 1024


def paragraph_vector(paragraph: Column) -> Column:
    """The packed vector of one paragraph: `SEEDS * LONGS` longs of three lanes, then 1 for its count."""
    hashes = F.array(*[F.xxhash64(F.lit(seed), paragraph) for seed in range(SEEDS)])
    lanes = F.transform(hashes, lambda h: F.array(*[F.shiftright(h, i).bitwiseAND(F.lit(ONES)) for i in range(LONGS)]))
    return F.concat(F.flatten(lanes), F.array(F.lit(1).cast("long")))


def fingerprint(text: Column) -> Column:
    """The fingerprint of `text` as array<bigint>."""
    start = F.array_repeat(F.lit(0).cast("long"), SEEDS * LONGS + 1)
    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n", -1), start, lambda acc, p: insert(acc, p))


def insert(vector: Column, paragraph: Column) -> Column:
    """The fingerprint after a paragraph joins the document."""
    return F.zip_with(vector, paragraph_vector(paragraph), lambda a, b: (a + b).bitwiseAND(F.lit(MASK)))


def delete(vector: Column, paragraph: Column) -> Column:
    """The fingerprint after a paragraph leaves the document; 2**19 is added in each lane so none turns negative."""
    guard = (1 << 19) * ONES
    return F.zip_with(vector, paragraph_vector(paragraph), lambda a, b: (a + F.lit(guard) - b).bitwiseAND(F.lit(MASK)))


def as_text(vector: Column) -> Column:
    """Hexadecimal, 15 digits for each long."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def _signed(x: Column, n: Column, shift: int) -> Column:
    """A lane as its sum of +1 and -1, of `n` paragraphs."""
    return F.shiftright(x, shift).bitwiseAND(F.lit(2**19 - 1).cast("long")) * 2 - n


def _cosine(same: Column, dot: Column, norm_a: Column, norm_b: Column) -> Column:
    norm = F.sqrt(norm_a.cast("double") * norm_b.cast("double"))
    return F.when(same, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(dot / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the two signed lane sums; 1 for equal fingerprints."""
    n_a, n_b = F.element_at(a, -1), F.element_at(b, -1)

    def dot(x: Column, n_x: Column, y: Column, n_y: Column) -> Column:
        products = F.zip_with(F.slice(x, 1, SEEDS * LONGS), F.slice(y, 1, SEEDS * LONGS), lambda p, q: reduce(
            Column.__add__, [_signed(p, n_x, s) * _signed(q, n_y, s) for s in SHIFTS]))
        return F.aggregate(products, F.lit(0).cast("long"), lambda acc, v: acc + v)

    return _cosine(a == b, dot(a, n_a, b, n_b), dot(a, n_a, a, n_a), dot(b, n_b, b, n_b))


def _bounds(docs: DataFrame) -> list[tuple[int, int, int]]:
    """The first key of each cell, in order; at most `CELLS` of them come to the driver."""
    ranked = global_rank(docs.select("_key.*"), ["n", "k", "h"])
    width = max(CELL_ROWS, -(-ranked.count() // CELLS))
    return sorted({tuple(r) for r in ranked.filter(F.col("rank") % width == 0).select("n", "k", "h").collect()})


def with_neighbour(docs: DataFrame) -> DataFrame:
    """doc_id, text, vector (fingerprint) and the text and vector of the next document in descending doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    last, down = F.col("doc_id").isNull().cast("int"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0))
    docs = docs.withColumn("_key", F.struct(last.alias("n"), down.alias("k"), F.xxhash64("text").alias("h")))
    bounds = _bounds(docs) or [(0, 0, 0)]
    known = F.from_json(F.lit(json.dumps([dict(zip("nkh", b)) for b in bounds])), "array<struct<n:int,k:bigint,h:bigint>>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, (len(bounds) - 1).bit_length())))])
    cell = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step) <= F.col("_key"), at + step).otherwise(at))
    placed = docs.withColumn("_cell", cell)
    own = F.struct(F.col("_cell").alias("cell"), F.lit(0).alias("guest"))
    guest = F.struct(F.pmod(F.col("_cell") - 1, F.lit(len(bounds))).alias("cell"), F.lit(1).alias("guest"))
    places = F.explode(F.when(F.get(known, F.col("_cell")) == F.col("_key"), F.array(own, guest)).otherwise(F.array(own)))
    moved = placed.select("doc_id", "text", "_key", places.alias("_at")).select("doc_id", "text", "_key", F.col("_at.cell").alias("_cell"), F.col("_at.guest").alias("_guest"))
    moved = moved.repartition("_cell").withColumn("vector", fingerprint(F.col("text")))
    order = Window.partitionBy("_cell").orderBy("_guest", "_key", "text")
    following = F.lead(F.struct("text", "vector")).over(order)
    return moved.withColumn("_next", following).filter("_guest = 0").select("doc_id", "text", "vector", F.col("_next.text").alias("next_text"), F.col("_next.vector").alias("next_vector"))


def edited_documents(docs: DataFrame) -> DataFrame:
    """`with_neighbour` and edited: the text whose last half is replaced by the start of the next document's."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    return with_neighbour(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", edited)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its own and its edited text's fingerprint, and likenesses."""
    # explode of one element keeps the optimizer from copying the fingerprint into each of its uses
    rows = edited_documents(docs).withColumn("edited_vector", F.explode(F.array(fingerprint(F.col("edited")))))
    same = [(F.col("vector") == F.col(f"{other}_vector")).alias(f"same_{other}") for other in ("edited", "next")]
    rows = written(
        rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "vector", "edited_vector", "next_vector", *same),
        "fingerprints",
    )
    vectors = {"a": "vector", "b": "edited_vector", "c": "next_vector"}
    packed = F.arrays_zip(*[F.slice(v, 1, SEEDS * LONGS).alias(k) for k, v in vectors.items()])
    counts = [F.element_at(v, -1).alias(f"n_{k}") for k, v in vectors.items()]
    lanes = rows.select("row", *counts, F.explode(packed).alias("x")).select("row", *(f"n_{k}" for k in vectors), "x.*")

    def dot(x: str, y: str) -> Column:
        return F.sum(reduce(Column.__add__, [_signed(F.col(x), F.col(f"n_{x}"), s) * _signed(F.col(y), F.col(f"n_{y}"), s) for s in SHIFTS])).alias(x + y)

    dots = lanes.groupBy("row").agg(*(dot(*pair) for pair in ("aa", "bb", "cc", "ab", "ac")))
    rows = rows.drop("next_vector").join(dots, "row")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("vector")).alias("fingerprint"), as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        _cosine(F.col("same_edited"), F.col("ab"), F.col("aa"), F.col("bb")).alias("near_edited"),
        _cosine(F.col("same_next"), F.col("ac"), F.col("aa"), F.col("cc")).alias("near_next"),
    )
