"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

A shingle is `SHINGLE` consecutive words (ASCII letters lower-cased; a shorter text is one shingle). Its weight is its
count times the mean inverse document frequency of its words. Document frequencies cover all documents; they are
kept for `CLASSES` hash classes of words, so the table is of fixed size whatever the vocabulary: frequent words have
classes of their own in effect, and rare words share a floor.

1. Documents of the same words are one node, named by a 128-bit digest; further work is on nodes.
2. Each node takes `BANDS * ROWS` samples; nodes that agree in a band share a bucket. At a similarity of 0.8 a pair
   shares none with probability 1e-5.
3. In each bucket all nodes are compared with one, the least in an order that is hashed anew for each band (so in a
   large group the nodes meet many different ones): as many pairs as members. Weighted Jaccard similarity of the whole
   texts, at `LEAST` or more, makes a link.
4. Nodes of buckets that hold several components after that are settled exactly, by prefixes: shingles are put in
   one order, rare ones first, and of each node only the first are joined. A pair of similarity `LEAST` shares a
   shingle after which the larger node has `LEAST` of its weight left and the smaller 2 `LEAST` / (1 + `LEAST`), and
   both have `LEAST` / (1 + `LEAST`) of their joint weight. Pairs of different components with such a shingle are
   verified too. Pages of one template, whose own shingles are rarer than the template's, aren't paired by it.
5. Components of the links are the classes; a class is named by its least doc_id.

A hot bucket comes as its pairs; a node in many pairs, on either side, is copied to as many parts as it has thousands
of pairs, and a shingle with many prefixes is split likewise. Texts are found by a number that rows get in a written
copy, so null and repeated ids are no keys of anything. Similarities use all shingles of whole texts.

Defined results: null counts as empty; texts without words are one class, as are all texts of equal words; rows that
share a doc_id are documents of their own; a null doc_id is never a class's name while another is there; an empty
table gives an empty result. Columns other than doc_id and text aren't read; `kept_documents` returns them unchanged,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import grams, groups_of, mixed, texts_of, words_of
from .common import held, numbered, scratch, skew_join, written
from .graph import components

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 16, 3
CLASSES = 1 << 16
TABLE = 1 << 14
BLOCK = 1000
SPREAD = 1000
PAIRS = 256
SLICE = 2 << 20
NODES = "row long, doc_id long, node binary, empty boolean, bands array<long>"
WEIGHED = "nid long, component long, total double, shingle long, weight double"


def _class(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES, np.int64)
    for batch in batches:
        bounds, data = texts_of(batch.column("text"))
        for i, j in groups_of(bounds, SLICE):
            firsts, hashes = words_of(bounds[i : j + 1] - bounds[i], data[bounds[i] : bounds[j]], lower=True)
            row = np.repeat(np.arange(j - i), np.diff(firsts))
            total += np.bincount(np.unique(row * CLASSES + _class(hashes)) % CLASSES, minlength=CLASSES)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["class", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The weight of each hash class of words: ln((N + 1) / (n + 1)) + 0.1 for n of N documents. At most `CLASSES` rows come to the driver."""
    counts = docs.select("text").mapInArrow(_count_words, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CLASSES)
    for row in counts:
        n[row["class"]] = row["n"]
    return (np.log((docs.count() + 1) / (n + 1)).clip(0) + 0.1).astype(np.float32)


def shingles(firsts: np.ndarray, hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, hashes, weights): distinct shingles of each text in order of hash, and TF-IDF weights."""
    counts = np.diff(firsts)
    weight = idf[_class(hashes)].astype(np.float64)
    sums = np.concatenate(([0.0], np.cumsum(weight)))
    row, what, value = [], [], []
    if len(hashes) >= SHINGLE:
        gram = grams(hashes, SHINGLE)
        inside = np.repeat(firsts[1:], counts)[: len(gram)] - np.arange(len(gram)) >= SHINGLE
        at = np.flatnonzero(inside)
        row.append(np.repeat(np.arange(len(counts)), counts)[at])
        what.append(gram[at])
        value.append((sums[at + SHINGLE] - sums[at]) / SHINGLE)
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        lo, hi = firsts[i], firsts[i + 1]
        row.append(np.array([i]))
        what.append(grams(hashes[lo:hi], int(hi - lo), 0x9E3779B97F4A7C15))
        value.append(np.array([(sums[hi] - sums[lo]) / (hi - lo)]))
    if not row:
        return np.zeros(len(firsts), np.int64), np.zeros(0, np.uint64), np.zeros(0)
    row, what, value = np.concatenate(row), np.concatenate(what), np.concatenate(value)
    order = np.lexsort((what, row))
    row, what, value = row[order], what[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (what[1:] != what[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(row)))
    row, what, value = row[at], what[at], np.round(value[at], 4) * times
    return np.searchsorted(row, np.arange(len(firsts))), what, value


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_101)
    n = BANDS * ROWS
    r = rng.gamma(2.0, 1.0, (n, TABLE)).astype(np.float32)
    log_c = np.log(rng.gamma(2.0, 1.0, (n, TABLE))).astype(np.float32)
    beta = rng.random((n, TABLE), dtype=np.float32)
    return r, log_c, beta, rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def sampled(bounds: np.ndarray, what: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Improved consistent weighted samples, texts x `BANDS * ROWS` hashes; texts without shingles have zeros.

    A shingle's variates for a sample come from tables indexed by its hash under the sample's multiplier.
    """
    r, log_c, beta, odd = held(("near",), _tables)
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, BANDS * ROWS), np.uint64)
    if not len(full):
        return out
    starts, log_w = bounds[full], np.log(weight).astype(np.float32)
    lengths = np.diff(np.append(starts, len(what)))
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            at = ((what * odd[k]) >> np.uint64(50)).astype(np.int64)
            r_k, beta_k = r[k][at], beta[k][at]
            step = np.floor(log_w / r_k + beta_k)
            value = log_c[k][at] - r_k * (step - beta_k + 1)
            least = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, starts), lengths))
            owner = np.searchsorted(starts, least, "right") - 1
            first = np.ones(len(least), bool)
            first[1:] = owner[1:] != owner[:-1]  # of equal values the least hash, as shingles are in that order
            chosen = least[first]
            out[full, k] = mixed(what[chosen] ^ mixed(step[chosen].astype(np.int64).astype(np.uint64) * odd[k]))
    return out


def _namer(idf):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, data = texts_of(batch.column("text"))
            for i, j in groups_of(bounds, SLICE):
                firsts, hashes = words_of(bounds[i : j + 1] - bounds[i], data[bounds[i] : bounds[j]], lower=True)
                nodes = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(firsts, firsts[1:])]
                samples = sampled(*shingles(firsts, hashes, idf.value))
                with np.errstate(over="ignore"):
                    keys = np.zeros((j - i, BANDS), np.uint64)
                    for k in range(ROWS):
                        keys = mixed(keys * np.uint64(31) + samples[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
                own = [batch.column(c).slice(i, j - i) for c in ("row", "doc_id")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(nodes, pa.binary()), pa.array(np.diff(firsts) == 0), bands], ["row", "doc_id", "node", "empty", "bands"])

    return name


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (hashes in order, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 1.0 if len(a[0]) == len(b[0]) else 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0]
    shared = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def _shingled(texts: pa.Array, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, weights) of each text's shingles."""
    bounds, data = texts_of(texts)
    for i, j in groups_of(bounds, SLICE):
        at, what, weight = shingles(*words_of(bounds[i : j + 1] - bounds[i], data[bounds[i] : bounds[j]], lower=True), idf)
        for lo, hi in zip(at, at[1:]):
            yield what[lo:hi], weight[lo:hi]


def _verifier(idf, least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = None, None
        for whole in batches:
            for k in range(0, len(whole), PAIRS):
                batch, found = whole.slice(k, PAIRS), []
                firsts = batch.column("a").to_numpy()
                for row, (a, b) in enumerate(zip(firsts, _shingled(batch.column("text_b"), idf.value))):
                    if name != a:
                        name, (held,) = a, _shingled(batch.column("text_a").slice(row, 1), idf.value)
                    found.append(similarity(held, b))
                found = np.array(found, dtype=float)
                batch = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], ["a", "b", "similarity"])
                yield batch.filter(pa.array(found >= least))

    return verify


def _spread(pairs: DataFrame, texts: DataFrame, key: str, other: str) -> DataFrame:
    """`pairs` with the text of the node `key`; a node in many pairs is copied to as many parts as it has thousands of them."""
    parts = F.floor(F.col("_n") / SPREAD).cast("int") + 1
    often = written(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_parts", parts), "often")
    copies = texts.join(often.withColumnRenamed(key, "nid"), "nid").select(F.col("nid").alias(key), F.col("text").alias(f"text_{key}"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    placed = skew_join(pairs, often, key).withColumn("_part", F.pmod(F.xxhash64(other), F.col("_parts")).cast("int"))
    return placed.drop("_n", "_parts").join(copies, [key, "_part"]).drop("_part")


def _verified(pairs: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """The pairs (a, b) of `pairs` with their similarity, if it is `least` or more."""
    with scratch() as scope:
        with_b = written(_spread(pairs, texts, "b", "a"), "halves")
        both = _spread(with_b, texts, "a", "b").select("a", "b", "text_a", "text_b")
        return scope.keep(written(both.mapInArrow(_verifier(idf, least), "a long, b long, similarity double"), "links"))


def _weighed(idf):
    """Rows of nid, component, total weight, shingle and weight of each node's text."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, data = texts_of(batch.column("text"))
            for i, j in groups_of(bounds, SLICE):
                at, what, weight = shingles(*words_of(bounds[i : j + 1] - bounds[i], data[bounds[i] : bounds[j]], lower=True), idf.value)
                owner = np.repeat(np.arange(j - i), np.diff(at))
                total = np.bincount(owner, weight, minlength=j - i)
                nid, component = (batch.column(c).slice(i, j - i).to_numpy() for c in ("nid", "component"))
                columns = (nid[owner], component[owner], total[owner], what.view(np.int64), weight)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["nid", "component", "total", "shingle", "weight"])

    return weigh


def _rest(members: DataFrame, texts: DataFrame, labels: DataFrame, tried: DataFrame, idf, least: float) -> DataFrame:
    """Pairs still to be tried: of different components that meet in a bucket, and not below `least` by their prefixes."""
    rows = members.join(labels.select(F.col("node").alias("nid"), "component"), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    rows = written(rows.select("key", "nid", "component"), "members")
    split = rows.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("_n")).filter("_lo <> _hi")
    unsettled = skew_join(rows, split.select("key", "_n"), "key").select("nid", "component").distinct()
    weighed = written(texts.join(unsettled, "nid").select("nid", "component", "text").mapInArrow(_weighed(idf), WEIGHED), "weighed")
    # shingles of one component only can't be shared by a pair: in the order they come first, and take part in no join
    common = weighed.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n"), F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo <> _hi").select("shingle", "_n")
    later = F.sum("weight").over(Window.partitionBy("nid").orderBy(F.desc("_n"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slack = 1 - 1e-9
    prefix = skew_join(weighed, common, "shingle").withColumn("later", later).filter(F.col("later") >= F.col("total") * least * slack)
    prefix = written(prefix.withColumn("_size", F.floor(F.log("total") / (-math.log(least) * 1.0001))).select("shingle", "_size", "nid", "component", "total", "later"), "prefixes")
    shorter = prefix.filter(F.col("later") >= F.col("total") * (2 * least / (1 + least)) * slack)
    parts = shorter.groupBy("shingle", "_size").agg((F.floor(F.count(F.lit(1)) / BLOCK).cast("int") + 1).alias("_parts"))
    longer = prefix.withColumn("_size", F.explode(F.array("_size", F.col("_size") - 1))).join(parts, ["shingle", "_size"])
    longer = longer.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    shorter = shorter.join(parts, ["shingle", "_size"]).withColumn("_part", F.pmod(F.xxhash64("nid"), F.col("_parts")).cast("int")).drop("_parts")
    x, y, on = longer.alias("x"), shorter.alias("y"), ["shingle", "_size", "_part"]
    both = (F.col("x.total") + F.col("y.total")) * (least / (1 + least)) * slack
    fits = (
        (F.col("x.component") != F.col("y.component")) & (F.col("y.total") >= F.col("x.total") * least * slack)
        & ((F.col("x.total") > F.col("y.total")) | (F.col("x.total") == F.col("y.total")) & (F.col("x.nid") > F.col("y.nid")))
        & (F.least("x.later", "y.later") >= both)
    )
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on]
    found = x.join(y, [*on, fits]).select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b")).distinct()
    return found.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def near_links(rows: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, nodes, links) of the written table `rows` (row, doc_id, text): row, doc_id and node of every
    document; nid, node, low (its least doc_id) and size of every node; verified pairs (a, b) of nid and their
    similarity."""
    idf = rows.sparkSession.sparkContext.broadcast(inverse_frequencies(rows))
    named = written(rows.mapInArrow(_namer(idf), NODES), "named")
    nodes = named.groupBy("node", "empty", "bands").agg(F.min("doc_id").alias("low"), F.min("row").alias("head"), F.count(F.lit(1)).alias("size"))
    nodes = written(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    members = written(nodes.filter("not empty").select("nid", F.explode("bands").alias("key")), "banded")
    mask = F.xxhash64("key").bitwiseAND(F.lit((1 << 63) - 1))  # each bucket's own order of nodes
    pivots = members.groupBy("key").agg(F.min(F.col("nid").bitwiseXOR(mask)).alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    pivots = pivots.select("key", F.col("_least").bitwiseXOR(mask).alias("pivot"), "_n")
    members = written(skew_join(members, pivots, "key").select("key", "nid", "pivot"), "bucketed")
    low, high = F.least("nid", "pivot"), F.greatest("nid", "pivot")
    star = members.filter("nid <> pivot").groupBy(low.alias("_lo"), high.alias("_hi")).agg(F.min("pivot").alias("a"))
    star = written(star.select("a", F.when(F.col("a") == F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo")).alias("b")), "pairs")
    heads = nodes.join(members.select("nid").distinct(), "nid").select("nid", F.col("head").alias("row"))
    texts = written(rows.join(heads, "row").select("nid", "text"), "texts")
    links = _verified(star, texts, idf, least)
    with scratch() as scope:
        rest = scope.keep(written(_rest(members, texts, components(links), star, idf, least), "rest"))
    if not rest.isEmpty():
        links = links.unionByName(_verified(rest, texts, idf, least))
    return named.select("row", "doc_id", "node"), nodes.select("nid", "node", "low", "size"), links


def _labelled(rows: DataFrame, least: float) -> DataFrame:
    """row, doc_id, component, class_id and class_size of every document of `rows` (row, doc_id, text)."""
    with scratch() as scope:
        named, nodes, links = near_links(rows, least)
        labels = components(links).select(F.col("node").alias("nid"), "component")
        nodes = written(nodes.join(labels, "nid", "left").withColumn("component", F.coalesce("component", "nid")), "labelled")
        classed = nodes.groupBy("component").agg(F.min("low").alias("class_id"), F.sum("size").alias("class_size"), F.count(F.lit(1)).alias("_n"))
        nodes = skew_join(nodes, classed, "component")
        labelled = skew_join(named, nodes.select("node", "component", "class_id", "class_size", F.col("size").alias("_n")), "node")
        return scope.keep(written(labelled.drop("_n", "node"), "classes"))


def _read(copy: DataFrame) -> DataFrame:
    return copy.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and class_size (documents) of every document."""
    with scratch() as scope:
        found = scope.keep(_labelled(_read(numbered(docs.select("doc_id", "text"))), least))
    return found.select("doc_id", "class_id", "class_size")


def kept_documents(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of `docs` for each class, with all of its columns, whatever their names: one whose doc_id names the class."""
    copy = numbered(docs)
    heads = _labelled(_read(copy), least).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("component").agg(F.min("row").alias("row"))
    return copy.join(heads.select("row"), "row", "left_semi").select("doc.*")
