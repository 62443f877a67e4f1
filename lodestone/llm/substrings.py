"""Substring deduplication on a de Bruijn graph of words, held as edges in Spark tables.

An edge is a window of `WINDOW` consecutive words; it is repeated if it lies in documents of different ids. The graph
is never built from all edges. Each edge is assigned to its anchor, the least hashed `ANCHOR`-word gram in it, as in
minimizer-based compaction: equal edges have equal anchors, so

1. documents send their distinct anchors, about two in nine words, to partitions by anchor; anchors of two documents
   or more come back to their documents' partitions (a Spark join on the anchor, then on the document);
2. documents send the edges of such anchors; in a partition equal edges meet, and the least (doc_id, position) of each
   is its source. Runs of edges whose positions and sources both advance by one are nonbranching paths, compacted
   to one row: document, position, number of edges, and the source's coordinates;
3. paths join their sources' texts, which add a digest of the words that stand at the source's coordinates;
4. paths join their documents, which glues paths that continue across partitions: a word goes if a path covers it
   from a source with a smaller doc_id, and only if the document's own words there have the source's digest.

Edges meet if the 64-bit hash of the anchor, that of the window under another base and the anchor's place agree; all
of these follow from 64-bit hashes of words. That only proposes repeats: step 4 compares 128-bit digests of the
words themselves. A path that fails it is dropped.

What moves: texts once (steps 2 to 4 use one exchange), anchors once, repeated edges once, paths twice. Before
sending, each task settles what it can: of an anchor or edge that several of its documents share, one sends a row. So
an anchor in a third of all documents comes as one row for each `BUFFER` anchors, an edge as one row a partition.
Hashes move as packed arrays. A document's partition is hashed from its id and text, so ids of one stride, null ids
and repeated ids are spread; the number of partitions follows from the total of the texts, so that a partition's texts
have `BUCKET_BYTES` on average.

Defined results: null counts as empty; rows that share a doc_id are judged each, and never as sources of each
other; a null doc_id counts as larger than any other; repeated rows get equal results; an empty table gives an empty
result. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import grams, groups_of, texts_of, words_of

WINDOW = 13
ANCHOR = 6
BUCKET_BYTES = 12 << 20
SLICE = 8 << 20
BUFFER = 1 << 21
LAST = np.iinfo(np.int64).max
PACKED = "_to int, packed binary"


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(blob, "<i8", len(kinds)), kinds):
        out.append(np.frombuffer(blob, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _gather(tables, kinds: tuple) -> list[np.ndarray]:
    parts = [_unpack(blob, kinds) for table in tables for blob in table.column("packed").to_pylist()]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kinds[k]) for k in range(len(kinds))]


def _split(to: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed arrays for each destination in `to`."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to, arrays = to[order], tuple(a[order] for a in arrays)
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)]))
    for lo, hi in zip(bounds, bounds[1:]):
        yield int(to[lo]), _pack(*(a[lo:hi] for a in arrays))


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["_to", "packed"])


def anchors(hashes: np.ndarray, firsts: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, anchor positions, anchor hashes) of all windows inside texts, in order."""
    counts = np.diff(firsts)
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = grams(hashes, size)
    n = len(hashes) - window + 1
    best, place = gram[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, window - size + 1):
        other = gram[k : k + n]
        less = other < best
        best[less], place[less] = other[less], k
    inside = np.repeat(firsts[1:], counts)[:n] - np.arange(n) >= window
    starts = np.flatnonzero(inside)
    return starts, starts + place[starts], best[starts]


def _repeats(keys: list[np.ndarray]) -> np.ndarray:
    """Group numbers of equal key tuples, given arrays already sorted by them."""
    new = np.zeros(len(keys[0]), bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


ANCHORS = (np.uint64, np.int64, np.int32, np.uint8)  # anchor, doc_id, partition of the document, state
ONE, MANY, KNOWN = 0, 1, 2  # an anchor of one document of the task, of several, and one that needn't meet the others


def _fresh(*keys: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for key in keys:
        out[1:] |= key[1:] != key[:-1]
    return out


def _send_anchors(count: int, window: int, size: int):
    def rows(parts: list[tuple]) -> pa.RecordBatch:
        best, doc, home = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((home, doc, best))
        best, doc, home = best[order], doc[order], home[order]
        keep = _fresh(best, doc, home)
        best, doc, home = best[keep], doc[keep], home[keep]
        first, group = _fresh(best), _repeats([best])
        many = np.bincount(group)[group] > 1
        known = many & ~first
        out = list(_split((best[first] % np.uint64(count)).astype(np.int64), best[first], doc[first], home[first], np.where(many[first], MANY, ONE).astype(np.uint8)))
        return _batch(out + list(_split(home[known], best[known], doc[known], home[known], np.full(known.sum(), KNOWN, np.uint8))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            bounds, data = texts_of(batch.column("text"))
            ids, homes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "_to"))
            for i, j in groups_of(bounds, SLICE):
                firsts, hashes = words_of(bounds[i : j + 1] - bounds[i], data[bounds[i] : bounds[j]])
                starts, _, best = anchors(hashes, firsts, window, size)
                if not len(starts):
                    continue
                row = np.repeat(np.arange(i, j), np.diff(firsts))[starts]
                keep = _fresh(best, row)
                parts.append((best[keep], ids[row[keep]], homes[row[keep]]))
                if sum(len(p[0]) for p in parts) >= BUFFER:
                    yield rows(parts)
                    parts = []
        if parts:
            yield rows(parts)

    return send


def _return_anchors(key: tuple, table: pa.Table) -> pa.Table:
    best, doc, home, state = _gather([table], ANCHORS)
    known = state == KNOWN
    rest = [x[~known] for x in (best, doc, home, state)]
    order = np.argsort(rest[0], kind="stable")
    rest_best, rest_doc, rest_home, rest_state = (x[order] for x in rest)
    if len(rest_best):
        group, at = _repeats([rest_best]), np.flatnonzero(_fresh(rest_best))
        many = (np.minimum.reduceat(rest_doc, at) < np.maximum.reduceat(rest_doc, at)) | (np.maximum.reduceat(rest_state, at) == MANY)
        chosen = many[group]
        rest_best, rest_doc, rest_home = rest_best[chosen], rest_doc[chosen], rest_home[chosen]
    out = [np.concatenate(pair) for pair in ((best[known], rest_best), (doc[known], rest_doc), (home[known], rest_home))]
    return pa.Table.from_batches([_batch(list(_split(out[2], out[0], out[1])))])


def _sorted(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, ordinals among equal ids, bounds and bytes of a partition's texts by (doc_id, text)."""
    texts = texts.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = texts.column("doc_id").to_numpy()
    bounds, data = texts_of(texts.column("text"))
    at = np.arange(len(ids))
    return ids, at - np.maximum.accumulate(np.where(_fresh(ids), at, 0)), bounds, data


#: A place is a partition, a document's id there, its ordinal among equal ids there, and a word of it.
PLACE = (np.int32, np.int64, np.uint32, np.int64)
PATHS = (*PLACE, np.int64, *PLACE)  # where a path lies, its number of edges, and where its source lies
WITNESSED = (*PATHS, np.uint64, np.uint64)  # and the digest of the source's words


def _paths(here: list[np.ndarray], source: list[np.ndarray]) -> list[np.ndarray]:
    """Edges at the places `here`, in order, compacted to paths whose places and sources advance together."""
    same = np.zeros(len(here[0]), bool)
    same[1:] = True
    for place in (here, source):
        for x in place[:3]:
            same[1:] &= x[1:] == x[:-1]
        same[1:] &= place[3][1:] == place[3][:-1] + 1
    at = np.flatnonzero(~same)
    return [*(x[at] for x in here), np.diff(np.append(at, len(same))), *(x[at] for x in source)]


def _sources(best, wide, offset, here: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each edge the place of the equal one with the least (doc_id, word), and whether it is that one itself."""
    order = np.lexsort((here[0], here[2], here[3], here[1], offset, wide, best))
    first = _fresh(best[order], wide[order], offset[order])
    group = np.cumsum(first) - 1
    source = []
    for x in here:
        found = np.empty_like(x)
        found[order] = x[order][first][group]
        source.append(found)
    leads = np.zeros(len(best), bool)
    leads[order[first]] = True
    return source, leads


EDGES = (np.uint64, np.uint64, np.uint8, *PLACE)


def _send_edges(count: int, window: int, size: int):
    def send(key: tuple, texts: pa.Table, flags: pa.Table) -> pa.Table:
        flag_best, flag_doc = _gather([flags], (np.uint64, np.int64))
        if not len(flag_best) or not len(texts):
            return pa.Table.from_batches([_batch([])])
        ids, ordinals, bounds, data = _sorted(texts)
        with np.errstate(over="ignore"):
            wanted = np.unique(flag_best * np.uint64(0x9E3779B97F4A7C15) ^ flag_doc.astype(np.uint64))
        found: list[list[np.ndarray]] = []
        flagged_docs = np.isin(ids, flag_doc)
        for i, j in groups_of(bounds, 1 << 20):
            if not flagged_docs[i:j].any():
                continue
            firsts, hashes = words_of(bounds[i : j + 1] - bounds[i], data[bounds[i] : bounds[j]])
            starts, places, best = anchors(hashes, firsts, window, size)
            if not len(starts):
                continue
            row = np.repeat(np.arange(i, j), np.diff(firsts))[starts]
            with np.errstate(over="ignore"):
                hit = np.isin(best * np.uint64(0x9E3779B97F4A7C15) ^ ids[row].astype(np.uint64), wanted)
            wide = grams(hashes, window, 0xDA942042E4DD58B5)[starts[hit]]
            found.append([best[hit], wide, (places - starts)[hit].astype(np.uint8), row[hit], starts[hit] - firsts[row[hit] - i]])
        if not found:
            return pa.Table.from_batches([_batch([])])
        best, wide, offset, row, start = (np.concatenate(x) for x in zip(*found))
        here = [np.full(len(row), key[0].as_py(), np.int32), ids[row], ordinals[row].astype(np.uint32), start]
        source, leads = _sources(best, wide, offset, here)
        covered = source[1] < here[1]  # settled here; only one edge of each group asks the others
        rows = [(to, b"P" + blob) for to, blob in _placed([x[covered] for x in here], [x[covered] for x in source])]
        # edges with a local source of equal id, in another row or place, go by their own: they aren't covered by it
        ask = ~covered & (leads | (source[1] == here[1]))
        asked = [x[ask] for x in (best, wide, offset, *here)]
        rows += [(to, b"E" + blob) for to, blob in _split((asked[0] % np.uint64(count)).astype(np.int64), *asked)]
        return pa.Table.from_batches([_batch(rows)])

    return send


def _placed(here: list[np.ndarray], source: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Edges with their sources as paths, packed for the sources' partitions."""
    order = np.lexsort((here[3], here[2], here[1], here[0]))
    paths = _paths([x[order] for x in here], [x[order] for x in source])
    return _split(paths[5], *paths)


def _compact(key: tuple, table: pa.Table) -> pa.Table:
    blobs = table.column("packed").to_pylist()
    asked = [_unpack(b[1:], EDGES) for b in blobs if b[:1] == b"E"]
    rows = [(key[0].as_py(), b[1:]) for b in blobs if b[:1] == b"P"]  # settled, and already where their sources are
    if asked:
        best, wide, offset, *here = (np.concatenate(x) for x in zip(*asked))
        source, _ = _sources(best, wide, offset, here)
        covered = source[1] < here[1]
        rows += _placed([x[covered] for x in here], [x[covered] for x in source])
    return pa.Table.from_batches([_batch(rows)])


def _rows_of(ids: np.ndarray, ordinals: np.ndarray, doc: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    """The row of each (doc, ordinal) among texts that are sorted by id."""
    return np.searchsorted(ids, doc) + ordinal.astype(np.int64)


def _digest(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(b" ".join(words), digest_size=16).digest(), np.uint64)


def _witness(window: int):
    """Adds to paths the digest of the words at their sources, and sends them on to their documents."""

    def witness(key: tuple, texts: pa.Table, paths: pa.Table) -> pa.Table:
        found = _gather([paths], PATHS)
        if not len(found[0]):
            return pa.Table.from_batches([_batch([])])
        ids, ordinals, bounds, data = _sorted(texts)
        raw, row = data.tobytes(), _rows_of(ids, ordinals, found[6], found[7])
        order = np.lexsort((found[4], found[8], row))
        digests = np.zeros((len(row), 2), np.uint64)
        held, last = None, None
        for k in order:
            if held != row[k]:
                held, words = row[k], raw[bounds[row[k]] : bounds[row[k] + 1]].split()
            span = (held, found[8][k], found[4][k])
            if span != last:
                last, digest = span, _digest(words[found[8][k] : found[8][k] + found[4][k] + window - 1])
            digests[k] = digest
        return pa.Table.from_batches([_batch(list(_split(found[0], *found, digests[:, 0], digests[:, 1])))])

    return witness


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,words:long,source_doc_id:long,source_start:long>>, kept_text string"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source_doc_id", pa.int64()), ("source_start", pa.int64())]))


def _remove(window: int, with_text: bool):
    def remove(key: tuple, texts: pa.Table, paths: pa.Table) -> pa.Table:
        ids, ordinals, bounds, data = _sorted(texts)
        found = _gather([paths], WITNESSED)
        row = _rows_of(ids, ordinals, found[1], found[2])
        order = np.lexsort((found[3], row))
        row = row[order]
        start, edges, source, source_start, low, high = (found[k][order] for k in (3, 4, 6, 8, 9, 10))
        raw = data.tobytes()
        out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text")}
        bound = np.searchsorted(row, np.arange(len(ids) + 1))
        for r, doc_id in enumerate(ids):
            words = raw[bounds[r] : bounds[r + 1]].split()
            removed, spans, kept = 0, [], words
            mine = []
            for k in range(bound[r], bound[r + 1]):
                digest = _digest(words[start[k] : start[k] + edges[k] + window - 1])
                if digest[0] == low[k] and digest[1] == high[k]:
                    mine.append(k)
            if mine:
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, start[mine], 1)
                np.add.at(depth, start[mine] + edges[mine] + window - 1, -1)
                stays = np.cumsum(depth[:-1]) == 0
                kept = [words[k] for k in np.flatnonzero(stays)]
                removed = len(words) - len(kept)
                spans = [{"start": int(start[k]), "words": int(edges[k]) + window - 1, "source_doc_id": int(source[k]), "source_start": int(source_start[k])} for k in mine]
            text = b" ".join(kept)
            out["doc_id"].append(None if doc_id == LAST else int(doc_id))
            out["n_words"].append(len(words))
            out["n_removed"].append(removed)
            out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
            out["spans"].append(spans)
            out["kept_text"].append(text.decode() if with_text else None)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), SPANS, pa.string())
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return remove


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_sha256, the removed spans with their sources, and,
    where asked for, kept_text: the words that stay, joined by one space."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    count = int(max(1, -(-total // BUCKET_BYTES)))
    texts = docs.withColumn("_to", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count).cast("long")).cast("int"))
    sent = texts.mapInArrow(_send_anchors(count, window, anchor), PACKED)
    flags = sent.groupBy("_to").applyInArrow(_return_anchors, PACKED)
    by_home = texts.groupBy("_to")
    edges = by_home.cogroup(flags.groupBy("_to")).applyInArrow(_send_edges(count, window, anchor), PACKED)
    paths = edges.groupBy("_to").applyInArrow(_compact, PACKED)
    witnessed = by_home.cogroup(paths.groupBy("_to")).applyInArrow(_witness(window), PACKED)
    return by_home.cogroup(witnessed.groupBy("_to")).applyInArrow(_remove(window, with_text), RESULT)
