"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are tokenized once, whole, where they are read; each is cut into windows-full of tokens and a rest (that
of one in `GRAIN_SHARE` again, at the binary digits of its length, for pieces to level windows with), and only rows of ids, lengths and checksums go on. Full pieces are windows of their own. Rests are spread by a hash of
their ids and row numbers over blocks of about `BLOCK_WINDOWS` windows, and in each block differencing partitions them into as few
windows as their sum allows: every piece starts as a partition of one part; again and again the two partitions of
the largest imbalance are merged, the largest part of one with the smallest of the other, until one is left. If a
part exceeds the window, the number of windows rises by one and the block is partitioned anew.

The number of blocks follows from the sum of all tokens, so a block's size doesn't depend on the data's, and hot
sources or ids aren't keys of anything. A block is redone alike if its executor is lost.

Tokenizing: words between blanks repeat, so each worker keeps their token ids (`CACHE` of them at most) and only
new words are tokenized; a word's ids don't depend on its neighbours as this tokenizer splits at blanks. Texts with
characters whose class may differ between Unicode versions, control characters or special tokens take the tokenizer
itself. Both ways give the same ids.

Defined results: null is the empty text, which has the one end id; repeated rows are packed each, with pieces
of their own; an empty table gives an empty result. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, written

WINDOW = 4096
BLOCK_WINDOWS = 256
GRAIN_SHARE = 8
CACHE = 600_000
END = 2
UNSAFE = re.compile("[^\t\n\r\x20-\x7e¡-įı-ɏ‐-‧€]|<\\|")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Numbers(dict):
    """Numbers words in the order in which they are first looked up."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Token ids of texts by the tokenizer file at `path`, with a cache of words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            raw = json.load(file)
        self.whole = Tokenizer.from_file(path)
        kinds = [x["type"] for x in (raw.get("normalizer") or {}).get("normalizers", [])]
        split = (raw.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = (
            kinds == ["NFC", "Replace", "Lowercase"] and raw["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
            and len(split) == 2 and split[0].get("behavior") == "Removed" and split[0].get("invert") is True
            and split[0]["pattern"].get("Regex", "").endswith("[^\\s\\p{L}\\p{N}]+") and split[1].get("use_regex") is False
        )
        self.clear()
        self.pieces: dict[str, bytes] = {}  # ids as packed integers; quick to make words of again
        if self.by_word:
            self.split = regex.compile(split[0]["pattern"]["Regex"])
            raw["normalizer"], raw["pre_tokenizer"], raw["added_tokens"] = None, split[1], []
            self.piece = Tokenizer.from_str(json.dumps(raw))

    def clear(self) -> None:
        self.index = Numbers()
        self.firsts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Keeps the ids of `words`; pieces that words share are tokenized once."""
        cut = []
        for word in words:
            if word.isalpha():
                cut.append((word,))
            elif word[-1] in ".," and word[:-1].isalpha():
                cut.append((word[:-1], word[-1]))
            else:
                cut.append(self.split.findall(word))
        known = self.pieces
        new = list(set().union(*cut).difference(known))
        known.update(zip(new, (array("I", e.ids).tobytes() for e in self.piece.encode_batch_fast(new, add_special_tokens=False))))
        found = [known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p)) for p in cut]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        self.firsts = np.concatenate((self.firsts, len(self.ids) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.ids = np.concatenate((self.ids, flat))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        out: list = [None] * len(texts)
        plain = [i for i, text in enumerate(texts) if self.by_word and not UNSAFE.search(text)]
        chosen = set(plain)
        for i, text in enumerate(texts):
            if i not in chosen:
                out[i] = np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        if not plain:
            return out
        words = [texts[i].lower().split() for i in plain]
        if len(self.index) > CACHE:
            self.clear()
        if len(self.pieces) > 2 * CACHE:
            self.pieces.clear()
        counts, known = np.fromiter(map(len, words), np.int64, len(words)), len(self.index)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if len(self.index) > known:
            self._learn(list(islice(reversed(self.index), len(self.index) - known))[::-1])
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        steps = np.repeat(self.firsts[at] - (ends - lengths), lengths) + np.arange(total)
        flat = self.ids[steps]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        for k, i in enumerate(plain):
            out[i] = flat[bounds[k] : bounds[k + 1]]
        return out


def cuts(ids: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then the rest.

    The rest of one document in `GRAIN_SHARE`, by the checksum of its ids, is cut at its length's binary digits, so
    each block has pieces of all sizes to level its windows with.
    """
    full = len(ids) // window * window
    found, at = [(s, window) for s in range(0, full, window)], full
    rest = len(ids) - full
    if rest and zlib.crc32(ids.tobytes()) % GRAIN_SHARE == 0:
        for digit in reversed(range(rest.bit_length())):
            if rest >> digit & 1:
                found.append((at, 1 << digit))
                at += 1 << digit
    elif rest:
        found.append((full, rest))
    return found


def _cutter(path: str, window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("packing", path), lambda: Encoder(path))
        for whole in batches:
            for k in range(0, len(whole), 256):
                batch = whole.slice(k, 256)
                rows: list[tuple] = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode([x or "" for x in batch.column("text").to_pylist()])):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    rows += [(doc_id, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in cuts(ids, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Every document's pieces of at most `window` tokens, its end id included."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(_cutter(vocabulary or default_vocabulary(), window), PIECES)


def differenced(lengths: list[int], parts: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of `lengths` in `parts` parts of near-equal sums."""
    if not lengths:
        return [[] for _ in range(parts)]
    trees: list[tuple] = [(i,) for i in range(len(lengths))]  # a leaf, or two trees' numbers

    def join(a: int, b: int) -> int:
        trees.append((a, b))
        return len(trees) - 1

    # a partition: the sums, in descending order, of the parts that hold something, less the least if all do; and
    # their trees. Parts that hold nothing aren't stored, so memory follows the number of pieces.
    start = [(-length if parts > 1 else 0, i, np.array([length]), np.array([i])) for i, length in enumerate(lengths)]
    heapq.heapify(start)
    count = len(start)
    while len(start) > 1:
        _, _, sums_a, nodes_a = heapq.heappop(start)
        _, _, sums_b, nodes_b = heapq.heappop(start)
        both = len(sums_a) + len(sums_b) - parts  # as many parts of one meet a part of the other
        if both <= 0:
            sums, nodes = np.concatenate((sums_a, sums_b)), np.concatenate((nodes_a, nodes_b))
        else:
            alone, other, trees_b = len(sums_a) - both, sums_b[::-1], nodes_b[::-1]
            met = [join(int(x), int(y)) for x, y in zip(nodes_a[alone:], trees_b[:both])]
            sums = np.concatenate((sums_a[:alone], sums_a[alone:] + other[:both], other[both:]))
            nodes = np.concatenate((nodes_a[:alone], met, trees_b[both:])).astype(np.int64)
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == parts:
            sums = sums - sums[-1]
        count += 1
        heapq.heappush(start, (-int(sums[0]), count, sums, nodes))
    out = []
    for root in start[0][3]:
        leaves, todo = [], [int(root)]
        while todo:
            tree = trees[todo.pop()]
            if len(tree) == 1:
                leaves.append(tree[0])
            else:
                todo.extend(tree)
        out.append(leaves)
    return out + [[] for _ in range(parts - len(out))]


def windows(lengths: list[int], window: int) -> list[list[int]]:
    """As few parts as the sum allows; one more each time a part is over `window`."""
    parts = max(1, -(-sum(lengths) // window))
    while True:
        found = differenced(lengths, parts)
        if all(sum(lengths[i] for i in part) <= window for part in found):
            return [sorted(part) for part in found if part]
        parts += 1


def _packer(window: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        lengths = table.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        rest = [i for i, n in enumerate(lengths) if n < window]
        found = [[i] for i, n in enumerate(lengths) if n == window] + [[rest[i] for i in part] for part in windows([lengths[i] for i in rest], window)]
        for number, part in enumerate(found):
            at = 0
            for i in part:
                sequence[i], offset[i] = (key[0].as_py() << 32) + number, at
                at += lengths[i]
        return table.drop_columns(["_block"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return pack


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    cut = written(pieces(docs, vocabulary, window).withColumn("_no", F.monotonically_increasing_id()), "pieces")
    total = cut.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(total / (window * block_windows)))
    # the row's number spreads copies of one piece over the blocks too
    placed = cut.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start", "_no"), F.lit(blocks))).drop("_no")
    return placed.groupBy("_block").applyInArrow(_packer(window), PIECES + ", sequence_id long, offset long")
