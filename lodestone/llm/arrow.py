"""Texts of Arrow batches as bytes, and words of bytes as hashes, without a Python object for each word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII blanks: \x20 and \x09-\x0D.
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BLOCK = 1 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, base, dtype=np.uint64)) * np.uint64(pow(int(base), -1, 1 << 64))


POWERS = _powers(BASE, BLOCK + 1)
INVERSES = _powers(np.uint64(pow(int(BASE), -1, 1 << 64)), BLOCK + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes) of a string array: text i is bytes[bounds[i]:bounds[i + 1]]; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    whole = np.frombuffer(data, dtype=np.uint8)
    return bounds - bounds[0], whole[bounds[0] : bounds[-1]]


def groups_of(bounds: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `most` bytes together, or one text."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, j
        i = j


def _block(b: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and hashes of the words of a block; words also start at `starts_at`."""
    is_word = IS_WORD[b]
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[starts_at] = True
    before = np.concatenate(([False], is_word))
    after = np.concatenate((is_word, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * POWERS[: len(b)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * INVERSES[starts]
        hashes = mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return starts, ends, hashes


def words_of(bounds: np.ndarray, data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(firsts, hashes): 64-bit hashes of the words of all texts in order; text i has words firsts[i]:firsts[i + 1].

    Works in blocks of at most about 1 MB of bytes, so memory follows the words. A word longer than a block is
    hashed by BLAKE2b.
    """
    if lower:
        data = LOWER[data]
    hashes, counts = [], np.zeros(len(bounds) - 1, dtype=np.int64)
    for i, j in groups_of(bounds):
        lo, hi = int(bounds[i]), int(bounds[j])
        if hi - lo <= BLOCK:
            at = bounds[i : j + 1] - lo
            starts, _, h = _block(data[lo:hi], at)
            hashes.append(h)
            counts[i:j] = np.diff(np.searchsorted(starts, at, side="left"))
            continue
        while lo < hi:  # one long text, cut at blanks
            end = min(hi, lo + BLOCK)
            if end < hi:
                blanks = np.flatnonzero(~IS_WORD[data[lo:end]])
                if len(blanks):
                    end = lo + int(blanks[-1]) + 1
                else:
                    while end < hi and IS_WORD[data[end]]:
                        end += 1
                    if end - lo > BLOCK:
                        digest = hashlib.blake2b(data[lo:end].tobytes(), digest_size=8).digest()
                        hashes.append(np.frombuffer(digest, dtype=np.uint64))
                        counts[i] += 1
                        lo = end
                        continue
            _, _, h = _block(data[lo:end], np.zeros(0, dtype=np.int64))
            hashes.append(h)
            counts[i] += len(h)
            lo = end
    firsts = np.zeros(len(bounds), dtype=np.int64)
    np.cumsum(counts, out=firsts[1:])
    return firsts, np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)


def grams(hashes: np.ndarray, n: int, base: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of the n-gram that starts at each of the first len - n + 1 words."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        out = np.zeros(m, dtype=np.uint64)
        for k in range(n):
            out = out * np.uint64(base) + hashes[k : k + m]
    return mixed(out)


def list_column(values: np.ndarray, firsts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(values, type=kind))
