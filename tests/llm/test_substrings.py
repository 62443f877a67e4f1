import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import substrings

from .helpers import docs, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=13):
    first = {}
    big = float("inf")
    texts = [(big if r[0] is None else r[0], WORD.findall(r[1] or "")) for r in rows]
    for i, w in texts:
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            first[k] = min(first.get(k, big), i)
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < i:
                gone.update(range(s, s + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((None if i == big else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def shared_rows(seed):
    rng = random.Random(seed)
    text = lambda k, v=3000: " ".join(f"w{rng.randrange(v)}" for _ in range(k))
    passages = [text(rng.randrange(10, 60)) for _ in range(8)] + [text(40, 2)]
    rows = []
    for i in rng.sample(range(1000), 120):
        parts = [text(rng.randrange(0, 50)) for _ in range(rng.randrange(1, 5))]
        parts += rng.sample(passages, rng.randrange(0, 4))
        rng.shuffle(parts)
        rows.append((i, " \n".join(parts)))
    rows += [(2000 + i, rows[i % 3][1]) for i in range(30)]
    return rows


@pytest.mark.parametrize("seed,extra", [(1, False), (2, True)])
def test_equals_brute_force(spark, seed, extra, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 20_000)
    rows = shared_rows(seed) + odd_rows(seed)
    got = substrings.dedup(docs(spark, rows, extra).repartition(5)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_spans_name_their_sources(spark):
    rows = shared_rows(4)
    words = {i: WORD.findall(t) for i, t in rows}
    seen = defaultdict(int)
    for r in substrings.dedup(docs(spark, rows), with_text=True).collect():
        for s in r.spans:
            seen[r.doc_id] += 1
            assert s.source_doc_id < r.doc_id
            assert words[r.doc_id][s.start : s.start + s.words] == words[s.source_doc_id][s.source_start : s.source_start + s.words]
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert seen


def test_empty(spark):
    assert substrings.dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("ids", ["strided", "null", "repeated"])
def test_ids_do_not_crowd_partitions(spark, monkeypatch, ids):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 5_000)
    rows = [({"strided": 2500 * i, "null": None, "repeated": 5}[ids] if i % 5 else i, t) for i, t in shared_rows(6)]
    out = substrings.dedup(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)
    assert "pmod(xxhash64(doc_id" in out._jdf.queryExecution().analyzed().toString()


def test_paths_are_checked_at_their_sources():
    """A path whose source has other words than the document removes nothing, whatever the hashes said."""
    words = [f"w{i}" for i in range(40)]
    texts = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": [" ".join(words), " ".join(words[:20])]})
    for source_start, removed in ((0, 20), (3, 0)):
        path = [np.array([x], kind) for x, kind in zip((0, 2, 0, 0, 8, 0, 1, 0, source_start), substrings.PATHS)]
        paths = pa.table({"packed": pa.array([substrings._pack(*path)], pa.binary())})
        witnessed = substrings._witness(13)((pa.scalar(0),), texts, paths)
        assert substrings._remove(13, False)((pa.scalar(0),), texts, witnessed).column("n_removed").to_pylist() == [0, removed]


def test_split_costs_what_is_there():
    to = np.array([10**9, 5, 10**9, 7])
    assert [(k, substrings._unpack(b, (np.int64,))[0].tolist()) for k, b in substrings._split(to, np.arange(4))] == [(5, [1]), (7, [3]), (10**9, [0, 2])]
