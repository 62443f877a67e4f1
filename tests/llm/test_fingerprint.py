import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import fingerprint

from .helpers import docs, odd_rows


def neighbours(rows):
    """Each text's next one in descending doc_id, null last; ties aren't told apart by this."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return list(zip(order, order[1:] + order[:1]))


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def unique_rows(seed=1):
    rows, seen = [], set()
    for r in odd_rows(seed):
        if r[0] not in seen:
            seen.add(r[0])
            rows.append((r[0], r[1] if r[1] is None else r[1].replace(" of ", "\n").replace("LE", "\U0001f600")))
    return rows


@pytest.mark.parametrize("extra,rows_a_cell", [(False, 4096), (True, 1)])
def test_edited_texts_and_equality(spark, extra, rows_a_cell, monkeypatch):
    monkeypatch.setattr(fingerprint, "CELL_ROWS", rows_a_cell)
    rows = unique_rows() + [(10**15 + i * 10**12, f"far {i}\nline") for i in range(30)] + [(-5, "below\nall")]
    out = {r.doc_id: r for r in fingerprint.fingerprints(docs(spark, rows, extra)).collect()}
    assert len(out) == len(rows)
    prints = {}
    for (i, text, *_), (j, after, *_) in neighbours(rows):
        text, after = text or "", after or ""
        r = out[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited(text, after).encode()).hexdigest(), i
        assert prints.setdefault(tuple(sorted(text.split("\n"))), r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_next == 1 if sorted(text.split("\n")) == sorted(after.split("\n")) else r.near_next < 1
    assert len(set(prints.values())) == len(prints)


def test_order_insertion_and_deletion(spark):
    rng = random.Random(1)
    lines = [f"line {rng.random()}" for _ in range(50)]
    other = lines[:]
    rng.shuffle(other)
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other), "\n".join(lines[:-1]), lines[-1])], "a string, b string, c string, p string")
    a, b, c = (fingerprint.fingerprint(F.col(x)) for x in "abc")
    row = df.select((a == b).alias("same"), (fingerprint.insert(c, F.col("p")) == a).alias("grown"), (fingerprint.delete(a, F.col("p")) == c).alias("shrunk")).first()
    assert row.same and row.grown and row.shrunk


def test_likeness_follows_shared_paragraphs(spark):
    lines = [f"paragraph {i}" for i in range(400)]
    rows = [("\n".join(lines[:200]), "\n".join(lines[k : k + 200])) for k in range(0, 201, 40)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b")))).collect()]
    for k, value in zip(range(0, 201, 40), got):
        assert abs(value - (200 - k) / 200) < 0.2
    assert got[0] == 1


@pytest.mark.parametrize("rows_a_cell", [4096, 7])
def test_null_and_repeated_ids_in_hash_order(spark, monkeypatch, rows_a_cell):
    """Rows without ids or of one id, by their texts' hash, over as many cells as there is need for."""
    import xxhash

    monkeypatch.setattr(fingerprint, "CELL_ROWS", rows_a_cell)
    rng = random.Random(2)
    text = lambda: "\n".join(f"line {rng.randrange(30)}" for _ in range(rng.randrange(1, 9)))
    rows = [(None, text()) for _ in range(60)] + [(5, text()) for _ in range(60)] + [(i, text()) for i in range(20)] + [(5, "same")] * 20 + [(None, None)]
    signed = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = sorted(((i, hashlib.sha256(edited(t or "", n or "").encode()).hexdigest()) for (i, t), (_, n) in zip(order, order[1:] + order[:1])), key=repr)
    out = fingerprint.fingerprints(docs(spark, rows, True))
    assert sorted(((r.doc_id, r.edited_sha256) for r in out.collect()), key=repr) == want
    cells = fingerprint.with_neighbour(docs(spark, rows))
    assert cells.count() == len(rows)


def test_likenesses_equal_those_of_the_vectors(spark):
    rows = unique_rows(3)
    vectors = fingerprint.edited_documents(docs(spark, rows))
    pair = lambda other: fingerprint.likeness(F.col("vector"), other)
    want = vectors.select("doc_id", pair(fingerprint.fingerprint(F.col("edited"))).alias("near_edited"), pair(F.col("next_vector")).alias("near_next"))
    want = {r.doc_id: (r.near_edited, r.near_next) for r in want.collect()}
    for r in fingerprint.fingerprints(docs(spark, rows)).collect():
        assert (r.near_edited, r.near_next) == pytest.approx(want[r.doc_id], abs=1e-12)


def test_no_python(spark):
    plan = fingerprint.fingerprints(docs(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_single_tied_and_empty(spark):
    assert fingerprint.fingerprints(docs(spark, [])).count() == 0
    (r,) = fingerprint.fingerprints(docs(spark, [(1, "abcd")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprint.fingerprints(docs(spark, [(1, "x"), (1, "x"), (1, "y"), (None, "z"), (None, None)])).count() == 5
