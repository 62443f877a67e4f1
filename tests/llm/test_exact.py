import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact

from .helpers import docs, extras, odd_rows

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


CASES = [(i, t) for i, t in enumerate(["É", "é", "AK", "ak", "aK", "İ", "i̇", " a", "a ", "a"])] + odd_rows()


@pytest.mark.parametrize("extra", [False, True])
def test_equals_brute_force(spark, extra):
    got = sorted(map(tuple, exact.dedup(docs(spark, CASES, extra)).collect()), key=repr)
    assert got == brute(CASES)


def test_hot_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT_SHARE", 4)
    rows = CASES + [(5000 + i, "Hot text" if i % 2 else "hot TEXT") for i in range(200)]
    assert sorted(map(tuple, exact.dedup(docs(spark, rows)).collect()), key=repr) == brute(rows)


def test_colliding_digests_dont_merge_texts(spark):
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 2)
    rows = CASES + [(5000 + i, f"text {i % 70}") for i in range(300)]
    assert sorted(map(tuple, exact.dedup(docs(spark, rows), weak).collect()), key=repr) == brute(rows)


def test_kept_documents(spark):
    df = docs(spark, CASES, True)
    kept = exact.kept_documents(df)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    assert extras(kept.collect()) == extras(df.collect())
    assert [r.doc_id for r in exact.kept_documents(docs(spark, [(None, "a")] * 5 + [(4, "B")] * 3 + [(3, "b")])).orderBy("doc_id").collect()] == [None, 4]
    assert sorted((r.text or "").translate(LOWER) for r in kept.collect()) == sorted({(r[1] or "").translate(LOWER) for r in CASES})


def test_empty(spark):
    assert exact.dedup(docs(spark, [])).count() == 0
    assert exact.kept_documents(docs(spark, [])).count() == 0
