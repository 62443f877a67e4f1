import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from lodestone.llm import mixing

from .helpers import docs, extras, odd_rows


def brute(rows, weights=(5, 2, 1), share=1.5, repeat=2):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = defaultdict(list)
    for i, t, s in rows:
        sources[s].append((hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest(), -1 if i is None else i, size(t), i))
    names = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)
    total = {s: sum(r[2] for r in sources[s]) for s in names}
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, level = set(), 0.0
    while len(capped) < len(names):
        level = (share * sum(total.values()) - sum(repeat * total[s] for s in capped)) / sum(w[s] for s in names if s not in capped)
        more = {s for s in names if level * w[s] >= repeat * total[s]} - capped
        if not more:
            break
        capped |= more
    out = []
    for s in names:
        target = float(repeat * total[s]) if s in capped else level * w[s]
        budget = math.floor(target)
        epochs = budget // total[s] if total[s] else 0
        rest = budget - epochs * total[s]
        for _, _, n, i in sorted(sources[s]):
            part = min(n, max(0, rest))
            rest -= n
            out.append((i, n, total[s], target, epochs * n + part))
    return out


def rows():
    return [(r[0], r[1], r[2]) for r in odd_rows(1, 200) if r[1] is None or len(r[1]) < 10**5]


@pytest.mark.parametrize("extra", [False, True])
def test_equals_brute_force(spark, extra):
    cases = rows()
    got = mixing.mix(docs(spark, cases, extra)).select("doc_id", "size", "source_size", "target", "taken").collect()
    key = lambda r: repr((r[0], r[1], r[2], round(r[3], 6), r[4]))
    assert sorted(map(key, got)) == sorted(map(key, brute(cases)))
    again = mixing.mix(docs(spark, cases, extra).repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_budgets_are_exact(spark):
    taken, target = Counter(), {}
    for r in mixing.mix(docs(spark, rows())).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    assert all(taken[s] == math.floor(t) for s, t in target.items())


def test_mixed_documents(spark):
    cases = rows()
    df = docs(spark, cases, True)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    words = Counter()
    assert extras(out.collect()) == extras(df.collect())
    for r in out.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id, r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.source] += r.taken
    assert words == +want


def test_empty_and_wordless(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mixed_documents(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, []), share=3.0)


def test_repeated_and_null_ids(spark):
    """Rows equal in id, source and size are told apart by their number, without a product of them."""
    cases = [(5, "a b c", "x")] * 300 + [(None, f"t{i} u", "x") for i in range(200)] + [(7, "d", None)] * 50
    got = mixing.mix(docs(spark, cases)).collect()
    assert sum(r.taken for r in got if r.source == "x") == math.floor(next(r.target for r in got if r.source == "x"))
    out = Counter(r.doc_id for r in mixing.mixed_documents(docs(spark, cases)).collect())
    assert 300 <= out[5] <= 600 and 200 <= out[None] <= 400 and 50 <= out[7] <= 100
    plan = mixing.mixed_documents(docs(spark, cases))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_python(spark):
    plan = mixing.mix(docs(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
