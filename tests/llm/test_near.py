import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import near
from lodestone.llm.graph import components

from .helpers import docs, extras, odd_rows


def variants(seed):
    """Groups of near copies at many distances, chains, exact copies in other case and spacing, shared passages."""
    rng = random.Random(seed)
    text = lambda k: [f"w{rng.randrange(4000)}" for _ in range(k)]
    rows, passage = [], text(30)
    for g in range(25):
        base = text(rng.randrange(20, 300)) + (passage if g % 3 == 0 else [])
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                rows.append((len(rows), "\n".join(copy).upper()))
            if g % 5 == 0:
                base = copy
    return rows


def brute(spark, rows, least=0.8):
    """Classes by all pairs, with the operator's document frequencies."""
    idf = near.inverse_frequencies(docs(spark, rows))
    texts = [tuple((r[1] or "").translate({i: i + 32 for i in range(65, 91)}).split()) for r in rows]
    weights = []
    from lodestone.llm.arrow import texts_of, words_of
    import pyarrow as pa

    for r in rows:
        firsts, hashes = words_of(*texts_of(pa.array([r[1] or ""])), lower=True)
        w = [float(x) for x in idf[near._class(hashes)]]
        words, n = texts[len(weights)], min(5, len(texts[len(weights)]))
        bag = defaultdict(float)
        for i in range(len(words) - n + 1 if n else 0):
            bag[words[i : i + n]] += round(sum(w[i : i + n]) / n, 4)
        weights.append(bag)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = weights[i], weights[j]
            shared = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
            if texts[i] == texts[j] or (a and b and shared / (sum(a.values()) + sum(b.values()) - shared) >= least):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    return Counter((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)


@pytest.mark.parametrize("seed,extra", [(1, False), (2, True)])
def test_classes_equal_brute_force(spark, seed, extra):
    rows = variants(seed) + [(None if r[0] is None else r[0] + 10_000, r[1]) for r in odd_rows(seed, 20)]
    got = Counter(map(tuple, near.classes(docs(spark, rows, extra)).collect()))
    assert got == brute(spark, rows)


def test_blocks_settle_what_stars_leave(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 3)
    monkeypatch.setattr(near, "SPREAD", 2)
    rng = random.Random(9)
    text = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):  # a chain: neighbours are alike, the ends are not
        rows.append((i, " ".join(text)))
        for _ in range(1):
            text[rng.randrange(200)] = f"y{i}"
            text[(i * 7) % 200] = f"z{i}"
    assert Counter(map(tuple, near.classes(docs(spark, rows)).collect())) == brute(spark, rows)


def test_kept_documents(spark):
    rows = variants(3) + odd_rows(3, 10)
    kept = near.kept_documents(docs(spark, rows))
    groups = brute(spark, rows)
    assert kept.columns == docs(spark, rows).columns
    assert kept.count() == round(sum(n / size for (_, _, size), n in groups.items()))
    assert {r.doc_id for r in kept.collect()} == {name for _, name, _ in groups}
    assert len(near.kept_documents(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words than those there")])).collect()) == 2


def test_samples_estimate_similarity():
    rng = np.random.default_rng(1)
    what = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    left, right = what[:900], what[100:]
    weight = rng.random(1000) + 0.5
    both = near.sampled(np.array([0, 900, 1800]), np.concatenate((left, right)), np.concatenate((weight[:900], weight[100:])))
    assert abs((both[0] == both[1]).mean() - near.similarity((left, weight[:900]), (right, weight[100:]))) < 0.2


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, i) for i in range(101, 150)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {i: find(i) for a, b in edges if a != b for i in (a, b)}
    assert dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == want


def test_empty(spark):
    assert near.classes(docs(spark, [])).count() == 0
    assert near.kept_documents(docs(spark, [])).count() == 0


def test_template_pages_are_not_paired(spark, monkeypatch):
    """Pages of one template at a similarity just under 0.8: as many verified pairs as bucket members, not all of them."""
    asked = []
    verified = near._verified
    monkeypatch.setattr(near, "_verified", lambda pairs, *more: (asked.append(pairs.count()), verified(pairs, *more))[1])
    rng = random.Random(6)
    words = lambda k: [f"w{rng.randrange(50_000)}" for _ in range(k)]
    template, rows = words(400), []
    for i in range(60):
        k, own = rng.randrange(350), words(60)
        rows.append((i, " ".join(template[:k] + own[:30] + template[k:380] + own[30:] + template[380:])))
    found = near.classes(docs(spark, rows)).collect()
    assert len({r.class_id for r in found}) == 60
    assert asked[0] < 16 * 60 and sum(asked[1:]) < 60


def test_null_and_repeated_ids(spark):
    """Rows without ids, or of one id, are documents of their own, and no key of a join."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(40)]
    rows = [(None, t) for t in texts] + [(3, t + " more") for t in texts] + [(3, texts[0])] * 30
    assert Counter(map(tuple, near.classes(docs(spark, rows)).collect())) == brute(spark, rows)
    kept = near.kept_documents(docs(spark, rows, True)).collect()
    assert len(kept) == 40 and extras(kept) == extras(docs(spark, rows[:1], True).collect())
