import random
import zlib

import numpy as np
import pytest

from lodestone.llm import toxicity

from .helpers import docs, extras, odd_rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    words = ["stupid", "idiot", "scums", "loser", "losers", "aabab"]
    machine = toxicity.Automaton(words)
    for _ in range(4000):
        base = list(rng.choice(words))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(base) + 1)
            op = rng.randrange(3)
            base[k : k + (op > 0)] = [rng.choice("abstulxyz")] if op < 2 else []
        word = "".join(base)
        assert (machine.match(word) >= 0) == any(distance(word, w) <= 1 for w in words), word


def test_context_and_misspellings():
    matcher = toxicity.Matcher(["idiot", "stup*"])
    plain, near, quoted = matcher.counts("you idiot, so stupid"), matcher.counts("you 1diot and idiiot"), matcher.counts('he said "what an idiot" there')
    assert plain[:5].tolist() == [1, 1, 0, 0, 0.5]
    assert near[2] == 2 and near[0] == 0
    assert quoted[0] == 0 and quoted[3] == 1


def test_disguised_and_misspelled_starts():
    matcher = toxicity.Matcher(["lose*", "vermi*"])
    near = lambda text: matcher.counts(text)[2]
    assert near("l0sers") == near("1osing l0$er") == near("v3rminous") == 1
    assert near("vremin") == 0 and near("vxrminous") == near("verrminous") == near("vrminous") == 1
    assert near("losers verminous other words") == 0
    rng = random.Random(5)
    machine = toxicity.Automaton(["vermi", "dolty"])
    for _ in range(2000):
        word = "".join(rng.choice("vermidolty") if rng.random() < 0.2 else c for c in rng.choice(["verminous", "doltyness", "vermi", "ermine", "dolt"]))
        want = any(distance(word[:k], w) <= 1 for w in ("vermi", "dolty") for k in range(len(word) + 1))
        assert machine.begins(word) == want, word


def labelled(n=600, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "un"]) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = rng.choice(["vermin,", "Dolt", "zimbo" + rng.choice(["x", "y", "ne"])])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.mark.parametrize("extra", [False, True])
def test_held_out_accuracy(spark, extra):
    rows, labels = labelled()
    rows += [(r[0] and r[0] + 9000, r[1]) for r in odd_rows()]
    table = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(docs(spark, rows, extra), table).collect()
    assert len(out) == len(rows)
    truth = {i: t for i, _, t in labels}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    judged = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in judged]) > 0.97


def test_no_term_is_cut_by_frequency(spark):
    letters = "abcdefghijklmnop"
    common = " ".join([a + b + c + d for a in letters for b in letters for c in letters for d in letters if a < "h"] * 2)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2][:16]
    table = spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    lexicon, *_ = toxicity.learn(docs(spark, [(i, common + (" vermin" if k % 2 else "")) for k, i in enumerate(ids)]), table)
    assert lexicon == ["vermin"]


def test_kept_documents_and_no_labels(spark):
    rows, labels = labelled(300)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = docs(spark, rows, True)
    kept = toxicity.kept_documents(df, table)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    assert abs(kept.count() - sum(1 - t for *_, t in labels)) < 10
    assert extras(kept.collect()) == extras(df.collect())
    none = table.limit(0)
    assert [r.predicted for r in toxicity.scored(docs(spark, [(1, "you moron"), (2, "a day")]), none).orderBy("doc_id").collect()] == [1, 0]
    assert toxicity.scored(docs(spark, []), none).count() == 0


def test_quotation_marks_are_paired():
    matcher = toxicity.Matcher(["idiot"])
    quoted = lambda text: matcher.counts(text)[2] == 1
    long = " ".join(["word"] * 10)
    assert quoted('"you idiot"') and quoted("«you idiot, you»") and quoted("„du idiot“ so") and quoted(f'"{long} idiot {long}"')
    assert quoted('"hello" and "you idiot, bye" now') and quoted('she said "idiot and went') and quoted('"idiot"')
    assert not quoted('"hello" you idiot "bye" now')
    assert not quoted("the dogs' leash, you idiot, and the students' work")
    assert not quoted("you idiot") and not quoted('"a" b "c" idiot "d" e "f"')


def test_scores_equal_brute_force(spark):
    """Scores of whole texts against features counted from the terms' definition, without automaton or caches."""
    rows, labels = labelled(200, 5)
    rng = random.Random(8)
    rows += [(5000 + i, " ".join(rng.choice(["vermin", "verminx", "vrmin", "D0lt", "dolts", "zimbo", "z1mboxx", "ka", "lo", '"dolt"', "«vermin", "zimbo»", "said"]) for _ in range(rng.randrange(30)))) for i in range(120)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    lexicon, intercept, weights = toxicity.learn(df, table)
    whole, starts = [t for t in lexicon if t[-1] != "*"], [t[:-1] for t in lexicon if t[-1] == "*"]

    def terms(raw):
        word = raw.strip(toxicity.STRIP)
        plain = word.translate(toxicity.ALIKE)
        hits = lambda w: [i for i, t in enumerate(lexicon) if w.isalpha() and len(w) > 2 and (w == t or t[-1] == "*" and w.startswith(t[:-1]))]
        found = hits(word)
        if word in whole:
            return found
        near = plain != word and bool(hits(plain))
        for w in {word, plain}:
            if len(w) >= 4:
                near |= any(distance(w, t) <= 1 for t in whole if len(t) >= 5)
                near |= not found and any(distance(w[:k], t) <= 1 for t in starts if len(t) >= 5 for k in range(len(w) + 1))
        return found + [len(lexicon)] * near

    for r in toxicity.scored(df, table).collect():
        words = (dict(rows)[r.doc_id] or "").lower().split()
        counts = np.zeros(len(lexicon) + 4)
        for i, word in enumerate(words):
            found = terms(word)
            if found and toxicity.Matcher.quoted(words, i):
                counts[-3] += 1
            elif found:
                counts[-1] += 1
                for k in found:
                    counts[k] += 1
        x = np.log1p(counts)
        x[-2] = (counts[-1] / max(1, len(words))) ** 0.5
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(intercept + x @ weights, -30, 30)))) < 1e-9, words
