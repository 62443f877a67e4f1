import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lodestone.llm import exact, mixing, near, packing, toxicity

from .helpers import docs, odd_rows
from .test_exact import brute as exact_brute
from .test_mixing import brute as mix_brute
from .test_near import brute as near_brute
from .test_near import variants
from .test_toxicity import labelled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels = labelled(200)
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["a", "b", None])) for i, t in rows] + [(1000 + i, t, "n") for i, t in variants(5)]
    rows += [(3900 if i is None else 3000 + i, t.upper() if t and i and i % 2 else t, s) for i, t, s in odd_rows() if i not in (1003, 1004)]
    docs(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_equal_brute_force(spark, folder):
    """Each stage's result against a brute-force version on the stage's own input."""
    before = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text, r.source) for r in before.collect()]
        out = stage(spark, before, folder)
        after = out.collect()
        if name == "toxicity":
            lexicon, intercept, weights = toxicity.learn(before, spark.read.parquet(f"{folder}/labels.parquet"))
            matcher = toxicity.Matcher(lexicon)
            want = Counter(r for r in rows if intercept + matcher.features(r[1] or "") @ weights < -0.8472978603872034)
        elif name == "exact_dedup":
            kept = {(r[0], r[-1]) for r in exact_brute(rows) if r[3]}
            want = Counter(r for r in rows if any(r[0] == k for k, _ in kept))
        elif name == "near_dedup":
            heads = {c for _, c, _ in near_brute(spark, rows)}
            want = Counter(r for r in rows if r[0] in heads)
        elif name == "mixing":
            want = Counter()
            for doc_id, size, _, _, taken in mix_brute(rows):
                text = next(r for r in rows if r[0] == doc_id)
                if taken:
                    want[text] += taken // size
                    if taken % size:
                        want[doc_id, " ".join(text[1].split()[: taken % size]), text[2]] += 1
            want = +want
        else:
            tokens = Counter()
            for r in after:
                tokens[r.doc_id] += r.length
            encoder = packing.Encoder(packing.default_vocabulary())
            length = Counter()
            for (i, text, _), ids in zip(rows, encoder.encode([r[1] or "" for r in rows])):
                length[i] += len(ids) + 1
            assert tokens == length
            continue
        assert Counter((r.doc_id, r.text, r.source) for r in after) == want, name
        assert out.columns == before.columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        before = spark.read.parquet(path)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    windows = defaultdict(list)
    for r in out.collect():
        windows[r.sequence_id].append((r.offset, r.length))
    assert windows
    for window in windows.values():
        at = 0
        for offset, length in sorted(window):
            assert offset == at
            at += length
        assert at <= 4096
    assert corpus_pipeline.ORACLE_SQL is None
