import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import packing

from .helpers import docs, odd_rows

public_tokenizers = pytest.importorskip("public_tokenizers")


def reference(text):
    from tokenizers import Tokenizer

    tok = reference.tok = getattr(reference, "tok", None) or Tokenizer.from_file(packing.default_vocabulary())
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")


TEXTS = ["", "Don't I'm we'll 'S ''d", "a\u0130b Σς ﬁ \u1e9e", "x\x1cy\x0bz\x85w\xa0v", "<|endoftext|> hi <|startoftext|>", "réeux—„x“ 12,3 ²½", "日本 語 text", "e\u0301 \u212a\u212b", "_a_b__ $5%", "a\u2028b", "'reALLY'"]


def test_word_cache_equals_tokenizer():
    encoder = packing.Encoder(packing.default_vocabulary())
    assert encoder.by_word
    rng = random.Random(3)
    more = ["".join(rng.choice("aé'sTd .,!12\n_<|ß€’") for _ in range(50)) for _ in range(300)]
    for text, ids in zip(TEXTS + more, encoder.encode(TEXTS + more)):
        assert ids.tolist() == reference(text).tolist()[:-1], text


def test_differencing_is_near_equal():
    rng = random.Random(5)
    lengths = [rng.randrange(1, 3000) for _ in range(400)]
    parts = packing.differenced(lengths, 20)
    sums = [sum(lengths[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(400))
    assert max(sums) - min(sums) < 20
    assert packing.differenced([5], 1) == [[0]]
    assert len(packing.windows([4000] * 5, 4096)) == 5


@pytest.mark.parametrize("extra", [False, True])
def test_pack_whole(spark, extra):
    rows = odd_rows()
    out = packing.pack(docs(spark, rows, extra), window=64, block_windows=32).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.doc_tokens, r.start, r.length, r.ids_crc32))
        windows[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        ids = reference(text)
        want[doc_id] += [(len(ids), s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n in packing.cuts(ids, 64)]
        assert [s for s, _ in packing.cuts(ids, 64)] == np.cumsum([0, *(n for _, n in packing.cuts(ids, 64))]).tolist()[:-1]
        assert sum(n for _, n in packing.cuts(ids, 64)) == len(ids)
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for window in windows.values():
        at = 0
        for offset, length in sorted(window):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(n for w in windows.values() for _, n in w) > 0.97 * 64 * len(windows)


def test_empty(spark):
    assert packing.pack(docs(spark, [])).count() == 0


def test_copies_of_one_row_are_spread_over_blocks(spark):
    text = " ".join(["word"] * 700)
    out = packing.pack(docs(spark, [(1, text)] * 300), block_windows=8).collect()
    blocks = {r.sequence_id >> 32 for r in out}
    assert len(blocks) > 3 and sum(r.length for r in out) == 300 * out[0].doc_tokens
