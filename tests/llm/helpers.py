"""Small tables with nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", size long, _cell long, _d string, _s string, _t string, keep_id long, copy int, vector string, score string, taken long, _id string, _mark double, _pick string, row string, doc string, cut long"
WORDS = "the of and ka mo réu üb thing sol, Via. nor den LE ß".split()


def docs(spark, rows, extra=False):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s1", None if r[1] is None else len(r[1])) for r in rows]
    if extra:
        full = [(*r, 7, 7, "x", "y", "z", 1, 2, "v", "s", 777, "i", 0.5, "p", "r", "d", 9) for r in full]
    return spark.createDataFrame(full, EXTRA if extra else DOCS)


def extras(rows):
    """The extra columns' values, once each, of Rows."""
    return {tuple(r)[5:] for r in rows}


def odd_rows(seed=1, n=60):
    """Awkward rows: nulls, empties, repeats, ties in ids, one very long text."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    rows = [(i, text(rng.randrange(1, 80)), rng.choice(["a", "b", "é", None])) for i in range(n)]
    rows += [(n + i, rows[i % 7][1].upper() if i % 2 else rows[i % 7][1], "hot") for i in range(n // 2)]
    return rows + [(1000, None, None), (1001, "", "a"), (1002, " \n\t ", "b"), (1003, text(30_000), "b"), (None, "no id here", "b"), (1004, "same id", "a"), (1004, "same id", "a"), (1004, "same id, other text", "a")]
