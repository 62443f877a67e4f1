import random

import pytest

from lodestone.llm import licenses

from .helpers import docs, odd_rows


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rows(seed=1):
    rng = random.Random(seed)
    filler = lambda k: " ".join(rng.choice(["ka", "lo", "mi", "tér", "un"]) for _ in range(k))
    out, names = [], list(licenses.TEMPLATES)
    for i in range(150):
        name = rng.choice(names)
        words = licenses.TEMPLATES[name].split()
        if len(words) > 20:
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(3, len(words) - 3)
                words[k : k + rng.randrange(2)] = [] if rng.random() < 0.5 else ["extra"]
        text = " ".join(words) if rng.random() < 0.5 else "\n# ".join(words)
        out.append((i, f"{filler(rng.randrange(60))} é {text} {filler(rng.randrange(60))}" if i % 3 else filler(50), name if i % 3 else None))
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_matches_are_found_with_their_spans(spark, extra):
    cases = rows()
    table = docs(spark, [(i, t) for i, t, _ in cases] + [(r[0] and r[0] + 9000, r[1]) for r in odd_rows()], extra)
    texts = {i: t for i, t, _ in cases}
    found = {}
    for r in licenses.scan(table).collect():
        assert texts[r.doc_id][r.start : r.end] == r.licensed_text
        assert 0.8 <= r.coverage <= 1 and r.matched_words <= r.template_words
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {i for i, _, name in cases if name}
    for i, text, name in cases:
        if name:
            best = max(found[i], key=lambda r: r.matched_words)
            words = [licenses.plain_words(x).tolist() for x in (licenses.TEMPLATES[best.license], text)]
            assert best.matched_words == lcs(*words)
            assert best.license.split(" ")[0] == name.split(" ")[0] or name.startswith("CC-BY")


def found_in(spark, texts):
    out = [[] for _ in texts]
    for r in licenses.scan(docs(spark, list(enumerate(texts)))).collect():
        assert texts[r.doc_id][r.start : r.end] == r.licensed_text
        out[r.doc_id].append((r.license, r.coverage, r.licensed_text))
    return [sorted(x, key=lambda r: texts[i].index(r[2])) for i, x in enumerate(out)]


def test_each_license_by_its_own_name(spark):
    names = ["BSD-2-Clause", "BSD-3-Clause", "GPL-2.0 (header)", "LGPL-2.1 (header)", "LGPL-3.0 (header)", "AGPL-3.0 (header)", "GPL-3.0 (header)", "CC-BY-4.0 (notice)", "CC-BY-NC-4.0 (notice)"]
    texts = [f"Copyright 2020 Some One. {licenses.TEMPLATES[n]} Then code." for n in names]
    found = found_in(spark, ["lo mi (c) One. All rights reserved. ka", *texts])
    assert [x[:2] for x in found[0]] == [("All rights reserved (notice)", 1.0)]
    assert [[x[:2] for x in f] for f in found[1:]] == [[(n, 1.0)] for n in names]


@pytest.mark.parametrize("long", [31, 200, 6000])
def test_insertions_of_any_length(spark, long):
    words = licenses.TEMPLATES["MIT"].split()
    filler = " ".join(["ka", "lo", "mi"][k % 3] for k in range(long))
    cut = " ".join(words[:60]) + f" {filler} {licenses.TEMPLATES['MPL-2.0 (header)']} {filler} " + " ".join(words[60:])
    once, twice = found_in(spark, [f"{filler} {cut} {filler}", f"{cut} {filler} {cut}"])
    assert [x[:2] for x in once] == [("MIT", 1.0), ("MPL-2.0 (header)", 1.0)] and once[0][2] == cut.rstrip(".")
    assert sorted(x[:2] for x in twice) == [("MIT", 1.0)] * 2 + [("MPL-2.0 (header)", 1.0)] * 2


NAMED = {
    "Released under the BSD License.": ["BSD (notice)"],
    "Released under the Apache License.": [],
    "Licensed under CC BY-NC-ND 4.0.": ["CC-BY-NC-ND-4.0 (notice)"],
    "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0 (notice)"],
    "Licensed under CC BY 3.0.": ["CC-BY-3.0 (notice)"],
    "Licensed under CC BY 2.5.": [],
    "Licensed under CC BY-ND 3.0.": [],
    "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0 (notice)"],
    "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0 (notice)"],
    "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0 (notice)"],
    "This work is licensed under the GNU General Public License, version 3.0 or later.": ["GPL-3.0 (notice)"],
    "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0 (notice)"],
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": ["LGPL-2.1 (notice)"],
    "This work is licensed under the GNU Lesser General Public License, version 2.": [],
    "Licensed under the Apache License, Version 1.1.": [],
    "Licensed under the Apache License, Version 2.0.": ["Apache-2.0 (notice)"],
    "Released, in 2020, under the MIT License.": ["MIT (notice)"],
    "The rights of all readers are reserved by the press.": [],
}


@pytest.mark.parametrize("around", ["", "ka lo mi "])
def test_names_of_like_licenses(spark, around):
    texts = [around + t + " " + around for t in NAMED]
    got = [[x[0] for x in f] for f in found_in(spark, texts)]
    assert dict(zip(NAMED, got)) == NAMED
    gpl = licenses.TEMPLATES["GPL-3.0 (header)"]
    headers = [gpl.replace("version 3", "version 7"), gpl.replace("GNU General", "GNU Lesser General"), licenses.TEMPLATES["Apache-2.0 (header)"].replace("Version 2.0", "Version 3.0")]
    assert [[x[0] for x in f] for f in found_in(spark, headers)] == [[], ["LGPL-3.0 (header)"], []]


def runs(words, n):
    return {tuple(words[k : k + n].tolist()) for k in range(len(words) - n + 1)}


def test_equals_brute_force_alignment(spark):
    """What is reported, and what isn't, against the alignment of every template at every word of every text."""
    rng = random.Random(3)
    words = "released licensed under the mit apache bsd license version 2 3 4 0 cc by nc sa all rights reserved this work is gnu general public lesser ka lo".split()
    texts = list(NAMED) + [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(20)]
    for text in list(licenses.TEMPLATES.values())[::2]:
        parts = text.split()
        for k in range(0, len(parts), 7):
            parts[k] = rng.choice([parts[k], parts[k], "other"])
        texts.append("ka lo " + " ".join(parts) + " mi")
    index = licenses.Index(licenses.TEMPLATES)
    got = found_in(spark, texts)
    for text, found in zip(texts, got):
        document = licenses.plain_words(text)
        accepted = {}
        for number, title in enumerate(index.titles):
            template = index.words[number]
            size = licenses.GRAM if index.notices[number] else licenses.GRAM + licenses.WINNOW - 1
            run = runs(template, size)  # only matches with an undisturbed run are sure to be found
            for start in range(-len(template) // 5, len(document), licenses.BAND // 2):
                matched, first, last = licenses.aligned(template, document, start)
                if run & runs(document, size) and matched >= 0.8 * len(template) and index.names(number, document, [(first, last)]):
                    accepted[title] = max(accepted.get(title, -1000), 2 * matched - len(template))
        assert {x[0] for x in found} <= set(accepted), text
        assert bool(found) == bool(accepted), (text, accepted)
        if accepted:
            assert max(accepted.values()) == max(accepted[x[0]] for x in found), (text, accepted, found)


def test_empty(spark):
    assert licenses.scan(docs(spark, [])).count() == 0
