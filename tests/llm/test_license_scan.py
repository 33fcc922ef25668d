"""License scans against brute force over all places of all notices, edited copies, odd rows and hot texts."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import license_scan, queries
from foliant.llm.license_scan import K, NOTICES, PHRASES, edits, nearest, verified, words_of

SF = "/root/testdata/sf0.001"
ALL = [(label, base, words_of(text)) for base, given_ in ((True, PHRASES), (False, NOTICES)) for label, text in given_]
GPL3 = next(t for label, t in NOTICES if label == "gpl-3" and t.startswith("This"))
MIT = NOTICES[0][1]


def plain_spans(text):
    """Every place of every notice, with no votes."""
    words = words_of(text or "")
    return verified(words, [(i, 0, max(len(words) - 1, 0)) for i in range(len(ALL))], ALL)


def edited(text, n, seed):
    """The text after n edits of single words."""
    pick, words = random.Random(seed), text.split()
    for _ in range(n):
        at = pick.randrange(len(words))
        kind = pick.randrange(3)
        words[at : at + (kind != 1)] = [] if kind == 0 else [f"w{pick.randrange(99)}"]
    return " ".join(words)


def plain_nearest(a, b):
    """Fewest edits over all runs of b, by whole tables."""
    best = len(a)
    for start in range(len(b) + 1):
        row = list(range(len(a) + 1))
        best = min(best, row[-1])
        for w in b[start:]:
            new = [row[0] + 1]
            for i, x in enumerate(a):
                new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), max_size=14))
def test_nearest_run(a, b):
    d, start, end = nearest(np.array(a), np.array(b, np.int64))
    assert d == plain_nearest(a, b) and 0 <= start <= end <= len(b)
    assert plain_nearest(a, b[start:end]) == d


def corpus():
    noise = "the software is a work of the people and the license of the terms under the sun "
    rows = [noise * 3, "", None, "MIT", "Released under the MIT License. Under the MIT\nlicense", "cc by nc cc-by-nc 4.0", "İunder the mit license", "under the mit licenseé"]
    rows += ["Apache License, Version 2.0 " * 3, "apache license version 2under", "GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2."]
    for n in range(0, 10):
        rows += [noise + edited(GPL3, n, n) + noise, edited(MIT, 2 * n, n) + " tail"]
    rows += [f"{GPL3} x {edited(GPL3, 3, 7)} {MIT}", " ".join([edited(GPL3, 2, i) for i in range(40)])]
    return rows


def test_like_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(corpus())]
    rows += [(None, "under the mit license"), (None, None), (7, "again cc by nc"), (7, "again cc by nc")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_words int, key string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2]))
    got = sorted(((r.doc_id, r.n_words, [s.asDict() for s in r.spans]) for r in license_scan.scan(docs).collect()), key=key)
    want = sorted(((d, len(words_of(t or "")), plain_spans(t)) for d, t in rows), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want):
        assert [s for s in g[2] if s["score"] == 1] == [s for s in w[2] if s["score"] == 1]
        assert {s["label"] for s in g[2]} == {s["label"] for s in w[2]}
        assert max([s["score"] for s in g[2]], default=0) == max([s["score"] for s in w[2]], default=0)
    assert {s["label"] for s in dict((r[0], r[2]) for r in got)[12 + 2 * 4]} == {"gpl-3"}


@pytest.mark.parametrize("n", [0, 1, 3, 5, 7])
def test_edits_within_the_bound_are_found(n):
    words = words_of("before that " + edited(GPL3, n, n + 50) + " and after")
    assert n <= edits(len(words_of(GPL3)))
    assert "gpl-3" in {s["label"] for s in plain_spans(" ".join(words))}


def test_phrases_by_plain_search(spark):
    """The query's base columns over the whole table, by comparing words at every place."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc, text in docs:
        words = words_of(text or "")
        hits = [(p, label) for label, phrase in PHRASES for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in hits]
        want[doc] = (len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))
    got = {r.doc_id: r for r in queries.op11_license_scan(spark, SF).collect()}
    assert {d: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for d, r in got.items()} == want
    for doc, text in docs:
        spans = plain_spans(text)
        assert got[doc].labels == ",".join(sorted({s["label"] for s in spans}))
        assert got[doc].score == max([s["score"] for s in spans], default=0.0)


def test_short_and_too_many_notices(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    with pytest.raises(ValueError):
        license_scan.scan(docs, notices=[("x", "a b")])
    found = license_scan.scan(docs, phrases=[], notices=[("x", "b c d")]).first().spans
    assert [(s.label, s.base, s.start, s.end, s.score) for s in found] == [("x", False, 1, 4, 1.0)]
    assert license_scan.scan(docs.limit(0)).collect() == [] and license_scan.scan(docs, [], []).first().spans == []
    monkeypatch.setattr(license_scan, "MAX_GRAMS", 1)
    with pytest.raises(ValueError):
        license_scan.scan(docs)


def test_a_very_long_and_a_hot_text(spark):
    long = ("word " * 50_000) + "under the mit license " * 5_000
    rows = [(0, long)] + [(i, "x under the mit license") for i in range(1, 300)] + [(9, "x under the mit license")] * 300
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 600
    first = next(r for r in got if r.doc_id == 0)
    assert first.n_words == 70_000 and [s.start for s in first.spans] == list(range(50_000, 70_000, 4))
    assert all([(s.start, s.label) for s in r.spans] == [(1, "mit")] for r in got if r.doc_id)
    assert K == 3
