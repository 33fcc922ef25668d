"""Rewrites against plain string building: places, segments, units that are found, lost and in each other's way, notes, undo."""

import random

from foliant.operators import versions


def plain(text, starts, slots):
    """(new text, [(old start, old end, new start, new end, linear)]) by appending."""
    ends = dict(zip(starts, [*starts[1:], len(text)]))
    out = text[: starts[0]] if starts else ""
    placed = []
    for idx, wording in slots:
        if out and not out.endswith("\n\n"):
            out += "\n" if out.endswith("\n") else "\n\n"
        at = out
        os = None if idx is None else starts[idx]
        body = wording if wording is not None else text[os : ends[os]]
        out += body.rstrip(" \n\t")
        placed.append((os, None if os is None else ends[os], len(at), len(out), wording is None))
    return out, placed


def made_of(spark, cases):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    chapters = spark.createDataFrame([(i, k, s) for i, (_, starts, _) in enumerate(cases) for k, s in enumerate(starts)], "doc_id long, idx long, start long")
    slots = spark.createDataFrame([(i, p, k, w, f"t{p}") for i, (_, _, slots) in enumerate(cases) for p, (k, w) in enumerate(slots)], "doc_id long, pos long, idx long, text string, title string")
    return docs, versions.rewritten(docs, chapters, slots)


def drawn(seed):
    pick = random.Random(seed)
    cases = []
    for _ in range(25):
        text = "".join(pick.choice(["a", "é", "b ", "\n", "\n\n", "word "]) for _ in range(pick.randrange(1, 60)))
        starts = sorted(pick.sample(range(len(text)), min(len(text), pick.randrange(1, 5))))
        slots = [(k, pick.choice([None, None, "new words \n", ""])) for k in range(len(starts))]
        for _ in range(pick.randrange(3)):
            slots.insert(pick.randrange(len(slots) + 1), (None, pick.choice(["added\n", "more  "])))
        cases.append((text, starts, slots))
    return cases


def test_texts_and_places(spark):
    cases = drawn(4)
    _, made = made_of(spark, cases)
    got = {r.doc_id: r for r in made.collect()}
    for i, (text, starts, slots) in enumerate(cases):
        want, placed = plain(text, starts, slots)
        assert (got[i].text, got[i].old_len, got[i].new_len) == (want, len(text), len(want))
        assert [(s.os, s.oe, s.ns, s.ne, s.linear) for s in got[i].slots[1:]] == placed
    tiles = {}
    for r in versions.new_chapters(made).orderBy("doc_id", "idx").collect():
        assert tiles.get(r.doc_id, r.start) == r.start and r.end >= r.start
        tiles[r.doc_id] = r.end
    assert tiles == {i: len(plain(*c)[0]) for i, c in enumerate(cases)}


def test_moved_and_undone(spark):
    cases = drawn(8)
    docs, made = made_of(spark, cases)
    rows = spark.createDataFrame([(i, a, a + 3, "x") for i, (t, _, _) in enumerate(cases) for a in range(0, len(t) + 2)] + [(999, 4, 5, "other"), (0, None, 2, "null")], "doc_id long, start long, end long, name string")
    moved = versions.moved(rows, ["start", "end"], versions.segments(made), made.select("doc_id", "old_len", "new_len"))
    assert sorted(map(str, versions.undone(moved).collect())) == sorted(map(str, rows.collect()))
    got = {(r.doc_id, r.was.start): r.start for r in moved.collect()}
    for i, (text, starts, slots) in enumerate(cases):
        new, placed = plain(text, starts, slots)
        for os, oe, ns, ne, linear in placed:
            if os is not None and linear:
                for at in range(os, oe):
                    assert got[i, at] == min(ns + at - os, ne)
                    assert got[i, at] == ne or new[got[i, at]] == text[at]
        assert got[i, len(text) + 1] == len(new) + 1
    assert got[999, 4] == 4 and got[0, None] is None


def test_units_and_notes(spark):
    text = "Intro. One stays. Two goes. Same. Same. Tail."
    new = "Here is Same. And One stays. Same."
    _, made = made_of(spark, [(text, [0, 7, 40], [(0, None), (1, new), (None, "Extra."), (2, None)])])
    spots = [(0, 6, "Intro."), (7, 17, "One stays."), (18, 27, "Two goes."), (28, 33, "Same."), (34, 39, "Same."), (40, 45, "Tail.")]
    units = spark.createDataFrame([(0, n, t, a, b, s, False) for t in ("fr", "de") for n, (a, b, s) in enumerate(spots)], "doc_id long, unit long, target string, start long, end long, source string, stale boolean")
    out = made.first().text
    moved = versions.moved_units(units, made)
    rows = moved.collect()
    assert len(rows) == len(units.collect()) and len({(r.target, r.start, r.end) for r in rows}) == len(rows)
    for r in rows:
        if r.unit in (0, 1, 5):
            assert out[r.start : r.end] == r.source and not r.stale
        if r.unit == 2:
            assert r.stale and r.end - r.start == 9
    same = sorted(r.start for r in rows if r.target == "fr" and r.unit in (3, 4))
    assert out[same[0] : same[0] + 5] == "Same." and same[0] != same[1]
    assert sorted(map(str, versions.undone(moved).select(*units.columns).collect())) == sorted(map(str, units.collect()))
    notes = spark.createDataFrame([(0, 1, 11, 16, "stays", "One ", "."), (0, 2, 18, 21, "Two", "", " goes"), (0, 3, 40, 44, "Tail", "", ".")], "doc_id long, note long, start long, end long, quote string, prefix string, suffix string")
    got = {r.note: (out[r.start : r.end], r.was.start) for r in versions.moved_notes(notes, made).collect()}
    assert got[1] == ("stays", 11) and got[3] == ("Tail", 40) and got[2][1] == 18


def test_wordings_and_homes(spark):
    docs = spark.createDataFrame([(1, "one\n\ntwo\n\n")], "doc_id long, text string")
    chapters = spark.createDataFrame([(1, 0, 0, "A"), (1, 1, 5, "B")], "doc_id long, idx long, start long, title string")
    slots = spark.createDataFrame([(1, 0, 0, "  one ", "A2"), (1, 1, 1, "zwei", "B2"), (1, 2, None, "drei", "C")], "doc_id long, pos long, idx long, text string, title string")
    kept = versions.kept_wordings(docs, chapters, slots).collect()
    assert sorted((r.idx, r.title, r.text) for r in kept) == [(0, "A", "one"), (1, "B", "two"), (1, "B2", "zwei")]
    rows = spark.createDataFrame([(1, 0, "h"), (1, 1, "h"), (1, 1, "k"), (1, 7, "h")], "doc_id long, idx long, hash string")
    before = spark.createDataFrame([(1, 0, 0), (1, 1, 5)], "doc_id long, idx long, start long")
    after = spark.createDataFrame([(1, 3, 0, 10)], "doc_id long, idx long, start long, end long")
    got = sorted((r.was.idx, r.hash, r.idx) for r in versions.rehomed(rows, before, after).collect())
    assert got == [(0, "h", 3), (1, "h", 1), (1, "k", 3), (7, "h", 7)]
