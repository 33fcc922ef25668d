"""Edits of chapters against edits made one by one on a list."""

import random

from foliant.operators import structure


def joined(rows, at, into):
    """One break taken away from a list of (start, end, title)."""
    if len(rows) < 2:
        return rows
    if into == "above" and at > 0 or at == len(rows) - 1:
        (a, _, title), (_, b, _) = rows[at - 1], rows[at]
        return [*rows[: at - 1], (a, b, title), *rows[at + 1 :]]
    (a, _, _), (_, b, title) = rows[at], rows[at + 1]
    return [*rows[:at], (a, b, title), *rows[at + 2 :]]


def test_single_edits(spark):
    cases = [(n, at, action) for n in (1, 2, 3, 5) for at in range(n) for action in ("above", "below", "rename")]
    chapters = spark.createDataFrame([(i, k, 10 * k, 10 * k + 10, f"c{k}", False) for i, (n, _, _) in enumerate(cases) for k in range(n)], "doc_id long, idx long, start long, end long, title string, by_hand boolean")
    edits = spark.createDataFrame([(i, at, action, "  new ") for i, (_, at, action) in enumerate(cases)] + [(0, 99, "above", None)], "doc_id long, idx long, action string, title string")
    got = {}
    for r in structure.with_edits(chapters, edits).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.title))
        assert r.idx == len(got[r.doc_id]) - 1
    for i, (n, at, action) in enumerate(cases):
        rows = [(10 * k, 10 * k + 10, f"c{k}") for k in range(n)]
        want = joined(rows, at, action) if action != "rename" else [(a, b, "new" if k == at else t) for k, (a, b, t) in enumerate(rows)]
        assert got[i] == want, (n, at, action)


def test_many_edits_keep_the_text_whole(spark):
    pick = random.Random(6)
    chapters = spark.createDataFrame([(i, k, 10 * k, 10 * k + 10, f"c{k}", False) for i in range(40) for k in range(8)], "doc_id long, idx long, start long, end long, title string, by_hand boolean")
    edits = spark.createDataFrame([(i, k, pick.choice(["above", "below"]), None) for i in range(40) for k in pick.sample(range(8), pick.randrange(9))], "doc_id long, idx long, action string, title string")
    ends, titles = {}, {}
    for r in structure.with_edits(chapters, edits).orderBy("doc_id", "idx").collect():
        assert r.start == ends.get(r.doc_id, 0)
        ends[r.doc_id] = r.end
        titles.setdefault(r.doc_id, set()).add(r.title)
    gone = {(r.doc_id, r.idx) for r in edits.collect()}
    assert set(ends.values()) == {80}
    assert all(titles[i] >= {f"c{k}" for k in range(8) if (i, k) not in gone and ((i, k - 1) not in gone and (i, k + 1) not in gone)} for i in range(40))


def test_moves(spark):
    chapters = spark.createDataFrame([(i, k, 10 * k) for i in range(4) for k in range(5)], "doc_id long, idx long, start long")
    moves = spark.createDataFrame([(0, 1, 1), (1, 0, -1), (1, 4, 1), (2, 1, 1), (2, 2, 1), (2, 3, 1), (2, 2, -1), (3, 4, -1), (3, 3, 1)], "doc_id long, idx long, by int")
    got = {}
    for r in structure.with_moves(chapters, moves).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append(r.start // 10)
    assert got == {0: [0, 2, 1, 3, 4], 1: [0, 1, 2, 3, 4], 2: [0, 2, 1, 4, 3], 3: [0, 1, 2, 4, 3]}
