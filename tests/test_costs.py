"""What steps cost by their plans: how often texts are read, cut and moved."""

import random
import re

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import resolve, spans, versions
from foliant.plans import forms
from foliant.sources import markup


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def made(spark):
    docs = spark.createDataFrame([(1, "One. Two.\nThree.")], "doc_id long, text string")
    chapters = spark.createDataFrame([(1, 0, 0)], "doc_id long, idx long, start long")
    slots = spark.createDataFrame([(1, 0, 0, "Two. One.", "t")], "doc_id long, pos long, idx long, text string, title string")
    return spark.createDataFrame(versions.rewritten(docs, chapters, slots).collect(), versions.rewritten(docs, chapters, slots).schema)


def test_units_are_moved_by_one_join(spark):
    """only the lengths are joined, once; segments and words are met by sorting."""
    units = spark.createDataFrame([(1, 0, "fr", 0, 4, "One.", False)], "doc_id long, unit long, target string, start long, end long, source string, stale boolean")
    df = versions.moved_units(units, made(spark))
    assert len(re.findall(r"\bJoin ", plan(df))) == 1
    assert [(r.start, r.end, r.stale) for r in df.collect()] == [(5, 9, False)]


def test_offsets_are_led_by_sorting(spark):
    """a point is not filed under buckets, nor joined with its segment; the lengths' join is the only one."""
    points = spark.createDataFrame([(1, a) for a in (0, 4, 5, 9, 12)] + [(2, 3), (1, None)], "doc_id long, at long")
    segs = spark.createDataFrame([(1, 0, 5, 0, 5, True), (1, 5, 5, 7, 7, False), (1, 5, 9, 7, 9, False)], "doc_id long, os long, oe long, ns long, ne long, linear boolean")
    lengths = spark.createDataFrame([(1, 10, 20)], "doc_id long, old_len long, new_len long")
    df = spans.remapped(points, segs, lengths)
    assert len(re.findall(r"\bJoin ", plan(df))) == 1
    assert sorted((r.at, r.new_at) for r in df.where("at IS NOT NULL").collect()) == [(0, 0), (4, 4), (5, 7), (9, 20), (12, 22)]


def test_tokens_are_cut_once(spark):
    """the pairs of a text come from one pass over it."""
    df = spark.createDataFrame([(1, "a b, a b c"), (2, "一二 x"), (3, " lone "), (4, "..."), (5, None)], "id long, text string")
    out = df.select("id", resolve.shingles(F.col("text")).alias("s"))
    assert plan(out).count("regexp_extract_all") == 1
    assert [r.s for r in out.orderBy("id").collect()] == [["a b", "b a", "b c"], ["一 二", "二 x"], ["lone"], [], None]


def test_sentences_as_with_shielded_stops(spark):
    """abbreviations are looked for from stops on, by one pass, and cut the same as by shielding them first."""
    pick = random.Random(5)
    texts = ["".join(pick.choice(["Mr", "mrs", "e.g", "I.e", "st", "best", "é", "Dr", ".", ".", "!", "?", " ", "\n", "\xa0", ")", '"', "a", "\x02"]) for _ in range(pick.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    shield = F.regexp_replace("text", rf"(?i){X.BOUND}({'|'.join(X.ABBREVIATIONS)})\.(?={X.WS}|\z)", "$1\x02")
    cut = F.regexp_replace(shield, rf"([.!?][\"'”’)\]]*)(?={X.WS}|\z)", "$1\x01")
    rows = df.select(F.split(F.translate(cut, "\x02", "."), "\x01").alias("want"), X.sentence_pieces(F.col("text")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert plan(df.select(X.sentence_pieces(F.col("text")).alias("p"))).count("regexp_replace") == 1


def test_near_documents_cut_texts_once(spark):
    """what is joined are hashes in a table; no text is cut again, and what only one set has is not moved."""
    for query in (forms.l05_near_documents, forms.l05_near_classes):
        assert "lower(text" not in plan(query(spark, "/root/testdata/sf0.001"))
    pick = random.Random(9)
    rows = []
    for _ in range(40):
        base = [f"w{pick.randrange(50)}" for _ in range(pick.randrange(1, 30))]
        rows += [sorted({w for w in base if pick.random() > 0.08} | ({f"own{len(rows)}"} if pick.random() < 0.3 else set())) for _ in range(4)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "doc_id long, s array<string>")
    sets = {}
    for i, s in enumerate(rows):
        if s:
            sets.setdefault(frozenset(s), i)
    want = sorted((i, j) for s, i in sets.items() for t, j in sets.items() if i < j and len(s & t) >= 0.8 * len(s | t) - 1e-12)
    assert want and sorted((r.a, r.b) for r in resolve.near_sets(df).collect()) == want


def test_equal_authors_are_compared_once(spark):
    """names meet by themselves, and their copies only as pairs that are found."""
    left = spark.createDataFrame([(1, i, name) for i, name in enumerate(["No 12"] * 30 + [None, "No 777"])], "n long, l long, a string")
    right = spark.createDataFrame([(1, i, name) for i, name in enumerate(["no, 2"] * 20 + ["no, 7"])], "n long, r long, b string")
    df = resolve.author_pairs(left, right, "n")
    assert df.count() == 30 * 20 + 21 + 1
    tables = [t for t in df._jdf.queryExecution().analyzed().collectLeaves().mkString("\n").split("\n") if "Relation" in t]
    assert tables and all("__" in t for t in tables)


def test_spans_are_cut_in_their_rows(spark):
    """spans meet marks by one join, and no table of cuts is made, sorted and joined again."""
    pick = random.Random(3)
    spans_, marks = [], []
    for d in range(6):
        ends = sorted(pick.sample(range(6000), 9))
        spans_ += [(d, i, a, b) for i, (a, b) in enumerate(zip(ends, ends[1:]))] + [(d, 90, 50, 50)]
        marks += [(d, i, a, a + pick.choice([0, 1, 40, 40, 3000])) for i, a in enumerate(pick.choices(range(6000), k=15 * (d > 0)))]
    s = spark.createDataFrame(spans_, "doc_id long, span_id long, start long, end long")
    m = spark.createDataFrame(marks, "doc_id long, mark_id long, m_start long, m_end long")
    df = spans.pieces(s, m)
    assert len(re.findall(r"\bJoin ", plan(df))) == 1 and "Window" not in plan(df)
    want = []
    for d, i, a, b in spans_:
        own = [(e - c, k, c, e) for x, k, c, e in marks if x == d and e > a and c < b]
        cuts = sorted({a, b} | {max(a, c) for _, _, c, _ in own} | {min(b, e) for *_, e in own})
        want += [(d, i, x, y, min(((n, k) for n, k, c, e in own if c <= x < e), default=(0, None))[1]) for x, y in zip(cuts, cuts[1:])]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_verses_are_cut_in_their_rows(spark):
    """a text is not made lines that are sorted and grouped again; verses given twice are still one."""
    pick = random.Random(11)
    tokens = ["\\c 1", "\\c 2", "\\c", "\\v 1 ", "\\v 2a x", "\\v 1\n", "\\v 0 ", "\\v 300 ", "\\p", "\\q1 ", "\\nd ", "\\nd*", "a", "B c", " ", "\t", "\r", "\n", "\n", "\n", "é\xa0"]
    texts = ["".join(pick.choice(tokens) for _ in range(pick.randrange(60))) for _ in range(300)]
    want = []
    for i, t in enumerate(texts):
        verses, c, v = {}, None, None
        for line in re.sub(r"\\v[ \t\n\r]", "\n\\\\v ", t).split("\n"):
            a, b = (re.match(rf"[ \t\r]*\\{m}[ \t\r]+([0-9]+)", line) for m in "cv")
            c, v = (int(a[1]), 0) if a else (c, int(b[1]) if b else v)
            line = re.sub(r"[ \t\n\r]+", " ", re.sub(r"\\[a-z]+[0-9]*\*?[ \t\r]?", "", re.sub(r"\A[ \t\r]*\\v[ \t\r]+[0-9]+[^ \t\r]*[ \t\r]*", "", line))).strip(" ")
            if c is not None and v:
                verses.setdefault((c, v), []).append(line)
        want += [(i, *k, " ".join(filter(None, x)).strip(" ")) for k, x in verses.items()]
    df = markup.usfm_verses(spark.createDataFrame(list(enumerate(texts)), "book long, text string"))
    assert not re.search(r"Window|Aggregate|Join ", plan(df))
    assert len(want) > 200 and sorted(map(tuple, df.collect())) == sorted(want)


def test_equal_titles_have_their_keys_made_once(spark, monkeypatch):
    """a title, author and edition that many books bear are one row where keys are made, and missing ones are equal, too."""
    tables, written = {}, resolve.graph.written
    monkeypatch.setattr(resolve.graph, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    rows = [(i, t, a) for i, (t, a) in enumerate([("Dune", "F. Herbert"), ("DUNE", None), ("Ｄｕｎｅ", "F. Herbert"), (None, None), ("", "X")] * 8)]
    df = spark.createDataFrame(rows, "id long, title string, author string").withColumn("edition", F.lit(None).cast("string"))
    pairs = {tuple(r) for r in resolve.like_pairs(df).collect()}
    assert tables["title-keys"].count() == 5
    assert {(0, i, "same") for i in range(2, 40, 5)} | {(0, i, "same") for i in range(5, 40, 5)} | {(1, i, "same") for i in range(6, 40, 5)} <= pairs
    assert {i for a, b, _ in pairs for i in (a, b)} == {i for i in range(40) if i % 5 < 3}
