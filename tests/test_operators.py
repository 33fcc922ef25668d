import random

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import align, cast, resolve, spans, structure


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(expr(*(F.col(f"v{i}") for i in range(len(values))))).first()[0]


def test_sentences(spark):
    text = "Mr. Smith came (etc.) here. \"Yes!\" he said… No?  \n e.g. this. End"
    rows = spans.sentences(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("start").collect()
    assert [r.text for r in rows] == ["Mr. Smith came (etc.)", "here.", '"Yes!"', "he said… No?", "e.g. this.", "End"]
    assert all(text[r.start : r.end] == r.text for r in rows)


def test_languages_and_keys(spark):
    assert one(spark, X.detect_language, "这是一个句子 with words") == "zh-Hans"
    assert one(spark, X.detect_language, "plain") == "en"
    assert one(spark, X.title_key, "《三体》") == one(spark, X.title_key, "三体")
    assert one(spark, X.main_title_key, "Dune: a novel") == "dune" and one(spark, X.main_title_key, "Dune: part 2") == "dunepart2"
    assert one(spark, X.card_key, "The  Cats") == "cat"
    assert one(spark, X.is_isbn, "0-306-40615-2") and one(spark, X.is_isbn, "978-0-306-40615-7") and not one(spark, X.is_isbn, "978-0-306-40615-8") and not one(spark, X.is_isbn, "")
    assert one(spark, X.same_author, "Liu, Cixin", "cixin liu") and not one(spark, X.same_author, "A B", "C D") and one(spark, X.same_author, "A", " ")


def test_duplicates(spark):
    titles = [(1, "《三体》", None), (2, "三体", None), (3, "Pride and Prejudise", "J Austen"), (4, "Pride and Prejudice", "Austen, J"), (5, "Dune II", None), (6, "Dune I", None), (7, "Emma", None), (8, "Gemma", None), (9, "Emma", "X"), (10, "emma!", "X")]
    books = spark.createDataFrame([(i, t, a, None, i, i % 2 == 0) for i, t, a in titles], "id long, title string, author string, edition string, created long, has_text boolean")
    pairs = resolve.like_pairs(books)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2, "same"), (3, 4, "near"), (7, 9, "same"), (9, 10, "same")]
    groups = {r.id: (r.group, r.near, r.keeper) for r in resolve.duplicate_groups(books, pairs).collect()}
    assert groups == {1: (1, False, False), 2: (1, False, True), 3: (3, True, False), 4: (3, True, True), 7: (7, False, False), 9: (7, False, False), 10: (7, False, True)}
    gone = spark.createDataFrame([(1, 2)], "a long, b long")
    assert resolve.like_pairs(books, gone).count() == 3


def test_pieces(spark):
    own = spark.createDataFrame([(1, 1, 0, 40), (1, 2, 30, 60)], "doc_id long, span_id long, start long, end long")
    marks = spark.createDataFrame([(1, 7, 0, 40), (1, 8, 10, 20), (1, 9, 30, 45)], "doc_id long, mark_id long, m_start long, m_end long")
    got = sorted((r.span_id, r.start, r.end, r.mark_id) for r in spans.pieces(own, marks).collect())
    assert got == [(1, 0, 10, 7), (1, 10, 20, 8), (1, 20, 30, 7), (1, 30, 40, 9), (2, 30, 40, 9), (2, 40, 45, 9), (2, 45, 60, None)]


def test_remap(spark):
    segs = spark.createDataFrame([(1, 0, 100, 0, 100, True), (1, 100, 250, 100, 230, False), (1, 250, 400, 230, 380, True), (1, 400, 500, 380, 480, True)], "doc_id long, os long, oe long, ns long, ne long, linear boolean")
    merged = spans.merged_segments(segs)
    assert merged.count() == 3
    at = [0, 1, 99, 100, 101, 177, 249, 250, 399, 400, 499, 500, 512]
    points, lengths = spark.createDataFrame([(1, a) for a in at], "doc_id long, at long"), spark.createDataFrame([(1, 500, 480)], "doc_id long, old_len long, new_len long")
    want = [a if a < 100 else 100 + (a - 100) * 130 // 150 if a < 250 else a - 20 if a < 500 else 480 + a - 500 for a in at]
    for s in (segs, merged):
        assert [r.new_at for r in spans.remapped(points, s, lengths).orderBy("at").collect()] == want


def test_wide_spans_join_once(spark):
    rng = random.Random(5)
    a = [(1, i, s, s + rng.randrange(1, 9000)) for i in range(40) for s in [rng.randrange(20000)]]
    b = [(1, i, s, s + rng.randrange(1, 9000)) for i in range(40) for s in [rng.randrange(20000)]]
    left, right = spark.createDataFrame(a, "doc_id long, i long, s long, e long"), spark.createDataFrame(b, "doc_id long, j long, t long, f long")
    got = sorted((r.i, r.j) for r in spans.overlapping(left, right, "s", "e", "t", "f").collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[3] > y[2] and x[2] < y[3])


def test_chapters(spark):
    lines = ["序章", "a b", "第一章 起点", "c", "第二章", "d", "第三章", "e"]
    docs = spark.createDataFrame([(1, "\n".join(lines), "zh")], "doc_id long, text string, lang string")
    got = structure.chapters_from_patterns(spans.paragraphs(docs), docs).orderBy("start").collect()
    assert [r.title for r in got] == ["序章", "第一章 起点", "第二章", "第三章"] and got[-1].end == len("\n".join(lines))
    assert one(spark, structure.without_caption, "The end.” Chapter IV") == "Chapter IV"
    assert [one(spark, structure.is_separator, x) for x in ("* * *", "※", "--", "---", "a", "", "*" * 25)] == [True, True, False, True, False, False, False]


def test_headings(spark):
    df = spark.createDataFrame([(1, x) for x in [1, 2, 2, 2, 2, 3]] + [(2, x) for x in [1, 1, 2]] + [(3, 2)], "doc_id long, level int")
    assert {r.doc_id: r.level for r in structure.heading_level(df).collect()} == {1: 2, 2: 1, 3: 2}


def test_glossary(spark):
    text = "Mira crossed the ford. Mira waited. Mira never spoke of Ashfall again. Ashfall burned. Ashfall was gone."
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    assert [(r.source, r.total) for r in cast.candidates(docs, "lang").collect()] == [("Ashfall", 3)]


def test_schedule(spark):
    def end(answers):
        df = spark.createDataFrame([(1, i, i, a) for i, a in enumerate(answers)], "u long, at long, seq long, ok boolean")
        return cast.schedules(df, ["u"]).first()

    assert [end([True] * n).interval_days for n in (1, 2, 3)] == [1, 6, 16]
    assert end([False] * 20).ease == 1.3 and end([True] * 20).ease == 2.8 and end([True, True, False]).reps == 0


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def test_alignment(spark):
    old = [(1, i, f"Chapter {i}", f"Chapter {i}\n{words(i, 60)}") for i in range(5)]
    new = [(1, 0, "Chapter 0", old[0][3]), (1, 1, "Chapter 1", "Chapter 1\n" + words(77, 60))]
    new += [(1, i + 1, f"Chapter {i + 1}", f"Chapter {i + 1}\n{words(i, 60)}" + (" one more" if i == 3 else "")) for i in range(1, 4)]
    schema = "doc_id long, idx long, title string, text string"
    got = align.chapters(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).orderBy("step").collect()
    assert [(r.kind, r.base, r.incoming) for r in got] == [("same", 0, 0), ("added", None, 1), ("same", 1, 2), ("same", 2, 3), ("changed", 3, 4), ("kept", 4, None)]


def test_diffs(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), (None, "n"), ("s", "s")], "o string, n string")
    got = [[(p.change, p.text) for p in r[0]] for r in df.select(align.word_diff("o", "n")).collect()]
    assert got == [[("same", "a "), ("removed", "b"), ("added", "x"), ("same", " c"), ("added", " d")], [("added", "n")], [("same", "s")]]
    lines = df.limit(1).select(align.paragraph_diff(F.lit("x\ny"), F.lit("x\nz"))).first()[0]
    assert [(p.change, p.text) for p in lines] == [("same", "x\n"), ("removed", "y\n"), ("added", "z\n")]


def test_reanchoring(spark):
    text = "one two three two four two"
    rows = [(text, 4, "two", "one ", " three"), ("x " + text, 4, "two", "one ", " three"), (text, 20, "two", "?", "?"), (text, 3, "gone", "", ""), (None, 1, "a", None, None), (text, 9, "two", None, None)]
    df = spark.createDataFrame(rows, "t string, s long, q string, p string, x string")
    got = [r[0] and (r[0].start, r[0].end) for r in df.select(align.reanchored("t", "s", "q", "p", "x")).collect()]
    assert got == [(4, 7), (6, 9), (23, 26), (None, None), (None, None), (4, 7)] or got[5] in ((4, 7), (14, 17))


def test_ties_pins_links(spark):
    tie = lambda x: one(spark, X.tie, x)
    assert [tie(x) for x in ("Parent", "his elder brother", "丈夫", "old friend", "xkingx", "")] == ["parent", "sibling", "spouse", None, None, None]
    assert one(spark, lambda c: X.opposite_tie(X.tie(c)), "teacher") == "student" and one(spark, lambda c: X.tie_group(X.tie(c)), "queen") == "power"
    pin = lambda a, b: one(spark, X.pin, a, b)
    assert tuple(pin(" Rome ", "CERTAIN")) == ("Rome", "certain") and tuple(pin("Ur", None)) == ("Ur", "probable") and pin("n/a", "certain") is None and pin("one two three four five six seven", "") is None
    wiki = lambda x: one(spark, X.wiki_link, x)
    assert wiki("https://en.wikipedia.org/wiki/Ur") == "https://en.wikipedia.org/wiki/Ur" and wiki("http://x.org") is None and wiki("Ashfall  keep") == "https://en.wikipedia.org/wiki/Ashfall_keep" and wiki("None") is None
    assert one(spark, X.is_link, " https://a.b/c ") and not one(spark, X.is_link, "a b")
    assert tuple(one(spark, X.title_and_series, "Dune (Dune Chronicles #1)")) == ("Dune (Dune Chronicles #1)".split(" (")[0], "Dune Chronicles #1")
    df = spark.createDataFrame([(["blue hair, tall", "hair", None, "long blue hair."],), ([None],)], "v array<string>")
    assert [r[0] for r in df.select(X.merged_clauses(F.col("v"))).collect()] == ["tall · long blue hair", None]
    assert one(spark, X.safe_file_name, ' a/b: "c" ') == 'a-b- -c-' and one(spark, X.safe_file_name, " ") == "book"


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_equal_pairs(monkeypatch):
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(14))] for _ in range(2))
        got = align.equal_pairs(a, b)
        assert len(got) == brute_lcs(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:]))
    a = [f"w{i}" for i in range(300)]
    b = [x for i, x in enumerate(a) if i % 7] + a[:5]
    monkeypatch.setattr(align, "MAX_CELLS", 2000)  # long lists are cut by items that occur once
    got = align.equal_pairs(a, b)
    assert len(got) == brute_lcs(a, b) and align.equal_pairs(["x"] * 100, ["y"] * 100) == []


def test_alignment_titles_empty_texts_and_size(spark):
    schema = "doc_id long, idx long, title string, text string"
    steps = lambda a, b: [(r.kind, r.base, r.incoming) for r in align.chapters(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).orderBy("step").collect()]
    body = words(1, 60)
    assert steps([(1, 0, "Chapter One.", body)], [(1, 0, "Chapter One", body + " " + words(2, 70))]) == [("changed", 0, 0)]  # alike by half only with the title
    assert steps([(1, 0, "", body)], [(1, 0, "", body + " " + words(2, 70))]) == [("kept", 0, None), ("added", None, 0)]
    assert steps([(1, 0, "a", "")], [(1, 0, "b", " ")]) == [("same", 0, 0)]
    many = [(1, i, f"Chapter {i}", f"Chapter {i}\nw{i}x1 w{i}x2 w{i}x3") for i in range(2500)]
    new = [(1, i + (i >= 1200), t, x) for _, i, t, x in many] + [(1, 1200, "New", "a new one")]
    got = align.chapters(spark.createDataFrame(many, schema), spark.createDataFrame(new, schema))
    assert [(r.kind, r.incoming) for r in got.where("kind <> 'same'").collect()] == [("added", 1200)] and tuple(align.tally(got).first()) == (1, 2500, 0, 1, 0)


def test_sentences_in_cjk_script(spark):
    text = "他说：“你好。”她笑了！真的？！没有……好"
    docs = spark.createDataFrame([(1, text, "zh-Hans"), (2, "One. Two? 三。", "en")], "doc_id long, text string, lang string")
    got = spans.sentences(docs, lang_col="lang").orderBy("doc_id", "start").collect()
    assert [r.text for r in got if r.doc_id == 1] == ["他说：“你好。”", "她笑了！", "真的？！", "没有……", "好"]
    assert [r.text for r in got if r.doc_id == 2] == ["One.", "Two?", "三。"] and all(text[r.start : r.end] == r.text for r in got if r.doc_id == 1)


def test_offsets_of_many_lines(spark):
    lines = ["x" * (i * 7 % 11) for i in range(2000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None), (4, "one")], "doc_id long, text string")
    got = spans.paragraphs(docs)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString() and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.pos, r.start, r.end) for r in got.where("doc_id = 1").collect())
    at, want = 0, []
    for i, x in enumerate(lines):
        want.append((i, at, at + len(x)))
        at += len(x) + 1
    assert rows == want and sorted((r.doc_id, r.text) for r in got.where("doc_id > 1").collect()) == [(2, ""), (4, "one")]


def blocks_of(spark, docs):
    """docs: (id, lang, [(text, heading, boundary)]); blocks are joined by an empty line."""
    rows, heads = [], []
    for d, lang, parts in docs:
        at = 0
        for text, heading, boundary in parts:
            rows.append((d, at, at + len(text), text, heading, boundary))
            at += len(text) + 2
        heads.append((d, lang, max(0, at - 2)))
    return spark.createDataFrame(rows, "doc_id long, start long, end long, text string, heading int, boundary boolean"), spark.createDataFrame(heads, "doc_id long, lang string, length long")


def test_detection_cascade(spark):
    p = lambda text: (text, None, False)
    acts = [("Act One", 1, False), ("Scene 1", 2, False), p("body"), ("Scene 2", 2, False), p("more"), ("Act Two", 1, False), ("Scene 3", 2, False), p("last")]
    docs = [
        (1, "en", acts),
        (2, "en", [p("Chapter 1"), p("a"), p("Chapter 2"), p("b"), p("Chapter 3"), p("c")]),
        (3, "en", [("One", None, True), p("a"), ("Two", None, True), p("b")]),
        (4, "en", [p("only text")]),
        (5, "zh-Hant", [p("第一節 起"), p("a"), p("第二節"), p("b"), p("第三節"), p("c")]),
        (6, "en", [p("x" * 300), ("Late", 1, False), p("a"), ("Later. CHAPTER III", 1, False), p("b")]),
        (7, "en", []),
    ]
    got = structure.detected_chapters(*blocks_of(spark, docs)).orderBy("doc_id", "start").collect()
    by = {d: [(r.method, r.title, r.start) for r in got if r.doc_id == d] for d in range(1, 8)}
    assert [x[:2] for x in by[1]] == [("headings", "Scene 1"), ("headings", "Scene 2"), ("headings", "Scene 3")]
    assert by[1][0][2] == 0 and by[1][2][2] == len("Act One\n\nScene 1\n\nbody\n\nScene 2\n\nmore\n\n")  # acts are labels of what is under them
    assert [x[:2] for x in by[2]] == [("patterns", f"Chapter {i}") for i in (1, 2, 3)]
    assert [x[:2] for x in by[3]] == [("spine", "One"), ("spine", "Two")] and by[4] == [("none", "", 0)] and by[7] == []
    assert [x[1] for x in by[5]] == ["第一節 起", "第二節", "第三節"]
    assert [x[1] for x in by[6]] == ["", "Late", "CHAPTER III"] and not [r for r in got if r.doc_id == 6][0].confident


def test_keys_in_normal_form(spark):
    df = spark.createDataFrame([(1, "Ｄｕｎｅ １"), (2, "Dune 1"), (3, None)], "i long, t string")
    assert [r.t for r in X.with_composed(df, "t").orderBy("i").collect()] == ["Dune 1", "Dune 1", None]
    assert one(spark, X.tie, "一个弟子") == "child" and one(spark, X.tie, "his father and 父亲") == "parent"


def test_near_titles_are_all_met(spark):
    """Titles a few edits apart with the same beginning or end: all pairs that comparing each with each finds."""
    rng = random.Random(12)
    titles = []
    for _ in range(60):
        t = "".join(rng.choice("abcde") for _ in range(rng.randrange(3, 18)))
        titles.append(t)
        for _ in range(3):
            u = list(t)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(u) + 1)
                u[at : at + rng.randrange(2)] = rng.choice([[], ["x"], ["y"]])
            titles.append("".join(u))
    books = spark.createDataFrame([(i, t, "me", None) for i, t in enumerate(titles) if t], "id long, title string, author string, edition string")
    got = {(r.a, r.b) for r in resolve.like_pairs(books).where("likeness = 'near'").collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    heads = {}
    for i, t in enumerate(titles):
        heads.setdefault(t, i)
    want = set()
    for a, i in heads.items():
        for b, j in heads.items():
            short = min(len(a), len(b))
            if i < j and a and b and (a[:3] == b[:3] or a[-3:] == b[-3:]) and edits(a, b) <= (0 if short < 5 else 1 if short < 14 else 2):
                want.add((i, j))
    assert len(want) > 40 and {p for p in got if titles[p[0]] != titles[p[1]]} == want


def test_references(spark):
    books = spark.createDataFrame([("Genesis", "GEN", [], 50), ("John", "JHN", [], 21), ("1 Samuel", "1SA", ["first samuel"], 31), ("Philippians", "PHP", [], 4), ("Philemon", "PHM", [], 1)], "book string, code string, aliases array<string>, chapters int")
    said = ["Gen 3", "  john   4 ", "Phil 1", "1Sam 31", "John 3:16", "jhn 22", "First  Samuel 2", "php 4", "Genesis", "Genesis 0", "", None]
    got = {r.id: (r.book, r.chapter) for r in resolve.references(spark.createDataFrame(list(enumerate(said)), "id long, said string"), books).collect()}
    assert got == {0: ("Genesis", 3), 1: ("John", 4), 3: ("1 Samuel", 31), 6: ("1 Samuel", 2), 7: ("Philippians", 4)}


def test_links_and_places(spark):
    links = spark.createDataFrame([(1, 0, 1, "#Top"), (1, 2, 3, "#top%20two"), (1, 4, 5, "#none"), (1, 6, 7, "mailto:a@b.c"), (1, 8, 9, "x.html")], "doc_id long, start long, end long, href string")
    anchors = spark.createDataFrame([(1, "top", 9), (1, "top", 3), (1, "TOP", 1), (1, "Top Two", 5), (2, "none", 0)], "doc_id long, anchor string, at long")
    got = {r.start: (r.href, r.at) for r in structure.resolved_links(links, anchors).collect()}
    assert got == {0: ("#TOP", 1), 2: ("#Top Two", 5), 6: ("mailto:a@b.c", None)}
    text = "".join(chr(97 + i * 7 % 26) for i in range(300))
    df = spark.createDataFrame([(text, 100, "new " * 20 + text), (text, 100, "gone"), ("", 0, ""), ("ab", 1, "abab")], "t string, at int, n string")
    assert [r[0] for r in df.select(structure.placed_again(F.col("t"), F.col("at"), F.col("n"))).collect()][1:] == [1, 0, 2]


def test_places_in_long_texts(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(300)) + "x" * 120000
    df = spark.createDataFrame([(text, 40000, "new " + text[41:])], "t string, at int, n string")
    assert df.select(structure.placed_again(F.col("t"), F.col("at"), F.col("n"))).first()[0] >= 0


def test_clauses_hold_whole_words(spark):
    df = spark.createDataFrame([(["cold gear", "old gear", "gear", "红色大衣", "大衣"],)], "v array<string>")
    assert df.select(X.merged_clauses(F.col("v"))).first()[0] == "cold gear · old gear · 红色大衣"


def test_reanchoring_in_repeats(spark):
    text = "Begin. " + "The " * 15 + "end of all that was said."
    df = spark.createDataFrame([("new new " + text, 27, text[27:67], text[7:27], text[67:87])], "t string, s long, q string, p string, x string")
    assert tuple(df.select(align.reanchored("t", "s", "q", "p", "x").alias("x")).first().x) == (35, 75)


def test_counts_round_as_printf(spark):
    n = [*range(10000, 400000, 500), 22499, 22501, 10**9 + 2500, 10**9 + 7500]
    got = spark.createDataFrame([(x,) for x in n], "n long").select("n", X.format_count(F.col("n"), F.lit("zh"))).collect()
    assert {r[0]: r[1] for r in got} == {x: f"{x / 10000:.1f}万字" for x in n}


def test_shelf_of_copies(spark):
    copies = spark.range(20000)
    inc = copies.select(F.col("id").alias("rid"), F.when(F.col("id") == 3, 7).cast("long").alias("library_id"), F.lit("Dune").alias("title"), F.when(F.col("id") % 2 == 0, "Herbert").alias("author"))
    shelf = copies.select((F.col("id") + 5).alias("id"), F.lit("DUNE").alias("title"), F.when(F.col("id") > 0, "Frank Herbert").otherwise("Someone").alias("author"))
    got = resolve.shelf_match(inc, shelf).groupBy("id", "how").agg(F.count("*").alias("n"), F.max(F.col("rid") % 2).alias("odd")).collect()
    assert {tuple(r) for r in got} == {(5, 2, 9999, 1), (6, 2, 10000, 0), (7, 1, 1, 1)}
