import io
import zipfile

from pyspark.sql import functions as F

from foliant.sources import files, markup


def test_markdown(spark):
    text = "---\ntitle: \"My Book\"\n---\n# One #\nfirst line\nsecond line\n\nTitle\n=====\n- a\n- b\n```py\nx = 1\n\n# no heading\n```\n| a | b |\n|---|---|\n***\nlast"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r.kind, r.level, r.text) for r in markup.markdown_blocks(docs).where("doc_id = 1").orderBy("pos").collect()]
    assert got[-8:] == [("text", 0, "first line\nsecond line"), ("heading", 1, "Title"), ("item", 0, "• a"), ("item", 0, "• b"), ("code", 0, "```py\nx = 1\n\n# no heading\n```"), ("table", 0, "| a | b |\n|---|---|"), ("rule", 0, "* * *"), ("text", 0, "last")]
    assert ("heading", 1, "One") in got
    assert docs.where("doc_id = 1").select(markup.front_matter(F.col("text"), "title")).first()[0] == "My Book"
    assert docs.where("doc_id = 1").select(markup.front_matter(F.col("text"), "author")).first()[0] is None


def test_html(spark):
    page = "<body><nav><h3>Menu</h3></nav><h1>A Title</h1><p>A paragraph.<br>Two &amp; three</p><ul><li>x</li></ul><!-- c --><script>var a='</p>';</script></body>"
    rows = markup.html_blocks(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r.level, r.text) for r in rows] == [(1, "A Title"), (0, "A paragraph.\nTwo & three"), (0, "• x")]


def test_slugs(spark):
    df = spark.createDataFrame([(1, 0, "Same Title!"), (1, 1, "Same title"), (1, 2, "Other"), (2, 0, "same title")], "d long, pos long, t string")
    assert [r.slug for r in markup.slugs(df, "d", "pos", "t").orderBy("d", "pos").collect()] == ["same-title", "same-title-1", "other", "same-title"]


def test_usfm(spark):
    text = "\\id GEN\n\\h Genesis\n\\c 1\n\\p\n\\v 1 In the \\nd beginning\\nd*\\f + \\ft note\\f*\nof it.\n\\v 2 And \\v 3 then\n\\c 2\n\\v 1 New"
    rows = markup.usfm_verses(spark.createDataFrame([("GEN", text)], "book string, text string")).orderBy("chapter", "verse").collect()
    assert [(r.chapter, r.verse, r.text) for r in rows] == [(1, 1, "In the beginning of it."), (1, 2, "And"), (1, 3, "then"), (2, 1, "New")]


def test_decoding(spark):
    data = ["é\r\nb".encode(), "﻿é".encode(), "é中".encode("utf-16"), b"\xfe\xff" + "é".encode("utf-16-be"), "序章".encode("gb18030"), b"", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i long, b binary")
    assert [r.text for r in markup.with_text(df, "b").orderBy("i").collect()] == ["é\nb", "é", "é中", "é", "序章", "", None]


def test_book_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title,Author,My Rating,Date Read,ISBN13,Other\n"A, quoted ""title""",Me,4,2020/03/01,978-0-14-143951-8,x\nB,,0,bad,,"two\nlines"\n', encoding="utf-8")
    rows = files.read_books(spark, str(tmp_path)).orderBy("title").collect()
    assert [(r.title, r.author, r.stars, str(r.read_at), r.isbn, r.Other) for r in rows] == [('A, quoted "title"', "Me", 4, "2020-03-01", "9780141439518", "x"), ("B", "", None, "None", None, "two\nlines")]


def test_notes_and_listing(spark):
    good = '{"format":"notes","books":[{"title":"T","author":"A","notes":[{"quote":"q","note":null,"chapter":"1"},{"quote":"r","note":"n","chapter":null}]},{"title":" ","notes":[{"quote":"z"}]}]}'
    df = spark.createDataFrame([(good,), ("{broken",), (None,)], "text string")
    assert sorted((r.title, r.quote) for r in files.read_notes(df).collect()) == [("T", "q"), ("T", "r")]
    xml = "<L><Contents><Key>a/b</Key><LastModified>2024</LastModified><Size>12</Size></Contents><Contents><Key>c</Key><Size>3</Size></Contents></L>"
    assert [tuple(r) for r in files.listing(spark.createDataFrame([(xml,)], "xml string")).collect()] == [("a/b", 12, "2024"), ("c", 3, "")]


def test_office_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "One & two\n\nthree <x>")], "i long, text string")
    data = df.select(files.docx_bytes("text")).first()[0]
    (tmp_path / "a.docx").write_bytes(data)
    (tmp_path / "b.docx").write_bytes(b"no zip")
    assert [(r.pos, r.text) for r in files.read_docx(spark, f"{tmp_path}/*.docx").where("error IS NULL").orderBy("pos").collect()] == [(0, "One & two"), (1, "three <x>")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="x"><manifest><item id="b" href="2.xhtml"/><item id="a" href="1.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("o/1.xhtml", "<body><h2>First</h2></body>")
        z.writestr("o/2.xhtml", "<body><p>Then</p></body>")
    (tmp_path / "c.epub").write_bytes(out.getvalue())
    pages = files.read_epub(spark, f"{tmp_path}/*.epub").withColumnRenamed("pos", "page")
    assert [(r.level, r.text) for r in markup.html_blocks(pages, "page").orderBy("page", "pos").collect()] == [(2, "First"), (0, "Then")]


def test_bundle(spark, tmp_path):
    tables = {"a": spark.range(3), "b": spark.createDataFrame([("x", 1.5)], "s string, d double")}
    files.write_bundle(tables, str(tmp_path))
    back = files.read_bundle(spark, str(tmp_path))
    assert set(back) == {"a", "b"} and back["a"].count() == 3 and back["b"].first().d == 1.5


def test_docx_styles(spark, tmp_path):
    """Headings by a style's name, its outline level, the style it is based on, and a paragraph's own outline level."""
    w = f'xmlns:w="{files.W_NS[1:-1]}"'
    style = lambda i, inner: f'<w:style w:styleId="{i}">{inner}</w:style>'
    styles = style("1", '<w:name w:val="标题 1"/>') + style("Sub", '<w:basedOn w:val="Base"/>') + style("Base", '<w:pPr><w:outlineLvl w:val="2"/></w:pPr>')
    styles += style("Deep", '<w:pPr><w:outlineLvl w:val="8"/></w:pPr>') + style("A", '<w:basedOn w:val="B"/>') + style("B", '<w:basedOn w:val="A"/>') + style("Head", '<w:name w:val="heading 4"/>')
    line = lambda s, t, more="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/>{more}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    names = ["1", "Sub", "Base", "Deep", "A", "Head", "Heading2", "Title", "gone"]
    body = "".join(line(n, n) for n in names) + line("Deep", "own", '<w:outlineLvl w:val="0"/>')
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")
        z.writestr("docProps/core.xml", '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> T </dc:title><dc:creator>Me</dc:creator></c>')
    got = {r.text: r.level for r in files.read_docx(spark, str(tmp_path)).collect()}
    assert got == {"1": 1, "Sub": 3, "Base": 3, "Deep": 0, "A": 0, "Head": 4, "Heading2": 2, "Title": 1, "gone": 0, "own": 1}
    assert [tuple(r)[1:] for r in files.read_docx_origin(spark, str(tmp_path)).collect()] == [(0, "T", "Me", None, None)]


def test_headers(spark):
    assert [files.column_for(x) for x in ("Book_Title", "ＩＳＢＮ１３", " My  Rating ", "读完日期", "Other")] == ["title", "isbn13", "stars", "read_at", "Other"]


def test_cards(spark):
    plain = 'some,other,"My, Book",side one,"back ""q"""\n# no card\n\nt1; t2,#a|#b,,f2,b2\n,,,,no front'
    named = "Question\tAnswer\tDeck\nq1\ta1\td1 | d2\nq2\ta2"
    old = "\ufefftopic,book,front,back\nx,y,z"
    df = spark.createDataFrame([("a", plain), ("b", named), ("c", old), ("d", ""), ("e", None)], "path string, text string")
    got = {(r.path, r.front): (r.topics, r.tags, r.book, r.back) for r in files.read_cards(df).collect()}
    assert got == {
        ("a", "side one"): (["some"], ["other"], "My, Book", 'back "q"'), ("a", "f2"): (["t1", "t2"], ["a", "b"], "", "b2"),
        ("b", "q1"): (["d1", "d2"], [], "", "a1"), ("b", "q2"): ([], [], "", "a2"), ("c", "z"): (["x"], [], "y", ""),
    }


def test_cards_over_lines(spark):
    text = 'x,y,"a ""book"",\nin two lines",5" disk,"first\n# no comment\n\nlast"\n#c\nx,y,z,"q""",a\nx,y,z,open,"never closed\nq2'
    tabbed = 'front\tback\n"a\tb\nc"\td\n'
    df = spark.createDataFrame([(1, text), (2, tabbed)], "path long, text string")
    got = [(r.path, r.book, r.front, r.back) for r in files.read_cards(df).orderBy("path", "pos").collect()]
    assert got[:2] == [(1, 'a "book",\nin two lines', '5" disk', "first\n# no comment\n\nlast"), (1, "z", 'q"', "a")]
    assert got[-1] == (2, "", "a\tb\nc", "d") and ("open" in {g[2] for g in got})


def test_typed_books(spark):
    text = "Dune: Messiah\nby: Frank Herbert\nISBN: 123\nisbn: 456\n\nName: Emma\nwriter: Jane\nPersuasion\n\nauthor: nobody\n\nauthor: First\ntitle: Then"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    got = [(r.n, r.title, r.author, r.isbn) for r in files.read_typed_books(df).orderBy("n").collect()]
    assert got == [(1, "Dune: Messiah", "Frank Herbert", "123"), (2, "Emma", "Jane", None), (3, "Persuasion", None, None), (4, "Then", "First", None)]
    assert spark.range(1).select(markup.lossy_utf8(F.lit(b"a\xffb"))).first()[0] == "a\ufffdb"


def test_epub_round_trip(spark, tmp_path):
    schema = "title string, author string, language string, chapters array<struct<title: string, text: string>>"
    df = spark.createDataFrame([("A & B", "Me", "en", [("One", "first <line>\nsecond"), (None, "no title")])], schema)
    data = df.select(files.epub_bytes("title", "author", "language", "chapters")).first()[0]
    (tmp_path / "a.epub").write_bytes(data)
    (tmp_path / "b.epub").write_bytes(b"no zip")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and "book/nav.xhtml" in z.namelist()
    pages = files.read_epub(spark, str(tmp_path)).withColumn("page_id", F.col("pos"))
    got = [(r.page_id, r.level, r.text) for r in markup.html_blocks(pages).orderBy("page_id", "pos").collect()]
    assert got == [(0, 1, "One"), (0, 0, "first <line>"), (0, 0, "second"), (1, 0, "no title")]
    assert [tuple(r)[1:] for r in files.read_epub_origin(spark, str(tmp_path)).where("error IS NULL").collect()] == [(0, "A & B", "Me", "en", None)]
    bad = files.read_epub(spark, str(tmp_path)).where("error IS NOT NULL").collect()
    assert [(r.path.rpartition("/")[2], r.pos, r.html) for r in bad] == [("b.epub", None, None)] and "BadZipFile" in bad[0].error
    (tmp_path / "c.docx").write_bytes(data[: len(data) // 2])
    assert [r.text for r in files.read_docx(spark, f"{tmp_path}/c.docx").where("error LIKE 'BadZipFile%'").collect()] == [None]


def test_inline_markdown(spark):
    text = "**Bold** and _so_ on: [the *words*](http://x.org/a_b 'T'), ![pic](p.png) `*code* <b>` $a_1*b_2$ <https://y.org> <i>tag</i><!-- gone --> snake_case 2 \\* 3 ~~old~~"
    df = spark.createDataFrame([(text,), ("",), (None,), ("a * b * c",)], "t string")
    rows = df.select(markup.inline_plain(F.col("t")).alias("p"), markup.inline_links(F.col("t")).alias("l")).collect()
    assert rows[0].p == "Bold and so on: the words, pic `*code* <b>` $a_1*b_2$ https://y.org tag snake_case 2 * 3 old"
    assert [tuple(x) for x in rows[0].l] == [("the *words*", "http://x.org/a_b"), ("https://y.org", "https://y.org")]
    assert [r.p for r in rows[1:]] == ["", None, "a * b * c"] and rows[1].l == []


def test_cards_of_many_lines(spark):
    text = "\n".join(f't{i},"#a",b,front {i},"back ""{i}"""' for i in range(5000))
    got = files.read_cards(spark.createDataFrame([("a", text), ("b", "question,answer\n" + "q,a\n" * 3)], "path string, text string")).groupBy("path").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max("back").alias("back")).collect()
    assert {tuple(r) for r in got} == {("a", 5000, 0, 4999, 'back "999"'), ("b", 3, 0, 2, "a")}
