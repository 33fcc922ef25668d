"""Readers and writers of files: delimited tables, notes, office documents, bundles. All go through Spark's own sources."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import csv_cell

#: Names that columns of book lists have, a column a line, its own name first.
COLUMN_NAMES = {
    "title": ("title", "book title", "book", "name", "书名", "書名", "标题", "標題", "名称", "书籍名称"),
    "book_id": ("book id", "bookid", "id", "编号", "豆瓣id"),
    "author": ("author", "authors", "author name", "writer", "作者", "著者", "作者名"),
    "status": ("exclusive shelf", "shelf", "status", "read status", "状态", "狀態", "书架", "阅读状态"),
    "stars": ("my rating", "rating", "stars", "score", "评分", "評分", "我的评分", "星级", "星級"),
    "review": ("my review", "review", "comment", "comments", "评论", "評論", "短评", "书评", "我的评论"),
    "read_at": ("date read", "read date", "read at", "finished", "读完日期", "阅读日期", "读过日期", "日期"),
    "added_at": ("date added", "added", "added at", "添加日期", "加入日期"),
    "isbn13": ("isbn13", "isbn-13", "isbn 13"),
    "isbn": ("isbn", "isbn10", "isbn-10"),
    "notes": ("private notes", "notes", "note", "笔记", "筆記", "备注", "備註"),
    "shelves": ("bookshelves", "tags", "labels", "标签", "標籤"),
    "year": ("original publication year", "year", "published", "出版年", "出版年份"),
}


def plain_header(header: str) -> str:
    return re.sub(r"[\s_]+", " ", unicodedata.normalize("NFKC", header).strip().lower())


def column_for(header: str, names: dict[str, tuple[str, ...]] = COLUMN_NAMES) -> str:
    """The column that a header names, or the header itself; names has the names of each column."""
    plain = plain_header(header)
    return next((column for column, known in names.items() if plain in map(plain_header, known)), header)


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table with a header: quoted cells may hold line ends and doubled quotes; missing cells are empty."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return df.na.fill("")


def read_books(spark: SparkSession, path: str, names: dict[str, tuple[str, ...]] = COLUMN_NAMES) -> DataFrame:
    """A list of books from another tool, its columns under canonical names, stars 1 to 5 or null, dates parsed."""
    df = read_csv(spark, path)
    df = df.toDF(*[column_for(c, names) for c in df.columns])
    if "stars" in df.columns:
        n = F.try_to_number(F.trim("stars"), F.lit("9")).cast("int")
        df = df.withColumn("stars", F.when(n.between(1, 5), n))
    for c in ("read_at", "added_at"):
        if c in df.columns:
            parsed = [F.try_to_timestamp(F.trim(F.col(c)), F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy")]
            df = df.withColumn(c, F.coalesce(*parsed).cast("date"))
    for c in {"isbn", "isbn13"} & set(df.columns):
        bare = F.regexp_replace(c, "[^0-9Xx]", "")
        df = df.withColumn(c, F.when(F.length(bare) >= 10, bare))
    if "isbn13" in df.columns:
        df = df.withColumn("isbn", F.coalesce("isbn13", "isbn") if "isbn" in df.columns else F.col("isbn13")).drop("isbn13")
    return df


#: Names that columns of card files have; without such a header the order is that of the lines, without tags
#: where no row has five cells.
CARD_COLUMNS = {
    "topics": ("topics", "topic", "deck"),
    "tags": ("tags", "tag"),
    "book": ("book", "book title", "source"),
    "front": ("front", "question", "term", "word", "q"),
    "back": ("back", "answer", "definition", "meaning", "a"),
}


#: A line that may go on within the quotes of a cell, and a cell behind its comma.
RECORD = r'''(?:[^"\n]++|(?<![^,\t\n])"(?:[^"]++|"")*+"|")*+\n'''
CELL = r'''(?s),(?:"((?:[^"]|"")*)"|([^,]*))'''


def read_cards(files: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, pos, topics, tags, book, front, back) of card files, a text a row: comma- or tab-separated, with a header or not.

    Blank lines, lines that start with # and rows without a front are left out; topics and tags are parted by ; or |. A
    quoted cell may hold line ends, separators and doubled quotes.
    """
    whole = F.concat(F.regexp_replace(F.regexp_replace(text_col, "^\ufeff", ""), "\r\n?", "\n"), F.lit("\n"))
    line = F.transform(F.regexp_extract_all(whole, F.lit(RECORD), 0), lambda x: F.left(x, F.length(x) - 1))
    line = F.filter(line, lambda x: (F.trim(F.replace(x, F.lit("\n"), F.lit(" "))) != "") & ~F.startswith(x, F.lit("#")))
    tabbed = F.coalesce(F.contains(F.get("lines", F.lit(0)), F.lit("\t")), F.lit(False))
    rows = files.select(id_col, line.alias("lines")).where(F.size("lines") > 0).withColumn("tabbed", tabbed)
    matches = lambda x: F.when(F.col("tabbed"), F.regexp_extract_all(F.concat(F.lit("\t"), x), F.lit(CELL.replace(",", "\t")), 0)).otherwise(F.regexp_extract_all(F.concat(F.lit(","), x), F.lit(CELL), 0))
    cells = lambda x: F.transform(matches(x), lambda c: F.trim(_cell(c)))
    fields = list(CARD_COLUMNS.items())
    rows = rows.withColumns({"head": F.transform(cells(F.get("lines", F.lit(0))), F.lower), "wide": F.exists("lines", lambda x: F.size(matches(x)) >= len(fields))})
    rows = rows.withColumn("named", F.arrays_overlap("head", F.array(*map(F.lit, CARD_COLUMNS["front"]))))
    # a line is a row from here on, which has what holds for its file but no other line
    rows = rows.select(id_col, "tabbed", "head", "wide", "named", F.posexplode("lines").alias("at", "line")).where("at > 0 OR NOT named")
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, id_col, "at")
    place = lambda names: F.array_max(F.transform(F.array(*map(F.lit, names)), lambda n: F.array_position(F.col("head"), n).cast("int"))) - 1
    untagged = [x[0] for x in fields if x[0] != "tags"]
    for k, (field, names) in enumerate(fields):
        narrow = F.lit(untagged.index(field) if field in untagged else -1)
        rows = rows.withColumn(f"at_{field}", F.when(F.col("named"), place(names)).when(F.col("wide"), F.lit(k)).otherwise(narrow))
    out = rows.withColumns({"pos": F.col("at") - F.col("named").cast("int"), "cells": cells(F.col("line"))})
    cell = lambda field: F.when(F.col(f"at_{field}") < 0, "").otherwise(F.coalesce(F.get("cells", F.col(f"at_{field}")), F.lit("")))
    listed = lambda c: F.filter(F.transform(F.split(c, "[;|]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    tags = F.filter(F.transform(listed(cell("tags")), lambda x: F.regexp_replace(x, "^#+", "")), lambda x: x != "")
    return out.select(id_col, "pos", listed(cell("topics")).alias("topics"), tags.alias("tags"), cell("book").alias("book"), cell("front").alias("front"), cell("back").alias("back")).where("front <> ''")


def _cell(x):
    """A cell as it was matched, with the comma before it."""
    bare = F.substring(x, F.lit(2), F.length(x))
    quoted = F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"'))
    return F.when(F.startswith(bare, F.lit('"')), quoted).otherwise(bare)


#: Words before a colon that name a field of a typed list of books.
TYPED_FIELDS = {"name": "title", "title": "title", "book": "title", "author": "author", "by": "author", "writer": "author", "isbn": "isbn"}


def read_typed_books(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, n, title, author, isbn) of lists of books as people type them: a line a field, or only a title.

    A blank line, or a second title, begins the next book; of a field given twice the first counts; a book without a title
    is none.
    """
    rows = texts.select(id_col, F.posexplode(F.split(text_col, "\r?\n")).alias("pos", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")))
    word = F.lower(F.regexp_extract("line", r"^([A-Za-z]+)\s*:", 1))
    table = F.create_map(*(F.lit(x) for pair in TYPED_FIELDS.items() for x in pair))
    field = F.try_element_at(table, word)
    rows = rows.withColumn("field", field).withColumn("value", F.when(F.col("field").isNull(), F.col("line")).otherwise(F.trim(F.regexp_replace("line", r"^[A-Za-z]+\s*:\s*", ""))))
    rows = rows.where("line = '' OR value <> ''").withColumn("field", F.when(F.col("line") == "", None).otherwise(F.coalesce("field", F.lit("title"))))
    w = Window.partitionBy(id_col).orderBy("pos")
    rows = rows.withColumn("part", F.count_if(F.col("field").isNull()).over(w)).where("field IS NOT NULL")
    own = Window.partitionBy(id_col, "part").orderBy("pos")
    title = (F.col("field") == "title").cast("int")
    before = F.coalesce(F.sum(title).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("book", F.when(F.col("field") == "title", before).otherwise(F.greatest(before - 1, F.lit(0))))
    first = lambda f: F.min(F.when(F.col("field") == f, F.struct("pos", "value")))["value"].alias(f)
    books = rows.groupBy(id_col, "part", "book").agg(first("title"), first("author"), first("isbn"), F.min("pos").alias("pos")).where("title IS NOT NULL")
    n = F.row_number().over(Window.partitionBy(id_col).orderBy("pos")).cast("long")
    return books.select(id_col, n.alias("n"), "title", "author", "isbn")


def read_notes(texts: DataFrame, col: str = "text") -> DataFrame:
    """(title, author, quote, note, chapter) of notes files, a JSON text a row; broken ones have none."""
    schema = "format STRING, books ARRAY<STRUCT<title: STRING, author: STRING, notes: ARRAY<STRUCT<quote: STRING, note: STRING, chapter: STRING>>>>"
    rows = texts.select(F.explode(F.from_json(col, schema)["books"]).alias("b")).select("b.title", "b.author", F.explode("b.notes").alias("n"))
    return rows.where("trim(coalesce(title, '')) <> ''").select("title", "author", "n.quote", "n.note", "n.chapter")


def listing(xml: DataFrame, col: str = "xml") -> DataFrame:
    """(key, size, modified) of the entries of object-store listings."""
    entry = xml.select(F.explode(F.regexp_extract_all(col, F.lit(r"(?s)<Contents>(.*?)</Contents>"), 1)).alias("c"))
    field = lambda n: F.regexp_extract("c", rf"<{n}>([^<]*)</{n}>", 1)
    return entry.select(field("Key").alias("key"), field("Size").cast("long").alias("size"), field("LastModified").alias("modified"))


W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


#: A style, by its id or its name, that is a heading's; deeper outline levels than this are no heading.
HEADING_STYLE, DEEPEST = re.compile(r"(?i)(?:heading|标题|標題)\s*([1-6])"), 5


def _outline(e) -> int | None:
    """The heading level that the outline level of a style or paragraph gives it."""
    found = next(e.iter(f"{W_NS}outlineLvl"), None)
    said = found.get(f"{W_NS}val", "") if found is not None else ""
    return int(said) + 1 if said.isdecimal() and int(said) <= DEEPEST else None


def _style_levels(styles: bytes | None) -> dict[str, int]:
    """The heading level of each style that has one: by its name, by its own outline level, or by the style it is based on."""
    own, based = {}, {}
    for style in ElementTree.fromstring(styles).iter(f"{W_NS}style") if styles else ():
        name = style.get(f"{W_NS}styleId")
        if name:
            value = lambda tag: next((x.get(f"{W_NS}val", "") for x in style.iter(f"{W_NS}{tag}")), "")  # noqa: E731, B023
            named = HEADING_STYLE.fullmatch(value("name"))
            own[name], based[name] = int(named[1]) if named else _outline(style), value("basedOn")
    out = {}
    for name in own:
        seen, at = set(), name
        while at in own and own[at] is None and at not in seen:
            seen.add(at)
            at = based[at]
        if own.get(at):
            out[name] = own[at]
    return out


def _docx_blocks(content: bytes) -> list[tuple[int, str]]:
    """(heading level or 0, text) of the paragraphs of a word-processor file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        levels = _style_levels(z.read("word/styles.xml") if "word/styles.xml" in z.namelist() else None)
    out = []
    for p in root.iter(f"{W_NS}p"):
        style = next((s.get(f"{W_NS}val", "") for s in p.iter(f"{W_NS}pStyle")), "")
        named = HEADING_STYLE.fullmatch(style)
        level = _outline(p) or (int(named[1]) if named else levels.get(style)) or (1 if style.lower() == "title" else 0)
        text = "".join((e.text or "") if e.tag == f"{W_NS}t" else "\n" if e.tag == f"{W_NS}br" else "\t" if e.tag == f"{W_NS}tab" else "" for e in p.iter())
        if text.strip():
            out.append((level, text))
    return out


def _epub_pages(content: bytes) -> list[str]:
    """The pages of an e-book in the order of its spine."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        opf = re.search(r'full-path="([^"]+)"', z.read("META-INF/container.xml").decode())[1]
        package = ElementTree.fromstring(z.read(opf))
        base = opf.rpartition("/")[0]
        items = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
        spine = [items[e.get("idref")] for e in package.iter() if e.tag.endswith("}itemref") and e.get("idref") in items]
        return [z.read(f"{base}/{h}" if base else h).decode("utf-8", "replace") for h in spine]


def _per_file(function, names: list[str], kinds: list[pa.DataType]):
    def run(batches):
        for batch in batches:
            for path, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content"))):
                try:
                    rows = [(path, i, *(r if isinstance(r, tuple) else (r,)), None) for i, r in enumerate(function(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError, ValueError, EOFError, zlib.error) as e:
                    rows = [(path, None, *[None] * len(names), f"{type(e).__name__}: {e}")]
                cols = list(zip(*rows)) or [[]] * (3 + len(names))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), *kinds, pa.string()])], ["path", "pos", *names, "error"])

    return run


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, level, text, error) of the paragraphs of word-processor files; one that can't be read is a row with the error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_per_file(_docx_blocks, ["level", "text"], [pa.int64(), pa.string()]), "path string, pos long, level long, text string, error string")


def read_docx_origin(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, title, author, language, error) of word-processor files by their properties alone; null what they don't say."""

    def origin(content: bytes) -> list[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            held = "docProps/core.xml" in z.namelist()
            core = ElementTree.fromstring(z.read("docProps/core.xml")) if held else ElementTree.Element("none")
        first = lambda tag: next((e.text.strip() for e in core.iter() if e.tag.endswith("}" + tag) and (e.text or "").strip()), None)
        return [(first("title"), first("creator"), first("language"))]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_per_file(origin, ["title", "author", "language"], [pa.string()] * 3), "path string, pos long, title string, author string, language string, error string")


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, html, error) of the pages of e-books, for html_blocks; one that can't be read is a row with the error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_per_file(_epub_pages, ["html"], [pa.string()]), "path string, pos long, html string, error string")


@F.pandas_udf(T.BinaryType())
def docx_bytes(texts):
    """A word-processor file of each text, a paragraph for each line."""
    from xml.sax.saxutils import escape

    def one(text: str) -> bytes:
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            put = lambda name, data: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
            put("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
            put("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
            put("word/document.xml", f'<w:document xmlns:w="{W_NS[1:-1]}"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    return pd.Series([None if t is None else one(t) for t in texts], dtype=object)


def _epub(title: str, author: str, language: str, chapters: list) -> bytes:
    from xml.sax.saxutils import escape

    page = lambda head, body: f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(head)}</title></head><body>{body}</body></html>'
    names = [f"c{i}.xhtml" for i in range(1, len(chapters) + 1)]
    items = "".join(f'<item id="c{i}" href="{name}" media-type="application/xhtml+xml"/>' for i, name in enumerate(names, 1))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(1, len(names) + 1))
    meta = f"<dc:identifier id=\"id\">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>{escape(language)}</dc:language>"
    nav = "".join(f'<li><a href="{name}">{escape(c["title"] or name)}</a></li>' for name, c in zip(names, chapters))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, data, kind=zipfile.ZIP_DEFLATED: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, kind)
        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)  # first and as it is, as the format asks
        put("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        put("book/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>{items}</manifest><spine>{spine}</spine></package>')
        put("book/nav.xhtml", page(title, f'<nav epub:type="toc"><ol>{nav}</ol></nav>'))
        for name, c in zip(names, chapters):
            paragraphs = "".join(f"<p>{escape(x)}</p>" for x in (c["text"] or "").split("\n") if x.strip())
            put(f"book/{name}", page(c["title"] or "", (f"<h1>{escape(c['title'])}</h1>" if c["title"] else "") + paragraphs))
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def epub_bytes(title: pd.Series, author: pd.Series, language: pd.Series, chapters: pd.Series) -> pd.Series:
    """An e-book of each row, its chapters an array<struct<title, text>>, a paragraph for each line; null chapters give none."""
    rows = zip(title, author, language, chapters)
    return pd.Series([None if c is None else _epub(t or "", a or "", g or "", list(c)) for t, a, g, c in rows], dtype=object)


def read_epub_origin(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, title, author, language, error) of e-books by their package alone; their pages are not unpacked."""

    def origin(content: bytes) -> list[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            package = ElementTree.fromstring(z.read(re.search(r'full-path="([^"]+)"', z.read("META-INF/container.xml").decode())[1]))
        first = lambda tag: next((e.text for e in package.iter() if e.tag.endswith("}" + tag) and e.text), None)
        return [(first("title"), first("creator"), first("language"))]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_per_file(origin, ["title", "author", "language"], [pa.string()] * 3), "path string, pos long, title string, author string, language string, error string")


#: The columns of a library's list, and the columns of ours that fill them.
LIBRARY_COLUMNS = """
Title: title, Author: author, Book Id: source_hash, ISBN13: isbn, Year Published: year, Exclusive Shelf: status, My Rating: stars,
My Review: review, Date Read: rated_at, Date Added: created_at, Bookshelves: tags, Kind: kind, Language: language, Words: words,
Chapters: chapters, Notes: notes, Summary: summary, Came From: source_name
"""


def library_lines(books: DataFrame, key: str) -> DataFrame:
    """(key, line): each book as a line of the library's list; dates are days, tags joined, a missing rating 0, other gaps empty."""
    cells = []
    for name in (x.split(": ")[1] for x in LIBRARY_COLUMNS.replace("\n", " ").strip().split(", ")):
        c, kind = F.col(name), dict(books.dtypes)[name]
        text = F.array_join(c, ", ") if kind.startswith("array") else F.date_format(c, "yyyy-MM-dd") if kind in ("date", "timestamp", "timestamp_ntz") else c.cast("string")
        cells.append(csv_cell(F.coalesce(text, F.lit("0" if name == "stars" else ""))))
    return books.select(key, F.concat_ws(",", *cells).alias("line"))


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """A snapshot: each table as Parquet, and a manifest of their names and schemas."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, df.schema.json()) for name, df in tables.items()]
    spark.createDataFrame(rows, "name string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot; the manifest has a row a table."""
    return {r.name: spark.read.parquet(f"{path}/{r.name}") for r in spark.read.schema("name string, schema string").json(f"{path}/_manifest").collect()}
