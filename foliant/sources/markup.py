"""Readers of marked-up text as line and block tables: HTML, Markdown, USFM, links and metadata.

What a parser keeps in its state, such as whether a line is inside a fence, is a running sum over a document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import decode_entities, strip_tags
from foliant.operators.spans import once

#: Tags whose content is not the page's text, and tags that end a block.
FURNITURE = ("script", "style", "noscript", "nav", "aside", "footer", "form")
BLOCK_END = "p|div|h[1-6]|li|blockquote|section|article|figcaption|pre|td"


def html_content(html: Column) -> Column:
    """The body's article or main part, or the body, without comments and furniture; <br> is a line end."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    x = F.regexp_replace(F.when(body != "", body).otherwise(html), r"(?s)<!--.*?-->", "")
    article, main = (F.regexp_extract(x, rf"(?is)<{t}[^>]*>(.*)</{t}>", 1) for t in ("article", "main"))
    x = F.when(article != "", article).when(main != "", main).otherwise(x)
    for tag in FURNITURE:
        x = F.regexp_replace(x, rf"(?is)<{tag}([\s/][^>]*)?>.*?</{tag}>", "")
    return F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, level, text) of the blocks of pages; level is a heading's 1 to 6 or 0, list items begin with a bullet."""
    marked = F.regexp_replace(html_content(F.col(html_col)), rf"(?i)</({BLOCK_END})\s*>", "\x02$1\x01")
    rows = pages.select(id_col, F.posexplode(F.split(marked, "\x01")).alias("pos", "piece"))
    tag, body = F.lower(F.regexp_extract("piece", "\x02(.*)", 1)), F.substring_index("piece", "\x02", 1)
    text = F.trim(F.regexp_replace(decode_entities(strip_tags(body)), r"[ \t\r\f\x0B]+", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"\A[ \n]+", ""), r"[ \n]+\z", "")
    level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).otherwise(0)
    rows = rows.select(id_col, F.col("pos").cast("long").alias("pos"), level.alias("level"), text.alias("text"), (tag == "li").alias("li")).where("text <> ''")
    return rows.select(id_col, "pos", "level", F.when(F.col("li"), F.concat(F.lit("• "), F.col("text"))).otherwise(F.col("text")).alias("text"))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, href) of the links of pages."""
    found = F.regexp_extract_all(html_col, F.lit(r"""(?i)<a\s[^>]*?href="([^"]*)\""""), 1)
    return pages.select(id_col, F.posexplode(found).alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))


def title_of(html: Column) -> Column:
    return F.trim(decode_entities(strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))))


def slugs(headings: DataFrame, id_col: str, pos: str, text: str) -> DataFrame:
    """headings with slug: lower-case words joined by hyphens, -1, -2 … on those a document has had."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col(text))), r"[^\p{L}\p{N} _-]", ""), " ", "-")
    n = F.row_number().over(Window.partitionBy(id_col, "__s").orderBy(pos)) - 1
    rows = headings.withColumn("__s", bare).withColumn("__n", n)
    return rows.withColumn("slug", F.when(F.col("__n") > 0, F.concat("__s", F.lit("-"), F.col("__n").cast("string"))).otherwise(F.col("__s"))).drop("__s", "__n")


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, kind, level, text) of Markdown texts; kind is heading, code, table, item, rule or text.

    Fences hold all their lines, blank ones too; a line of = or - under text makes it a heading; runs of table lines and
    of text lines are one block each, and every list item is one.
    """
    lines = docs.select(id_col, F.posexplode(F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n")).alias("pos", "line"))
    w = Window.partitionBy(id_col).orderBy("pos")
    line = F.col("line")
    lines = lines.withColumn("fence", line.rlike(r"^ {0,3}(```|~~~)").cast("int"))
    lines = lines.withColumn("opened", F.sum("fence").over(w))
    inside = (F.col("opened") % 2 == 1) | (F.col("fence") == 1)
    under = F.lead("line").over(w)
    plain = ~line.rlike(r"^\s*$|^ {0,3}(#{1,6}\s|[-*+]\s|\d{1,9}[.)]\s|\||>)")
    setext = F.when(plain & under.rlike(r"^=+\s*$"), 1).when(plain & under.rlike(r"^-+\s*$"), 2)
    atx = F.regexp_extract("line", r"^ {0,3}(#{1,6})\s", 1)
    kind = (
        F.when(inside, "code").when(line.rlike(r"^\s*$"), "blank").when(atx != "", "heading").when(setext.isNotNull(), "heading")
        .when(line.rlike(r"^(=+|-+)\s*$") & (F.lag("line").over(w).rlike(r"\S")), "blank")
        .when(line.rlike(r"^ {0,3}([-*_]\s*){3,}$"), "rule").when(line.rlike(r"^\s*\|"), "table").when(line.rlike(r"^\s*([-*+]|\d{1,9}[.)])\s"), "item").otherwise("text")
    )
    level = F.when(inside, 0).when(atx != "", F.length(atx)).otherwise(F.coalesce(setext, F.lit(0)))
    lines = lines.withColumn("kind", kind).withColumn("level", level)
    same = (F.lag("kind").over(w) == F.col("kind")) & F.col("kind").isin("code", "table", "text") & ~((F.col("fence") == 1) & (F.col("opened") % 2 == 1))
    lines = lines.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w)).where("kind <> 'blank'")
    clean = F.when(F.col("kind") == "heading", F.regexp_replace(F.regexp_replace("line", r"^ {0,3}#{1,6}\s+", ""), r"\s+#*\s*$", "")).when(F.col("kind") == "item", F.regexp_replace("line", r"^\s*([-*+]|\d{1,9}[.)])\s+", "• ")).when(F.col("kind") == "rule", "* * *").otherwise(F.col("line"))
    own = lines.groupBy(id_col, "run", "kind").agg(F.min("pos").alias("pos"), F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("pos", clean.alias("t")))).alias("x"))
    return own.select(id_col, "pos", "kind", "level", F.array_join(F.transform("x", lambda s: s["t"]), "\n").alias("text"))


def front_matter(text: Column, name: str) -> Column:
    """A field of the block between --- lines that a text begins with; null without it."""
    block = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---\s*(\n|\z)", 1)
    value = F.trim(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(.*)$", 1))
    return F.nullif(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit(""))


def usfm_verses(books: DataFrame, id_col: str = "book", text_col: str = "text") -> DataFrame:
    """(id, chapter, verse, text) of USFM texts, one a row: lines belong to the last \\c and \\v before them, notes are left out.

    A text is cut at these marks, and a verse given twice joined, within its row.
    """
    flat = F.regexp_replace(F.regexp_replace(text_col, r"(?s)\\(f|x)\s.*?\\\1\*", ""), r"\\v\s", "\n\\\\v ")
    blocks = lambda text, mark: F.split(text, rf"\n(?=[^\S\n]*\\{mark}[^\S\n]+\d)")
    number = lambda block, mark: F.nullif(F.regexp_extract(block, rf"^[^\S\n]*\\{mark}[^\S\n]+(\d+)", 1), F.lit("")).cast("int")

    def cleaned(block: Column) -> Column:
        bare = F.regexp_replace(block, r"^[^\S\n]*\\v[^\S\n]+\d+\S*[^\S\n]*", "")
        return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\\[a-z]+\d*\*?[^\S\n]?", ""), r"\s+", " "))

    def chapter(block: Column) -> Column:
        verses = lambda c: F.transform(blocks(block, "v"), lambda x: F.struct(c.alias("chapter"), number(x, "v").alias("verse"), cleaned(x).alias("text")))
        return once(number(block, "c"), verses)

    key = lambda x: F.shiftleft(x["chapter"].cast("long"), 32) + x["verse"]

    def merged(all_: Column) -> Column:
        def one(k: Column) -> Column:
            own = F.filter(all_, lambda x: key(x) == k)
            text = F.array_join(F.filter(F.transform(own, lambda x: x["text"]), lambda t: t != ""), " ")
            return F.struct(F.get(own, F.lit(0))["chapter"].alias("chapter"), F.get(own, F.lit(0))["verse"].alias("verse"), text.alias("text"))

        return once(F.array_distinct(F.transform(all_, key)), lambda keys: F.when(F.size(keys) == F.size(all_), all_).otherwise(F.transform(keys, one)))

    found = F.filter(F.flatten(F.transform(blocks(flat, "c"), chapter)), lambda x: x["chapter"].isNotNull() & (x["verse"] > 0))
    return books.select(id_col, F.explode(once(found, merged)).alias("x")).select(id_col, "x.chapter", "x.verse", "x.text")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-16 by its mark, UTF-8 with or without one if it is valid, else null; CRLF and CR are line ends."""
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda at: F.substring(content, F.lit(at), F.length(content))
    wide = F.when(F.startswith(head, F.lit("FFFE")), F.decode(rest(3), "UTF-16LE")).when(F.startswith(head, F.lit("FEFF")), F.decode(rest(3), "UTF-16BE"))
    text = F.coalesce(wide, F.try_validate_utf8(F.when(head == "EFBBBF", rest(4)).otherwise(content).cast("string")))
    return F.regexp_replace(text, "\r\n?", "\n")


def lossy_utf8(content: Column) -> Column:
    """Bytes as UTF-8 text, with U+FFFD in place of bad ones."""
    return F.make_valid_utf8(content.cast("string"))


def with_text(files: DataFrame, content: str = "content", text: str = "text") -> DataFrame:
    """files with their bytes as text, see decoded(); only files that are neither UTF-8 nor UTF-16 go through Python, as GB18030."""
    known = files.withColumn(text, decoded(F.col(content)))
    other = known.where(F.col(text).isNull() & F.col(content).isNotNull())
    other = other.withColumn(text, F.regexp_replace(_gb18030(F.col(content)), "\r\n?", "\n"))
    return known.where(F.col(text).isNotNull() | F.col(content).isNull()).unionByName(other)


@F.pandas_udf(T.StringType())
def _gb18030(content):
    return content.map(lambda b: None if b is None else bytes(b).decode("gb18030", "replace"))


def url_parts(url: Column) -> Column:
    """struct<host, path, query, owner, repo> of a URL; owner and repo are its path's first two steps."""
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    step = lambda i: F.nullif(F.split_part(path, F.lit("/"), F.lit(i)), F.lit(""))
    return F.struct(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)).alias("host"), path.alias("path"), F.regexp_extract(url, r"\?([^#]*)", 1).alias("query"), step(2).alias("owner"), F.regexp_replace(step(3), r"\.git$|\.html$", "").alias("repo"))


def download_of(url: Column) -> Column:
    """struct<url, name>: where the file behind a page's address is: of shared documents and drives, and of files in repositories."""
    doc = F.regexp_extract(url, r"docs\.google\.com/document/d/([A-Za-z0-9_-]+)", 1)
    drive = F.regexp_extract(url, r"drive\.google\.com/file/d/([A-Za-z0-9_-]+)", 1)
    blob = lambda i: F.regexp_extract(url, r"github\.com/([^/]+)/([^/]+)/blob/([^?#]+)", i)
    path = blob(3)
    file = F.regexp_extract(path, "([^/]*)$", 1)
    made = lambda at, name: F.struct(at.alias("url"), name.alias("name"))
    shared = made(F.concat(F.lit("https://docs.google.com/document/d/"), doc, F.lit("/export?format=docx")), F.concat(doc, F.lit(".docx")))
    raw = made(F.concat_ws("/", F.lit("https://raw.githubusercontent.com"), blob(1), blob(2), path), F.coalesce(F.try_url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), file))
    kept = made(F.concat(F.lit("https://drive.google.com/uc?export=download&id="), drive), drive)
    return F.when(doc != "", shared).when(path != "", raw).when(drive != "", kept).otherwise(made(url, F.lit(None).cast("string")))


LINKED = r"""(!?)\[((?:[^\[\]\\]|\\.)*)\]\(\s*<?([^()\s<>]*)>?(?:\s+["'(][^)]*)?\s*\)"""
#: What stays as it was typed: code between backticks and formulas between dollar signs; all else comes in runs between them.
TYPED = r"(?s)(`+[^`]*`+|\$[^\s$](?:[^$\n]*[^\s$])?\$(?![0-9])|[^`$]+|[`$])"


def inline_links(text: Column) -> Column:
    """array<struct<words, href>> of the links of a Markdown text in order, images left out, and addresses in angle brackets."""
    found = F.regexp_extract_all(text, F.lit(f"{LINKED}|<((?:https?|mailto):[^<>\\s]+)>"), 0)
    part = lambda x, i: F.regexp_extract(x, LINKED, i)
    one = lambda x: F.when(F.startswith(x, F.lit("<")), F.struct(F.btrim(x, F.lit("<>")).alias("words"), F.btrim(x, F.lit("<>")).alias("href"))).otherwise(F.struct(part(x, 2).alias("words"), part(x, 3).alias("href")))
    return F.filter(F.transform(F.filter(found, lambda x: ~F.startswith(x, F.lit("!"))), one), lambda s: s["href"] != "")


def inline_plain(text: Column) -> Column:
    """The words of a Markdown text: links and images by theirs, without comments, tags, emphasis and escapes; code and formulas stay."""
    def words(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
        x = F.regexp_replace(x, r"<((?:https?|mailto):[^<>\s]+)>", "$1")
        x = F.regexp_replace(x, r"</?[A-Za-z][^<>]*>", "")
        for sign in (r"\*\*", "__", "~~"):
            x = F.regexp_replace(x, rf"{sign}(?=\S)(.+?)(?<=\S){sign}", "$1")
        for sign in (r"\*", "_"):
            x = F.regexp_replace(x, rf"(?<![\w\\]){sign}(?=\S)([^*_\n]+?)(?<=\S){sign}(?!\w)", "$1")
        return F.regexp_replace(x, r"\\([\\`*_{}\[\]()#+.!<>~-])", "$1")

    linked = F.regexp_replace(text, LINKED, "$2")
    parts = F.regexp_extract_all(linked, F.lit(TYPED), 1)
    typed = lambda x: (F.length(x) > 1) & x.rlike(r"\A[`$]")
    return F.array_join(F.transform(parts, lambda x: F.when(typed(x), x).otherwise(words(x))), "")
