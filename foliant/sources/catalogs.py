"""Readers of catalogs: search answers in JSON, feeds in XML, and what they have in common as one table of candidates.

An answer or feed is one text a row; broken ones have no rows. Every reader gives
(source, ext_id, title, author, year, language, isbn, href).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import clean_isbn, decode_entities, is_isbn, strip_tags, title_key

COLUMNS = ("source", "ext_id", "title", "author", "year", "language", "isbn", "href")
#: Three-letter language codes that catalogs use, by the code used here.
LANGUAGES = {"eng": "en", "fre": "fr", "fra": "fr", "ger": "de", "deu": "de", "spa": "es", "ita": "it", "por": "pt", "rus": "ru", "jpn": "ja", "kor": "ko", "chi": "zh", "zho": "zh", "lat": "la", "dut": "nl", "nld": "nl"}


def language_of(code: Column) -> Column:
    low = F.lower(F.trim(code))
    out = low
    for long_code, short in LANGUAGES.items():
        out = F.when(low == long_code, short).otherwise(out)
    return F.nullif(out, F.lit(""))


def _candidates(rows: DataFrame, source: str, **cols: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    named = {c: cols.get(c, null).cast("string") for c in COLUMNS[1:]}
    out = rows.select(F.lit(source).alias("source"), *[v.alias(c) for c, v in named.items()])
    return out.where("trim(coalesce(title, '')) <> ''")


def _first_isbn(codes: Column) -> Column:
    return F.get(F.filter(F.transform(codes, clean_isbn), is_isbn), F.lit(0))


def from_search(answers: DataFrame, col: str = "json") -> DataFrame:
    """Works of a search answer: {"docs": [{key, title, author_name, first_publish_year, language, isbn}]}."""
    schema = "docs ARRAY<STRUCT<key: STRING, title: STRING, author_name: ARRAY<STRING>, first_publish_year: INT, language: ARRAY<STRING>, isbn: ARRAY<STRING>>>"
    d = answers.select(F.explode(F.from_json(col, schema)["docs"]).alias("d")).select("d.*")
    return _candidates(d, "works", ext_id=F.col("key"), title=F.col("title"), author=F.array_join("author_name", ", "), year=F.col("first_publish_year"), language=language_of(F.get("language", F.lit(0))), isbn=_first_isbn(F.col("isbn")))


def from_subject(answers: DataFrame, col: str = "json") -> DataFrame:
    """Works of a subject: {"works": [{key, title, authors: [{name}], first_publish_year}]}."""
    schema = "works ARRAY<STRUCT<key: STRING, title: STRING, authors: ARRAY<STRUCT<name: STRING>>, first_publish_year: INT>>"
    d = answers.select(F.explode(F.from_json(col, schema)["works"]).alias("d")).select("d.*")
    return _candidates(d, "subject", ext_id=F.col("key"), title=F.col("title"), author=F.array_join(F.col("authors.name"), ", "), year=F.col("first_publish_year"))


def from_volumes(answers: DataFrame, col: str = "json") -> DataFrame:
    """Volumes of a book search: {"items": [{id, volumeInfo: {title, subtitle, authors, publishedDate, language, industryIdentifiers}}]}."""
    info = "title: STRING, subtitle: STRING, authors: ARRAY<STRING>, publishedDate: STRING, language: STRING, infoLink: STRING, industryIdentifiers: ARRAY<STRUCT<type: STRING, identifier: STRING>>"
    d = answers.select(F.explode(F.from_json(col, f"items ARRAY<STRUCT<id: STRING, volumeInfo: STRUCT<{info}>>>")["items"]).alias("d")).select("d.id", "d.volumeInfo.*")
    title = F.concat_ws(": ", "title", "subtitle")
    return _candidates(d, "volumes", ext_id=F.col("id"), title=title, author=F.array_join("authors", ", "), year=F.substring("publishedDate", 1, 4), language=language_of(F.col("language")), isbn=_first_isbn(F.col("industryIdentifiers.identifier")), href=F.col("infoLink"))


def from_store(answers: DataFrame, col: str = "json") -> DataFrame:
    """Books of a store's search: {"results": [{trackId, trackName, artistName, releaseDate, trackViewUrl}]}."""
    d = answers.select(F.explode(F.from_json(col, "results ARRAY<STRUCT<trackId: BIGINT, trackName: STRING, artistName: STRING, releaseDate: STRING, trackViewUrl: STRING>>")["results"]).alias("d")).select("d.*")
    return _candidates(d, "store", ext_id=F.col("trackId"), title=F.col("trackName"), author=F.col("artistName"), year=F.substring("releaseDate", 1, 4), href=F.col("trackViewUrl"))


def _inner(xml: Column, tag: str) -> Column:
    """The text of the first element of a name."""
    raw = F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>", 1)
    raw = F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.nullif(F.trim(F.regexp_replace(decode_entities(strip_tags(raw)), r"\s+", " ")), F.lit(""))


def from_atom(feeds: DataFrame, col: str = "xml", source: str = "atom") -> DataFrame:
    """Entries of an Atom or OPDS feed, or papers of one: id, title, all authors, year, language and the link to acquire it."""
    e = feeds.select(F.explode(F.regexp_extract_all(col, F.lit(r"(?s)<(?:\w+:)?entry(?:\s[^>]*)?>(.*?)</(?:\w+:)?entry>"), 1)).alias("e"))
    names = F.regexp_extract_all("e", F.lit(r"(?s)<(?:\w+:)?author>.*?<(?:\w+:)?name>(.*?)</"), 1)
    link = F.regexp_extract("e", r"""<link[^>]*rel="[^"]*(?:acquisition|alternate)[^"]*"[^>]*href="([^"]*)\"""", 1)
    turned = F.regexp_extract("e", r"""<link[^>]*href="([^"]*)"[^>]*rel="[^"]*(?:acquisition|alternate)[^"]*\"""", 1)
    x = F.col("e")
    return _candidates(e, source, ext_id=_inner(x, "id"), title=_inner(x, "title"), author=F.array_join(F.transform(names, lambda n: F.trim(decode_entities(n))), ", "), year=F.substring(F.coalesce(_inner(x, "issued"), _inner(x, "published")), 1, 4), language=language_of(_inner(x, "language")), href=F.nullif(F.coalesce(F.nullif(link, F.lit("")), turned), F.lit("")))


def from_rss(feeds: DataFrame, col: str = "xml") -> DataFrame:
    """Items of a shelf's feed: title, author, year and ISBN; one row for each id."""
    e = feeds.select(F.explode(F.regexp_extract_all(col, F.lit(r"(?s)<item>(.*?)</item>"), 1)).alias("e"))
    x = F.col("e")
    rows = _candidates(e, "shelf", ext_id=F.coalesce(_inner(x, "book_id"), _inner(x, "guid")), title=_inner(x, "title"), author=_inner(x, "author_name"), year=F.substring(_inner(x, "book_published"), 1, 4), isbn=_first_isbn(F.array(_inner(x, "isbn"))), href=_inner(x, "link"))
    return rows.dropDuplicates(["ext_id"])


def from_bible_list(table: DataFrame) -> DataFrame:
    """Translations that may be passed on, of a table with languageCode, translationId, title and Redistributable."""
    free = table.where(F.lower("Redistributable") == "true")
    return _candidates(free, "bibles", ext_id=F.col("translationId"), title=F.col("title"), language=language_of(F.col("languageCode")))


def merged(candidates: DataFrame) -> DataFrame:
    """One candidate of each ISBN, or of title, author and year without one: the one that tells most, then by source and id."""
    key = F.coalesce(F.col("isbn"), F.concat_ws("|", title_key(F.col("title")), F.lower("author"), F.col("year")))
    told = sum((F.col(c).isNotNull().cast("int") for c in COLUMNS[3:]), F.lit(0))
    best = candidates.groupBy(key.alias("key")).agg(F.min(F.struct((-told).alias("n"), *COLUMNS)).alias("x"))
    return best.select([F.col(f"x.{c}").alias(c) for c in COLUMNS])


def places(names: DataFrame, gazetteer: DataFrame, name: str = "name") -> DataFrame:
    """names with place, lat and lon of the gazetteer (place, lat, lon): by the whole name, or without what describes it.

    Forms are the name, the name without an article or a leading or trailing kind of place, tried in that order.
    """
    low = F.lower(F.trim(F.col(name)))
    bare = F.regexp_replace(low, "^(the|a|an) ", "")
    kind = "(city|town|village|river|mount|mountain|lake|sea|land|kingdom|island|province|region|desert|valley)"
    forms = F.array(low, bare, F.regexp_replace(bare, f"^{kind}( of)? ", ""), F.regexp_replace(bare, f" {kind}$", ""))
    own = gazetteer.select(F.lower("place").alias("__k"), "place", "lat", "lon")
    rows = names.select(name).distinct().select(name, F.posexplode(forms).alias("__i", "__k"))
    best = rows.join(own, "__k").groupBy(name).agg(F.min(F.struct("__i", "place", "lat", "lon")).alias("x"))
    return names.join(best, name, "left").select(*names.columns, "x.place", "x.lat", "x.lon")
