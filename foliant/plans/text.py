"""Queries of the scalar text functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.functions.text import CJK, UNSPACED, WS
from foliant.operators import spans
from foliant.plans.common import sql_squeeze, sql_trim, sql_words, table


def t01_language(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.detect_language(F.col("text")).alias("language"))


def t02_script(spark, sf):
    return table(spark, sf, "documents").groupBy(X.script_of(F.col("lang")).alias("script"), X.base_language(F.col("lang")).alias("base")).agg(F.count(F.lit(1)).alias("n"))


def t03_units(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.count_units(F.col("text"), F.col("lang")).alias("units"))


def t04_minutes(spark, sf):
    units = t03_units(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return units.groupBy("lang").agg(F.sum("units").alias("units"), F.sum(X.reading_minutes(F.col("units"), F.col("lang"))).alias("minutes"))


def t05_formats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", (F.col("n_chars") / 40).cast("long").alias("m"))
    return docs.select("doc_id", X.format_duration(F.col("m")).alias("duration"), X.format_count(F.col("n_chars"), F.lit("zh")).alias("count"))


def t06_sentences(spark, sf):
    return spans.sentences(table(spark, sf, "documents")).select("doc_id", "start", "end", F.sha2("text", 256).alias("sha"))


def t07_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(X.escape_html(F.col("html")), 256).alias("sha"))


def t09_relabel(spark, sf):
    """Documents whose label differs from what their own characters say."""
    found = X.detect_language(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", "lang", found.alias("found"), (X.script_of(F.col("lang")) != X.script_of(found)).alias("relabel"))


def t10_isbn(spark, sf):
    code = F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    ten = F.lpad(F.col("p_partkey").cast("string"), 10, "0")
    return table(spark, sf, "part").select("p_partkey", X.is_isbn(code).alias("isbn13"), X.is_isbn(ten).alias("isbn10"))


def t11_keys(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", X.title_key(n).alias("title_key"), X.author_key(n).alias("author_key"), X.card_key(n).alias("card_key"), X.volumes(F.col("p_type")).alias("volumes"))


def t15_distance(spark, sf):
    """Bounded edit distances of the names of parts of one brand and size, -1 beyond two: all pairs of different names.

    The first part of a name stands for it: each part is 0 from it, and the first ones are compared with each other.
    """
    own = ["p_brand", "p_size", "p_name"]
    parts = table(spark, sf, "part").select("p_partkey", *own).withColumn("a", F.min("p_partkey").over(Window.partitionBy(*own)))
    members = parts.select("a", F.col("p_partkey").alias("b"), F.lit(0).alias("distance"))
    first = parts.where("p_partkey = a").select("p_brand", "p_size", "a", F.col("p_name").alias("x"))
    pairs = first.join(first.select("p_brand", "p_size", F.col("a").alias("b"), F.col("x").alias("y")), ["p_brand", "p_size"]).where("a < b")
    return members.union(pairs.select("a", "b", F.levenshtein("x", "y", 2).alias("distance")))


def t17_word_breaks(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.has_word_breaks(F.col("p_name")).alias("breaks"), X.escape_like(F.concat(F.col("p_name"), F.lit("_%"))).alias("escaped"))


def t18_versions(spark, sf):
    """Groups of documents that are one but for white space."""
    docs = table(spark, sf, "documents").select("doc_id", X.canonical_hash(F.col("text")).alias("version"))
    return docs.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def t21_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.tokens_of(F.col("text")).alias("tokens"))


def t22_cost(spark, sf):
    """What a request for each document of a language would cost: 200 tokens besides the text, half as many out."""
    units = t21_tokens(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    sums = units.groupBy("lang").agg((F.sum("tokens") + 200 * F.count(F.lit(1))).alias("tokens_in"))
    sums = sums.withColumn("tokens_out", F.ceil(F.col("tokens_in") * 0.5).cast("long"))
    return sums.withColumn("usd", F.round((F.col("tokens_in") * 3.0 + F.col("tokens_out") * 15.0) / 1000000, 6))


def t23_days(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format(F.try_to_timestamp(F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-31")), F.lit("yyyy-MM-dd")), "yyyy-MM-dd").alias("last"))


def t33_file_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.safe_file_name(F.substring("text", 1, 200)).alias("name"))


def t34_cells(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.csv_cell(F.col("text")), 256).alias("sha"))


def t40_openings(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.opening(F.col("text")).alias("opening"))


def e14_scores(spark, sf):
    scored = table(spark, sf, "part").select("p_partkey", "p_name", X.search_score(F.col("p_name"), F.col("p_brand"), ["green", "re", "brand#1"]).alias("score"))
    return scored.withColumn("rank", F.expr("CAST(row_number() OVER (PARTITION BY substr(p_name, 1, 1) ORDER BY score DESC, length(p_name), p_partkey) AS BIGINT)")).where("rank <= 20").select("p_partkey", "score", "rank")


_CJK = f"length(regexp_replace(substr(text, 1, 20000), '{CJK}', '', 'g'))"
_LANG = f"CASE WHEN (length(substr(text, 1, 20000)) - {_CJK}) / greatest(1, length(substr(text, 1, 20000))) > 0.15 THEN 'zh-Hans' ELSE 'en' END"
_BASE = "regexp_split_to_array(lower(lang), '[-_]')[1]"
_SCRIPT = f"CASE WHEN {_BASE} IN ('zh', 'ja') THEN 'cjk' ELSE 'latin' END"
_UNITS = f"CAST(CASE WHEN {_SCRIPT} = 'cjk' THEN length(regexp_replace(text, '{WS}', '', 'g')) ELSE len({sql_words('text')}) END AS BIGINT)"
_MINUTES = f"greatest(1, CAST(floor(units / CASE WHEN {_SCRIPT} = 'cjk' THEN 400 ELSE 250 END + 0.5) AS BIGINT))"
_TOKENS_CJK = r"(length(text) - length(regexp_replace(text, '[\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]', '', 'g')))"
_TOKENS = f"CAST(ceil(length(text) / CASE WHEN {_TOKENS_CJK} > length(text) * 0.2 THEN CAST(1.6 AS DOUBLE) ELSE CAST(4 AS DOUBLE) END) AS BIGINT)"
_ABBR = "|".join(X.ABBREVIATIONS)
_PIECES = f"""string_split(replace(regexp_replace(regexp_replace(text, '(?i)\\b({_ABBR})\\.({WS}|$)', '\\1' || chr(2) || '\\2', 'g'), '([.!?]["''”’)\\]]*)({WS}|$)', '\\1' || chr(1) || '\\2', 'g'), chr(2), '.'), chr(1))"""


def _digits(n: int, code: str, weight) -> str:
    return " + ".join(f"CAST({code}[{i}] AS INT) * {weight(i)}" for i in range(1, n + 1))


def _term_score(term: str) -> str:
    t = "lower(p_name)"
    rest = f"({t} || ' ' || lower(p_brand))"
    return f"""CASE WHEN instr({rest}, '{term}') = 0 THEN 1 WHEN {t} = '{term}' THEN 40 WHEN starts_with({t}, '{term} ') THEN 30
      WHEN regexp_matches({rest}, '\\b{term}\\b') THEN 20 WHEN regexp_matches({rest}, '\\b{term}') THEN 12 ELSE 2 END"""


QUERIES = {
    "t01_language": t01_language, "t02_script": t02_script, "t03_units": t03_units, "t04_minutes": t04_minutes, "t05_formats": t05_formats,
    "t06_sentences": t06_sentences, "t07_escape": t07_escape, "t09_relabel": t09_relabel, "t10_isbn": t10_isbn, "t11_keys": t11_keys, "t15_distance": t15_distance,
    "t17_word_breaks": t17_word_breaks, "t18_versions": t18_versions, "t21_tokens": t21_tokens, "t22_cost": t22_cost, "t23_days": t23_days,
    "t33_file_names": t33_file_names, "t34_cells": t34_cells, "t40_openings": t40_openings, "e14_scores": e14_scores,
}

_KEY = r"regexp_replace(regexp_replace(lower(p_name), '[(\[【][^)\]】]*[)\]】]\s*$', ''), '[^\p{L}\p{N}]+', '', 'g')"
ORACLE_SQL = {
    "t01_language": f"SELECT doc_id, {_LANG} AS language FROM documents",
    "t02_script": f"SELECT {_SCRIPT} AS script, {_BASE} AS base, count(*) AS n FROM documents GROUP BY ALL",
    "t03_units": f"SELECT doc_id, {_UNITS} AS units FROM documents",
    "t04_minutes": f"SELECT lang, CAST(sum(units) AS BIGINT) AS units, CAST(sum({_MINUTES}) AS BIGINT) AS minutes FROM (SELECT lang, {_UNITS} AS units FROM documents) GROUP BY lang",
    "t05_formats": """SELECT doc_id, CASE WHEN m < 60 THEN m || 'm' ELSE CAST(floor(m / 60.0 + 0.5) AS BIGINT) || 'h' END AS duration,
      CASE WHEN n_chars >= 10000 THEN printf('%.1f', n_chars / 10000.0::DOUBLE) || '万字' ELSE format('{:,}', n_chars) END AS count FROM (SELECT doc_id, n_chars, n_chars // 40 AS m FROM documents)""",
    "t06_sentences": f"""
      WITH p AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos FROM (SELECT doc_id, {_PIECES} AS ps FROM documents)),
      q AS (SELECT doc_id, piece, {sql_trim('piece')} AS t, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p)
      SELECT doc_id, CAST(off + length(piece) - length(regexp_replace(piece, '^{WS}+', '')) AS BIGINT) AS start,
             CAST(off + length(piece) - length(regexp_replace(piece, '^{WS}+', '')) + length(t) AS BIGINT) AS "end", sha256(t) AS sha FROM q WHERE t <> ''""",
    "t07_escape": """SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS sha FROM pages""",
    "t09_relabel": f"SELECT doc_id, lang, {_LANG} AS found, ({_SCRIPT} = 'cjk') <> (({_LANG}) = 'zh-Hans') AS relabel FROM documents",
    "t10_isbn": f"""SELECT p_partkey, ({_digits(13, 'c', lambda i: 1 if i % 2 else 3)}) % 10 = 0 AS isbn13, ({_digits(10, 't', lambda i: 11 - i)}) % 11 = 0 AS isbn10
      FROM (SELECT p_partkey, '978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS c, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS t FROM part)""",
    "t11_keys": rf"""SELECT p_partkey, {_KEY} AS title_key,
      array_to_string(list_sort(list_filter(string_split_regex(lower(p_name), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')), ' ') AS author_key,
      regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '^\s*(the|a|an)\s+', ''), '\s+', ' ', 'g')), '([a-z]{{2}}[^s])s$', '\1') AS card_key,
      array_to_string(regexp_extract_all(lower(p_type), '[0-9]+|\b[ivx]+\b'), ',') AS volumes FROM part""",
    "t15_distance": """WITH p AS (SELECT p_partkey, p_brand, p_size, p_name, min(p_partkey) OVER (PARTITION BY p_brand, p_size, p_name) AS a FROM part), f AS (SELECT * FROM p WHERE p_partkey = a)
      SELECT a, p_partkey AS b, CAST(0 AS INTEGER) AS distance FROM p UNION ALL SELECT x.a, y.a, CAST(CASE WHEN levenshtein(x.p_name, y.p_name) > 2 THEN -1 ELSE levenshtein(x.p_name, y.p_name) END AS INTEGER)
      FROM f x JOIN f y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.a < y.a""",
    "t17_word_breaks": f"""SELECT p_partkey, NOT regexp_matches(p_name, '{UNSPACED}') AS breaks, replace(replace(replace(p_name || '_%', '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped FROM part""",
    "t18_versions": f"SELECT sha256({sql_squeeze('text')}) AS version, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "t21_tokens": f"SELECT doc_id, {_TOKENS} AS tokens FROM documents",
    "t22_cost": f"""SELECT lang, tokens_in, CAST(ceil(tokens_in * CAST(0.5 AS DOUBLE)) AS BIGINT) AS tokens_out,
      round((tokens_in * CAST(3 AS DOUBLE) + ceil(tokens_in * CAST(0.5 AS DOUBLE)) * CAST(15 AS DOUBLE)) / 1000000, 6) AS usd
      FROM (SELECT lang, CAST(sum({_TOKENS}) + 200 * count(*) AS BIGINT) AS tokens_in FROM documents GROUP BY lang)""",
    "t23_days": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(try_strptime(strftime(o_orderdate, '%Y-%m') || '-31', '%Y-%m-%d'), '%Y-%m-%d') AS last FROM orders",
    "t33_file_names": f"""SELECT doc_id, CASE WHEN n = '' THEN 'book' ELSE n END AS name
      FROM (SELECT doc_id, substr({sql_trim("regexp_replace(substr(text, 1, 200), '[/" + chr(92) * 2 + "?%*:|" + chr(34) + "<>]', '-', 'g')")}, 1, 80) AS n FROM documents)""",
    "t34_cells": """SELECT doc_id, sha256(CASE WHEN regexp_matches(t, '[",\\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END) AS sha
      FROM (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents)""",
    "t40_openings": f"SELECT doc_id, CASE WHEN length(b) > 48 THEN rtrim(substr(b, 1, 48)) || '…' ELSE b END AS opening FROM (SELECT doc_id, {sql_squeeze('text')} AS b FROM documents)",
    "e14_scores": f"""SELECT p_partkey, score, rank FROM (SELECT p_partkey, score, row_number() OVER (PARTITION BY substr(p_name, 1, 1) ORDER BY score DESC, length(p_name), p_partkey) AS rank
      FROM (SELECT p_partkey, p_name, CAST({_term_score('green')} + {_term_score('re')} + {_term_score('brand#1')} AS INTEGER) AS score FROM part)) WHERE rank <= 20""",
}
