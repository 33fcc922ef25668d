"""Queries of detection, links, alignment, merges and small forms over values that the tables lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import align, graph, records, resolve, spans, structure
from foliant.plans.common import SQL_PARAGRAPHS, sql_trim, table
from foliant.plans.resolve import _SH, _TK
from foliant.plans.structure import _lines
from foliant.sources import markup


def _zh(spark, sf):
    """Documents in Han signs: full-width stops for those of the text, and letters as signs."""
    text = F.translate("text", "etaoinsrh.?!,", "的一是不了人我在有。？！，")
    return table(spark, sf, "documents").select("doc_id", "lang", text.alias("text"))


def t01_scripts(spark, sf):
    """Texts half in Latin letters, half in Han signs, told by their share of the latter."""
    both = table(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id", "text").unionByName(_zh(spark, sf).where("doc_id % 2 = 1").select("doc_id", "text"))
    return both.select("doc_id", X.detect_language(F.col("text")).alias("language"))


def t06_cjk(spark, sf):
    """Sentences of texts in CJK script."""
    return spans.sentences(_zh(spark, sf).withColumn("lang", F.lit("zh-Hans")), lang_col="lang").select("doc_id", "start", "end", F.sha2("text", 256).alias("sha"))


def t12_main_keys(spark, sf):
    """Keys of titles with subtitles, some of which name a volume."""
    title = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(": a tale of "), F.lower("p_type"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" - volume "), F.col("p_size").cast("string"))).otherwise(""))
    return table(spark, sf, "part").select("p_partkey", X.main_title_key(title).alias("main"))


def t28_pins(spark, sf):
    """Claims of where places are now, with what is sure of them."""
    claim = F.when(F.col("n_nationkey") % 5 == 0, "Unknown").when(F.col("n_nationkey") % 5 == 1, F.concat(F.col("n_name"), F.lit(" one two three four five six"))).otherwise(F.concat(F.lit(" "), F.initcap("n_name")))
    stated = F.when(F.col("n_regionkey") == 1, "Certain").when(F.col("n_regionkey") == 2, "maybe").when(F.col("n_regionkey") == 3, "disputed")
    pin = X.pin(claim, stated)
    return table(spark, sf, "nation").select("n_nationkey", pin["located"].alias("located"), pin["certainty"].alias("certainty"))


def t29_articles(spark, sf):
    """Addresses of encyclopedia articles by name or link."""
    said = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.initcap("n_name"))).when(F.col("n_nationkey") % 4 == 1, "https://en.wikipedia.org/wiki/Special:Search").when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit("http://x.org/"), "n_name")).otherwise(F.concat(F.lit(" "), F.initcap("n_name"), F.lit("  land ")))
    return table(spark, sf, "nation").select("n_nationkey", X.wiki_link(said).alias("article"))


def t31_part_names(spark, sf):
    """Names of parts of books, those left out that say nothing."""
    name = F.when(F.col("p_size") % 4 == 0, " N/A ").when(F.col("p_size") % 4 == 1, "未知").when(F.col("p_size") % 4 == 2, "Part").otherwise(F.concat(F.lit(" "), "p_name"))
    return table(spark, sf, "part").select("p_partkey", structure.meaningful_name(name).alias("name"))


def _blocks(spark, sf):
    """Lines as blocks: documents by turns with headings of two levels, with chapter lines, with boundaries, with nothing."""
    lines = _lines(spark, sf).withColumn("way", F.col("doc_id") % 4)
    text = F.when((F.col("way") == 1) & (F.col("pos") % 4 == 1), F.concat(F.lit("Chapter "), F.col("pos").cast("string"))).otherwise(F.col("text"))
    heading = F.when((F.col("way") == 0) & (F.col("pos") % 12 == 2), 1).when((F.col("way") == 0) & (F.col("pos") % 4 == 3), 2)
    boundary = (F.col("way") <= 2) & (F.col("pos") % 6 == 0)
    return lines.select("doc_id", "start", "end", text.alias("text"), heading.alias("heading"), boundary.alias("boundary"))


def d04_cascade(spark, sf):
    """Chapters by headings, else by lines, else by boundaries, else whole."""
    docs = table(spark, sf, "documents").select("doc_id", F.lit("en").alias("lang"), F.col("n_chars").alias("length"))
    return structure.detected_chapters(_blocks(spark, sf), docs).select("doc_id", "method", F.sha2("title", 256).alias("title"), "start", "end", "confident")


def d09_hints(spark, sf):
    """Blocks of texts with blank lines, found again from the text and its hints."""
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    own = spans.paragraphs(docs, "\n\n").withColumn("heading", F.when(F.col("pos") % 5 == 0, 1)).withColumn("boundary", F.col("pos") % 7 == 0)
    again = structure.blocks_from_hints(docs, structure.hints_of(own))
    return again.select("doc_id", "start", "end", "heading", "boundary")


def d10_links(spark, sf):
    """Links of lines to anchors of lines, some in other case, escaped, unknown, or to elsewhere."""
    lines = _lines(spark, sf).where("pos < 20")
    anchors = lines.where("pos % 3 = 0").select("doc_id", F.concat(F.lit("Né "), (F.col("pos") % 9).cast("string")).alias("anchor"), F.col("start").alias("at"))
    k = F.col("pos") % 5
    href = F.when(k == 0, F.concat(F.lit("#N%C3%A9%20"), (F.col("pos") % 10).cast("string"))).when(k == 1, F.concat(F.lit("#né "), (F.col("pos") % 9).cast("string"))).when(k == 2, "#gone").when(k == 3, "HTTPS://x.org/a").otherwise("notes.html")
    found = structure.resolved_links(lines.select("doc_id", "start", "end", href.alias("href")), anchors)
    return found.select("doc_id", "start", "href", "at")


def j11_progress(spark, sf):
    """Places a third of the way in, found again in texts with a preface and without their first forty characters."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.floor(F.length("text") / 3).cast("int").alias("at"))
    new = F.concat(F.repeat(F.lit("preface "), F.lit(9)), F.substring("text", F.lit(41), F.length("text")))
    return docs.select("doc_id", structure.placed_again(F.col("text"), F.col("at"), new).alias("at"))


def j10_anchors(spark, sf):
    """Quotes of forty characters that a document has once, found again behind a preface."""
    t = F.col("text")
    docs = table(spark, sf, "documents").where((F.col("n_chars") >= 200) & (X.occurrences(t, F.substring(t, 101, 40)) == 1))
    rows = docs.select("doc_id", align.reanchored(F.concat(F.lit("preface "), t), F.lit(100), F.substring(t, 101, 40), F.substring(t, 81, 20), F.substring(t, 141, 20)).alias("x"))
    return rows.select("doc_id", "x.start", "x.end")


def l01_alignment(spark, sf):
    """Orders' lines as chapters and the same with some left out, some new and some changed: steps by kind."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    words = lambda k: F.concat_ws(" ", *(F.concat(F.lit(f"w{i}x"), (F.col("l_partkey") * (i + k) % 997).cast("string")) for i in range(1, 9)))
    base = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("idx"), F.concat(F.lit("Chapter "), F.col("l_linenumber").cast("string")).alias("title"), F.concat(words(0), F.lit(" "), F.col("l_linenumber").cast("string")).alias("text"))
    kept = base.where((F.col("idx") + F.col("l_orderkey")) % 4 != 0)
    changed = kept.withColumn("text", F.when(F.col("idx") % 3 == 0, F.concat("text", F.lit(" and more"))).otherwise(F.col("text")))
    steps = align.chapters(base, changed, "l_orderkey")
    return align.tally(steps, "l_orderkey")


def l05_near_documents(spark, sf):
    """Documents by the pairs of words in them: the smallest id with the same ones, and how many other sets are near."""
    return resolve.near_links(table(spark, sf, "documents"), set_col="text")


def l05_near_classes(spark, sf):
    """Documents by the pairs of words in them, as classes of near ones."""
    return resolve.near_classes(table(spark, sf, "documents"), set_col="text")


def _merges(spark, sf):
    """Each supplier whose key ends in 5 is merged into the one before."""
    return table(spark, sf, "supplier").where("s_suppkey % 10 = 5").select((F.col("s_suppkey") - 1).alias("keep"), F.col("s_suppkey").alias("other"))


def e08_merge(spark, sf):
    """Suppliers merged: marks united, lines moved, balances the greater, and all lines back after an undo."""
    li, merges = table(spark, sf, "lineitem"), _merges(spark, sf)
    s = table(spark, sf, "supplier").withColumn("nation", F.when(F.col("s_suppkey") % 10 != 4, F.col("s_nationkey")))
    books = records.merged_books(s, merges, "s_suppkey", ["nation"], ["s_acctbal"])
    marks = records.merged_marks(li.select("l_suppkey", "l_returnflag", "l_linestatus").distinct(), merges, "l_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("marks"))
    moved = records.moved_rows(li.select("l_suppkey", "l_orderkey"), merges, "l_suppkey")
    notes = moved.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("notes"), F.count("was").alias("moved"))
    back = records.undone(moved, "l_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("undone"))
    out = books
    for df in (marks, notes, back):
        out = out.join(df.withColumnRenamed("l_suppkey", "s_suppkey"), "s_suppkey", "left")
    return out


def r12_entities(spark, sf):
    """Names with their signs as numbered references, by tens or by sixteens."""
    one = lambda x: F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("&#"), F.ascii(x).cast("string"), F.lit(";"))).otherwise(F.concat(F.lit("&#x"), F.lower(F.hex(F.ascii(x))), F.lit(";")))
    text = F.concat(F.array_join(F.transform(F.split("p_name", ""), one), ""), F.lit(" &#20013;&#x1F600;&#38;amp; &lt;&#0;&amp;lt;"))
    return table(spark, sf, "part").select("p_partkey", X.decode_entities(text).alias("text"))


def r29_downloads(spark, sf):
    """Addresses of pages and of the files behind them."""
    k, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://docs.google.com/document/d/a_"), n, F.lit("/edit"))).when(k == 1, F.concat(F.lit("https://github.com/me/books/blob/main/a/b%20"), n, F.lit(".md#top"))).when(k == 2, F.concat(F.lit("https://drive.google.com/file/d/x"), n, F.lit("/view"))).otherwise(F.concat(F.lit("https://x.org/"), n))
    found = markup.download_of(url)
    return table(spark, sf, "part").select("p_partkey", found["url"].alias("url"), found["name"].alias("name"))


def e18_references(spark, sf):
    """Nations as books, customers as references to their chapters in five ways."""
    n = table(spark, sf, "nation")
    books = n.select(F.initcap("n_name").alias("book"), F.concat(F.lit("Z"), F.col("n_nationkey").cast("string")).alias("code"), F.array(F.concat(F.lit("land of "), F.col("n_name"))).alias("aliases"), (F.col("n_nationkey") % 7 + 3).alias("chapters"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 6
    name = F.when(k == 0, F.upper("n_name")).when(k == 1, F.concat(F.lit("z"), F.col("n_nationkey").cast("string"))).when(k == 2, F.concat(F.lit(" Land  of "), F.col("n_name"))).when(k == 3, F.substring("n_name", 1, 3)).when(k == 4, "nowhere").otherwise(F.col("n_name"))
    said = F.concat(name, F.lit(" "), (F.col("c_custkey") % 11).cast("string"), F.when(k == 5, ":4").otherwise(" "))
    return resolve.references(c.select(F.col("c_custkey").alias("id"), said.alias("said")), books)


def c14_clauses(spark, sf):
    """What is known of each brand from its parts' names, without what another clause holds."""
    p = table(spark, sf, "part").where("p_size <= 3")
    rows = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    return rows.select("p_brand", X.merged_clauses(F.transform("x", lambda s: s["p_name"])).alias("clauses"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[0] in "tdjlecr" and name[1:3].isdigit()}

_ZH = "SELECT doc_id, lang, translate(text, 'etaoinsrh.?!,', '的一是不了人我在有。？！，') AS text FROM documents"
_BL = f"""lines AS ({SQL_PARAGRAPHS}), bl AS (SELECT doc_id, start, start + length(text) AS "end", CASE WHEN doc_id % 4 = 1 AND pos % 4 = 1 THEN 'Chapter ' || pos ELSE text END AS text,
  CASE WHEN doc_id % 4 = 0 AND pos % 12 = 2 THEN 1 WHEN doc_id % 4 = 0 AND pos % 4 = 3 THEN 2 END AS heading, doc_id % 4 <= 2 AND pos % 6 = 0 AS boundary FROM lines)"""
_LINE = r"(?i)^(chapter|part|book|act|interlude)\b[\s.:—-]*([0-9]+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|twenty|thirty)?\b"
_W = lambda k: " || ' ' || ".join(f"'w{i}x' || (l_partkey * {i + k} % 997)" for i in range(1, 9))
ORACLE_SQL = {
    "t01_scripts": f"WITH z AS ({_ZH}), t AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, text FROM z WHERE doc_id % 2 = 1), s AS (SELECT doc_id, substr(text, 1, 20000) AS t FROM t) SELECT doc_id, CASE WHEN (length(t) - length(regexp_replace(t, '{X.CJK}', '', 'g'))) / greatest(1, length(t)) > 0.15 THEN 'zh-Hans' ELSE 'en' END AS language FROM s",
    "t06_cjk": f"""WITH z AS ({_ZH}), p AS (SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '([。！？…]+["''”’」』）】]*)', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM z)),
      o AS (SELECT doc_id, piece, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x FROM p), k AS (SELECT doc_id, x + length(piece) - length(regexp_replace(piece, '^{X.WS}+', '')) AS start, {sql_trim('piece')} AS t FROM o)
      SELECT doc_id, start, start + length(t) AS "end", sha256(t) AS sha FROM k WHERE t <> ''""",
    "t12_main_keys": f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN {_TK.format("p_name || ' - volume ' || p_size")} ELSE {_TK.format('p_name')} END AS main FROM part",
    "t28_pins": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 >= 2 THEN upper(n_name[1]) || lower(n_name[2:]) END AS located, CASE WHEN n_nationkey % 5 >= 2 THEN CASE n_regionkey WHEN 1 THEN 'certain' WHEN 3 THEN 'disputed' ELSE 'probable' END END AS certainty FROM (SELECT n_nationkey, n_regionkey, n_name FROM nation)",
    "t29_articles": "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'https://en.wikipedia.org/wiki/' || n WHEN 3 THEN 'https://en.wikipedia.org/wiki/' || n || '_land' END AS article FROM (SELECT n_nationkey, upper(n_name[1]) || lower(n_name[2:]) AS n FROM nation)",
    "t31_part_names": "SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN p_name ELSE '' END AS name FROM part",
    "d04_cascade": f"""WITH {_BL}, hd AS (SELECT *, lead(heading) OVER (PARTITION BY doc_id ORDER BY start) AS under FROM bl), h AS (SELECT * FROM hd WHERE heading IS NOT NULL),
      lv AS (SELECT doc_id, CASE WHEN count(*) FILTER (WHERE heading = 1) BETWEEN 1 AND 3 AND count(*) FILTER (WHERE heading = 2) > count(*) FILTER (WHERE heading = 1) OR count(*) FILTER (WHERE heading = 1) = 0 THEN 2 ELSE 1 END AS level FROM h GROUP BY doc_id),
      k AS (SELECT h.*, coalesce(heading < level AND under > heading, false) AS label FROM h JOIN lv USING (doc_id) WHERE heading <= level),
      g AS (SELECT *, coalesce(sum(CAST(NOT label AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM k),
      st AS (SELECT doc_id, 0 AS way, max({sql_trim('text')}) FILTER (WHERE NOT label) AS title, min(start) AS start FROM g GROUP BY doc_id, run HAVING count(*) FILTER (WHERE NOT label) > 0
        UNION ALL SELECT doc_id, 1, t, start FROM (SELECT doc_id, start, {sql_trim('text')} AS t FROM bl) WHERE length(t) <= 60 AND t <> '' AND (regexp_matches(t, '{_LINE}') OR regexp_matches(t, '(?i)^(prologue|epilogue|foreword|afterword|preface)\\b') OR regexp_matches(t, '^[0-9]{{1,4}}[.、]?$'))
        UNION ALL SELECT doc_id, 2, {sql_trim('text')}, start FROM bl WHERE boundary),
      ok AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, way) AS n FROM st) WHERE n >= CASE way WHEN 1 THEN 3 ELSE 2 END QUALIFY way = min(way) OVER (PARTITION BY doc_id)),
      cl AS (SELECT doc_id, way, title, o.start, coalesce(lead(o.start) OVER (PARTITION BY doc_id ORDER BY o.start), n_chars) AS e FROM ok o JOIN documents USING (doc_id))
      SELECT doc_id, ['headings', 'patterns', 'spine'][way + 1] AS method, sha256(title) AS title, start, e AS "end", true AS confident FROM cl WHERE e > start
      UNION ALL SELECT doc_id, ['headings', 'patterns', 'spine'][min(way) + 1], sha256(''), 0, min(start), false FROM ok GROUP BY doc_id HAVING min(start) > 200
      UNION ALL SELECT doc_id, 'none', sha256(''), 0, n_chars, false FROM documents WHERE n_chars > 0 AND doc_id NOT IN (SELECT doc_id FROM ok)""",
    "d09_hints": f"""WITH lines AS ({SQL_PARAGRAPHS}) SELECT doc_id, start + pos AS start, start + pos + length(text) AS "end", CASE WHEN pos % 5 = 0 THEN CAST(1 AS INTEGER) END AS heading, pos % 7 = 0 AS boundary FROM lines WHERE {sql_trim('text')} <> ''""",
    "d10_links": f"""WITH l AS (SELECT * FROM ({SQL_PARAGRAPHS}) WHERE pos < 20), a AS (SELECT doc_id, 'Né ' || (pos % 9) AS anchor, min(start) AS at FROM l WHERE pos % 3 = 0 GROUP BY ALL),
      k AS (SELECT doc_id, start, CASE pos % 5 WHEN 0 THEN 'Né ' || (pos % 10) WHEN 1 THEN 'Né ' || (pos % 9) WHEN 3 THEN 'HTTPS://x.org/a' END AS w, pos % 5 AS k FROM l)
      SELECT k.doc_id, k.start, CASE WHEN k = 3 THEN w ELSE '#' || w END AS href, a.at FROM k LEFT JOIN a ON a.doc_id = k.doc_id AND a.anchor = k.w WHERE k = 3 OR a.at IS NOT NULL""",
    "j11_progress": """WITH d AS (SELECT doc_id, text, length(text) // 3 AS was, repeat('preface ', 9) || substr(text, 41) AS new FROM documents), p AS (SELECT *, substr(text, was + 1, 48) AS probe, CAST(floor(CAST(was AS DOUBLE) * length(new) / length(text) + 0.5) AS BIGINT) AS guess FROM d),
      s AS (SELECT doc_id, guess, probe, new, CASE WHEN length(trim(probe, ' ' || chr(10) || chr(9))) >= 12 AND contains(new, probe) THEN string_split(new, probe) END AS parts FROM p),
      o AS (SELECT doc_id, guess, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(probe))) AS x FROM s WHERE parts IS NOT NULL)
      SELECT s.doc_id, CAST(coalesce(b.x, s.guess) AS BIGINT) AS at FROM s LEFT JOIN (SELECT doc_id, x FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY abs(x - guess), x) = 1) b USING (doc_id)""",
    "j10_anchors": "SELECT doc_id, CAST(108 AS BIGINT) AS start, CAST(148 AS BIGINT) AS \"end\" FROM documents WHERE n_chars >= 200 AND length(text) - length(replace(text, substr(text, 101, 40), '')) = 40",
    "l01_alignment": "SELECT l_orderkey, count(*) FILTER (WHERE (l_linenumber + l_orderkey) % 4 <> 0 AND l_linenumber % 3 <> 0) AS same, count(*) FILTER (WHERE (l_linenumber + l_orderkey) % 4 <> 0 AND l_linenumber % 3 = 0) AS changed, CAST(0 AS BIGINT) AS added, count(*) FILTER (WHERE (l_linenumber + l_orderkey) % 4 = 0) AS kept FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey",
    "l05_near_documents": f"""WITH {_SH}, r AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM sh), u AS (SELECT doc_id AS id, len(s) AS n, unnest(s) AS x FROM r WHERE doc_id = rep),
      b AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id),
      k AS (SELECT a, b FROM b WHERE CAST(c AS DOUBLE) / (na + nb - c) >= 0.8), l AS (SELECT rep, count(*) AS links FROM (SELECT a AS rep FROM k UNION ALL SELECT b FROM k) GROUP BY rep)
      SELECT doc_id, rep, coalesce(links, 0) AS links FROM r LEFT JOIN l USING (rep)""",
    "l05_near_classes": f"""WITH RECURSIVE {_SH}, r AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM sh WHERE s IS NOT NULL), u AS (SELECT doc_id AS id, len(s) AS n, unnest(s) AS x FROM r WHERE doc_id = rep),
      b AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id),
      k AS (SELECT a, b FROM b WHERE CAST(c AS DOUBLE) / (na + nb - c) >= 0.8), e AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
      reach AS (SELECT a AS s, b AS t FROM e UNION SELECT reach.s, e.b FROM reach JOIN e ON reach.t = e.a), m AS (SELECT s AS rep, min(t) AS least FROM reach GROUP BY s)
      SELECT doc_id, rep, least(rep, coalesce(least, rep)) AS class_id FROM r LEFT JOIN m USING (rep)""",
    "e08_merge": """WITH m AS (SELECT s_suppkey - 1 AS keep, s_suppkey AS other FROM supplier WHERE s_suppkey % 10 = 5), s AS (SELECT coalesce(keep, s_suppkey) AS k, keep IS NOT NULL AS off, CASE WHEN s_suppkey % 10 <> 4 THEN s_nationkey END AS nation, s_acctbal FROM supplier LEFT JOIN m ON other = s_suppkey),
      l AS (SELECT coalesce(keep, l_suppkey) AS k, l_suppkey, l_returnflag, l_linestatus, keep IS NOT NULL AS moved FROM lineitem LEFT JOIN m ON other = l_suppkey)
      SELECT b.*, marks, notes, moved, undone FROM (SELECT k AS s_suppkey, coalesce(max(nation) FILTER (WHERE NOT off), min(nation) FILTER (WHERE off)) AS nation, max(s_acctbal) AS s_acctbal, count(*) - 1 AS merged FROM s GROUP BY k) b
      LEFT JOIN (SELECT k, count(DISTINCT (l_returnflag, l_linestatus)) AS marks, count(*) AS notes, count(*) FILTER (WHERE moved) AS moved FROM l GROUP BY k) x ON x.k = b.s_suppkey LEFT JOIN (SELECT l_suppkey, count(*) AS undone FROM l GROUP BY l_suppkey) y ON y.l_suppkey = b.s_suppkey""",
    "r12_entities": "SELECT p_partkey, p_name || ' 中😀&amp; <&#0;&lt;' AS text FROM part",
    "r29_downloads": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://docs.google.com/document/d/a_' || p_partkey || '/export?format=docx' WHEN 1 THEN 'https://raw.githubusercontent.com/me/books/main/a/b%20' || p_partkey || '.md' WHEN 2 THEN 'https://drive.google.com/uc?export=download&id=x' || p_partkey ELSE 'https://x.org/' || p_partkey END AS url,
      CASE p_partkey % 4 WHEN 0 THEN 'a_' || p_partkey || '.docx' WHEN 1 THEN 'b ' || p_partkey || '.md' WHEN 2 THEN 'x' || p_partkey END AS name FROM part""",
    "e18_references": """WITH b AS (SELECT n_nationkey, upper(n_name[1]) || lower(n_name[2:]) AS book, n_nationkey % 7 + 3 AS chapters, lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS s FROM nation),
      u AS (SELECT p FROM (SELECT substr(s, 1, 3) AS p FROM b) GROUP BY p HAVING count(*) = 1)
      SELECT c_custkey AS id, book, c_custkey % 11 AS chapter FROM customer JOIN b ON c_nationkey = n_nationkey WHERE c_custkey % 6 <= 3 AND (c_custkey % 6 <> 3 OR substr(s, 1, 3) IN (SELECT p FROM u)) AND c_custkey % 11 BETWEEN 1 AND chapters""",
    "c14_clauses": "SELECT p_brand, string_agg(p_name, ' · ' ORDER BY i) AS clauses FROM (SELECT p_brand, p_name, min(p_partkey) AS i FROM part WHERE p_size <= 3 GROUP BY ALL) GROUP BY p_brand",
}
