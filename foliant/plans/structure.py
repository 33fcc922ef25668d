"""Queries of span and structure operators. A line is a paragraph; five paragraphs are a chapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.text import trim
from foliant.operators import spans, structure
from foliant.plans.common import SQL_PARAGRAPHS, sql_trim, table


def _lines(spark, sf):
    return spans.paragraphs(table(spark, sf, "documents"))


def _chapters(spark, sf):
    return structure.grouped_chapters(_lines(spark, sf))


def d01_normalize(spark, sf):
    return spans.normalized(table(spark, sf, "documents"), F.split("text", "\n")).select("doc_id", "pos", "start", "end", F.sha2("text", 256).alias("sha"))


def r05_plain_blocks(spark, sf):
    docs = table(spark, sf, "documents")
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n+")).alias("pos", "t")).select("doc_id", F.col("pos").cast("long").alias("pos"), trim(F.col("t")).alias("t"))
    return parts.where("t <> ''").select("doc_id", "pos", F.sha2("t", 256).alias("sha"))


def d03_chapters(spark, sf):
    """Chapters by patterns; documents without headings are whole, the passages' numbers may be headings."""
    return structure.chapters_from_patterns(_lines(spark, sf), table(spark, sf, "documents"))


def d05_close(spark, sf):
    """Chapters that start at every seventh line from the fourth on, with the untitled lead."""
    lines = _lines(spark, sf)
    starts = lines.where("pos % 7 = 3").select("doc_id", F.concat(F.lit("line "), F.col("pos").cast("string")).alias("title"), "start")
    return spans.closed(starts, table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("length")))


def d02_heading_level(spark, sf):
    heads = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h([1-6])"), 1)).alias("h"))
    return structure.heading_level(heads.select("page_id", F.col("h").cast("int").alias("level")), "page_id")


def d07_scenes(spark, sf):
    """Scenes of conversations in which a system turn, as an ornament, parts scenes."""
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"), F.when(F.col("turn") % 3 == 2, "* * *").otherwise(F.col("text")).alias("text"))
    return structure.scenes(turns, id_col="conv_id")


def d08_breaks(spark, sf):
    docs = table(spark, sf, "documents")
    cuts = F.array(F.lit(0).cast("long"), F.col("n_chars") / 2, F.col("n_chars") / 3, F.col("n_chars") / 2, F.col("n_chars"))
    found = structure.scenes_from_breaks(F.lit(0).cast("long"), F.col("n_chars"), F.transform(cuts, lambda x: x.cast("long")))
    return docs.select("doc_id", F.posexplode(found).alias("pos", "s")).select("doc_id", F.col("pos").cast("long").alias("pos"), "s.start", "s.end")


def d11_parts(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return structure.runs(rows, "event_type", "event_id", "user_id")


def d12_pages(spark, sf):
    marks = _lines(spark, sf).where("pos % 4 = 0").select("doc_id", (F.length("text") % 50).cast("long").alias("number"), "start")
    return structure.pages_of(marks, table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("length")))


def d13_split(spark, sf):
    """Each chapter cut in its middle."""
    chapters = _chapters(spark, sf)
    cuts = chapters.select("doc_id", F.floor((F.col("start") + F.col("end")) / 2).alias("at"))
    return structure.split_at(chapters, cuts)


def d13_merge(spark, sf):
    """Each second chapter takes in the next."""
    return structure.merged_with_next(_chapters(spark, sf), F.col("idx") % 2 == 0)


def d13_edited(spark, sf):
    """Chapters of which some are renamed and some lose their break, to the one above or below."""
    chapters = _chapters(spark, sf).select("doc_id", "idx", "start", "end", F.concat(F.lit("Chapter "), F.col("idx").cast("string")).alias("title"), F.lit(False).alias("by_hand"))
    k = F.col("idx") % 7
    action = F.when(k == 0, "above").when(k == 2, "rename").when((k == 4) | (k == 5), "below")
    edits = chapters.select("doc_id", "idx", action.alias("action"), F.concat(F.lit(" New "), F.col("idx").cast("string")).alias("title")).where("action IS NOT NULL")
    return structure.with_edits(chapters, edits)


def d13_moved(spark, sf):
    """Chapters of which each third and fourth of five go down by one place."""
    chapters = _chapters(spark, sf).select("doc_id", "idx", "start")
    return structure.with_moves(chapters, chapters.where("idx % 5 IN (3, 4)").select("doc_id", "idx", F.lit(1).alias("by")))


def d15_kept_titles(spark, sf):
    chapters = _chapters(spark, sf).withColumn("title", F.concat(F.lit("Chapter "), F.col("idx").cast("string")))
    given = _lines(spark, sf).where("pos % 10 = 0").select("doc_id", "start", F.substring("text", 1, 20).alias("title"))
    return structure.with_kept_titles(chapters, given).select("doc_id", "idx", "title")


def d16_candidates(spark, sf):
    """Lines of at most 60 characters as candidates of headings, 1,200 a document, in batches of 120."""
    lines = _lines(spark, sf).withColumn("t", trim(F.col("text"))).where("t <> '' AND length(t) <= 60")
    rows = lines.withColumn("n", F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY pos)")).where("n <= 1200")
    return rows.groupBy("doc_id", F.floor((F.col("n") - 1) / 120).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))


def j01_sentence_chapters(spark, sf):
    """The chapter of every sentence's start."""
    points = spans.sentences(table(spark, sf, "documents")).select("doc_id", F.col("start").alias("at"))
    return spans.points_in(points, _chapters(spark, sf), "at").select("doc_id", "at", "idx")


def j06_overlaps(spark, sf):
    """Sentences that each paragraph pair's span touches: first, last, number."""
    pairs = _lines(spark, sf).groupBy("doc_id", F.floor(F.col("pos") / 2).alias("pair")).agg(F.min("start").alias("p_start"), F.max("end").alias("p_end"))
    own = spans.sentences(table(spark, sf, "documents")).select("doc_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    hit = spans.overlapping(pairs, own, "p_start", "p_end", "s_start", "s_end")
    return hit.groupBy("doc_id", "pair").agg(F.min("s_start").alias("first"), F.max("s_start").alias("last"), F.count(F.lit(1)).alias("n"))


def _marks(spark, sf):
    """Marks of three lengths over each document."""
    lines = _lines(spark, sf).where("length(text) > 30")
    spot = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("start").alias("a"), F.col("end").alias("b")), F.struct(F.lit(1).alias("k"), (F.col("start") + 10).alias("a"), (F.col("start") + 25).alias("b")), F.struct(F.lit(2).alias("k"), (F.col("start") + 20).alias("a"), (F.col("end") + 40).alias("b"))))
    rows = lines.select("doc_id", "pos", spot.alias("s"))
    return rows.select("doc_id", (F.col("pos") * 3 + F.col("s.k")).cast("long").alias("mark_id"), F.col("s.a").alias("m_start"), F.col("s.b").alias("m_end"))


def j09_pieces(spark, sf):
    own = _lines(spark, sf).where("length(text) > 0").select("doc_id", F.col("pos").cast("long").alias("span_id"), "start", "end")
    return spans.pieces(own, _marks(spark, sf)).withColumnRenamed("mark_id", "mark")


def j08_mark_at(spark, sf):
    points = _lines(spark, sf).select("doc_id", (F.col("start") + 12).alias("at")).distinct()
    return spans.shortest_over(points, _marks(spark, sf), "at", F.col("mark_id"))


def _segments(spark, sf):
    """A revision that inserts five characters after every third line and squeezes each tenth to half its length."""
    lines = _lines(spark, sf).select("doc_id", "pos", F.col("start").alias("os"), (F.col("end") + 1).alias("oe"))
    size = F.when(F.col("pos") % 10 == 9, F.floor((F.col("oe") - F.col("os")) / 2)).otherwise(F.col("oe") - F.col("os") + F.when(F.col("pos") % 3 == 2, 5).otherwise(0))
    sized = lines.withColumn("size", size)
    ns = F.coalesce(F.expr("sum(size) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    return sized.select("doc_id", "os", "oe", ns.alias("ns"), (ns + F.col("size")).alias("ne"), (F.col("pos") % 10 != 9).alias("linear"))


def j12_segments(spark, sf):
    return spans.merged_segments(_segments(spark, sf))


def j12_remap(spark, sf):
    segments = _segments(spark, sf)
    lengths = segments.groupBy("doc_id").agg(F.max("oe").alias("old_len"), F.max("ne").alias("new_len"))
    points = spans.sentences(table(spark, sf, "documents")).select("doc_id", F.explode(F.array(F.col("start"), F.col("end") + 7)).alias("at")).distinct()
    return spans.remapped(points, spans.merged_segments(segments), lengths)


def d20_outline(spark, sf):
    """How many lines of each chapter could be headings, by their first offset."""
    heads = _lines(spark, sf).where("length(text) BETWEEN 1 AND 40").select("doc_id", F.col("start").alias("at"))
    hit = spans.points_in(heads, _chapters(spark, sf), "at")
    return hit.groupBy("doc_id", "idx").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


QUERIES = {f.__name__: f for f in (d01_normalize, r05_plain_blocks, d02_heading_level, d03_chapters, d05_close, d07_scenes, d08_breaks, d11_parts, d12_pages, d13_split, d13_merge, d13_edited, d13_moved, d15_kept_titles, d16_candidates, d20_outline, j01_sentence_chapters, j06_overlaps, j08_mark_at, j09_pieces, j12_segments, j12_remap)}

_P = f"lines AS ({SQL_PARAGRAPHS})"
_C = 'chapters AS (SELECT doc_id, pos // 5 AS idx, min(start) AS start, max(start + length(text)) AS "end" FROM lines GROUP BY ALL)'


def _sentences_sql() -> str:
    from foliant.plans.text import ORACLE_SQL as T

    return T["t06_sentences"].strip().removeprefix("WITH ").replace("SELECT doc_id, CAST(off", "sents AS (SELECT doc_id, CAST(off").replace(', sha256(t) AS sha FROM q', " FROM q").replace("FROM p)\n", "FROM p),\n") + ")"


_S = _sentences_sql()
_MARKS = """marks AS (SELECT doc_id, pos * 3 + k AS mark_id, CASE k WHEN 0 THEN start WHEN 1 THEN start + 10 ELSE start + 20 END AS m_start,
  CASE k WHEN 0 THEN start + length(text) WHEN 1 THEN start + 25 ELSE start + length(text) + 40 END AS m_end FROM lines, (SELECT unnest([0, 1, 2]) AS k) WHERE length(text) > 30)"""
_SEGS = """sized AS (SELECT doc_id, pos, start AS os, start + length(text) + 1 AS oe, CASE WHEN pos % 10 = 9 THEN (length(text) + 1) // 2 ELSE length(text) + 1 + CASE WHEN pos % 3 = 2 THEN 5 ELSE 0 END END AS size FROM lines),
segs0 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ns FROM sized),
segs AS (SELECT doc_id, pos, os, oe, ns, ns + size AS ne, pos % 10 <> 9 AS linear FROM segs0)"""
_HEAD = r"'^[0-9]{1,4}[.、]?$'"
_EN1 = "'" + structure.PATTERNS["en"][0] + "'"
_EN2 = "'" + structure.PATTERNS["en"][1] + "'"
ORACLE_SQL = {
    "d01_normalize": f"""WITH {_P}, k AS (SELECT doc_id, pos, trim(regexp_replace(replace(text, chr(160), ' '), '[ \\t]+', ' ', 'g')) AS t FROM lines),
      s AS (SELECT doc_id, pos, t, CAST(coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM k WHERE t <> '')
      SELECT doc_id, CAST(pos AS INTEGER) AS pos, start, start + length(t) AS "end", sha256(t) AS sha FROM s""",
    "r05_plain_blocks": f"""SELECT doc_id, pos, sha256(t) AS sha FROM (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, {sql_trim('unnest(ps)')} AS t
      FROM (SELECT doc_id, string_split_regex(text, '\\n+') AS ps FROM documents)) WHERE t <> ''""",
    "d02_heading_level": """WITH h AS (SELECT page_id, CAST(unnest(regexp_extract_all(html, '<h([1-6])', 1)) AS INTEGER) AS level FROM pages),
      c AS (SELECT page_id, level, count(*) AS n FROM h GROUP BY page_id, level), n AS (SELECT *, lead(n) OVER (PARTITION BY page_id ORDER BY level) AS nx FROM c)
      SELECT page_id, min(level) AS level FROM n WHERE nx IS NULL OR n > 3 OR nx <= n GROUP BY page_id""",
    "d03_chapters": f"""WITH {_P}, t AS (SELECT l.doc_id, l.start, d.lang, {sql_trim('l.text')} AS title FROM lines l JOIN documents d USING (doc_id)),
      m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS hits FROM t WHERE title <> '' AND length(title) <= 60 AND (regexp_matches(title, {_HEAD}) OR (lang = 'en' AND (regexp_matches(title, {_EN1}) OR regexp_matches(title, {_EN2}))))),
      s AS (SELECT doc_id, title, start FROM m WHERE hits >= 3),
      c AS (SELECT doc_id, title, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n_chars) AS "end", true AS confident FROM s JOIN documents USING (doc_id))
      SELECT * FROM c WHERE "end" > start UNION ALL SELECT doc_id, '', 0, min(start), false FROM s GROUP BY doc_id HAVING min(start) > 200
      UNION ALL SELECT doc_id, '', 0, n_chars, false FROM documents WHERE n_chars > 0 AND doc_id NOT IN (SELECT doc_id FROM s)""",
    "d05_close": f"""WITH {_P}, s AS (SELECT doc_id, 'line ' || pos AS title, start FROM lines WHERE pos % 7 = 3),
      c AS (SELECT doc_id, title, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n_chars) AS "end", true AS confident FROM s JOIN documents USING (doc_id))
      SELECT * FROM c WHERE "end" > start UNION ALL SELECT doc_id, '', 0, min(start), false FROM s GROUP BY doc_id HAVING min(start) > 200""",
    "d07_scenes": """WITH t AS (SELECT conv_id, turn, turn % 3 = 2 AS sep FROM conversations),
      r AS (SELECT *, sum(CAST(sep AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS run, max(CAST(sep AS INT)) OVER (PARTITION BY conv_id) AS has FROM t)
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS scene, min(turn) AS start, max(turn) + 1 AS "end" FROM r WHERE has = 1 AND NOT sep GROUP BY conv_id, run""",
    "d08_breaks": """WITH b AS (SELECT doc_id, n_chars, unnest(list_distinct([n_chars // 2, n_chars // 3])) AS x FROM documents), i AS (SELECT doc_id, n_chars, x FROM b WHERE x > 0 AND x < n_chars UNION SELECT doc_id, n_chars, 0 FROM b WHERE x > 0 AND x < n_chars)
      SELECT doc_id, row_number() OVER w - 1 AS pos, x AS start, coalesce(lead(x) OVER w, n_chars) AS "end" FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY x)""",
    "d11_parts": """WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m),
      g AS (SELECT user_id, run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n, count(*) OVER (PARTITION BY user_id) AS k FROM r GROUP BY user_id, run, event_type)
      SELECT user_id, event_type, first, last, n FROM g WHERE k >= 2""",
    "d12_pages": f"""WITH {_P}, m AS (SELECT doc_id, length(text) % 50 AS number, start FROM lines WHERE pos % 4 = 0), k AS (SELECT *, max(number) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m WHERE number > 0)
      SELECT doc_id, number, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n_chars) AS "end" FROM k JOIN documents USING (doc_id) WHERE b IS NULL OR number > b""",
    "d13_split": f"""WITH {_P}, {_C}, s AS (SELECT doc_id, start FROM chapters UNION SELECT doc_id, (start + "end") // 2 FROM chapters WHERE (start + "end") // 2 > start), e AS (SELECT doc_id, max("end") AS last FROM chapters GROUP BY doc_id)
      SELECT doc_id, row_number() OVER w - 1 AS idx, start, coalesce(lead(start) OVER w, last) AS "end" FROM s JOIN e USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY start)""",
    "d13_edited": f"""WITH {_P}, {_C}, n AS (SELECT *, max(idx) OVER (PARTITION BY doc_id) AS last, CASE WHEN idx % 7 = 0 THEN CASE WHEN idx = 0 AND idx < max(idx) OVER (PARTITION BY doc_id) THEN 'below' ELSE 'above' END
        WHEN idx % 7 IN (4, 5) THEN CASE WHEN idx = max(idx) OVER (PARTITION BY doc_id) THEN 'above' ELSE 'below' END END AS goes FROM chapters),
      b AS (SELECT *, idx > 0 AND (coalesce(goes, '') = 'above' OR coalesce(lag(goes) OVER (PARTITION BY doc_id ORDER BY idx), '') = 'below') AS joined FROM n),
      r AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM b)
      SELECT doc_id, CAST(run - 1 AS BIGINT) AS idx, min(start) AS start, max("end") AS "end", arg_min(CASE WHEN idx % 7 = 2 THEN 'New ' ELSE 'Chapter ' END || idx, (goes IS NOT NULL, idx)) AS title, bool_or(idx % 7 IN (0, 2, 4, 5)) AS by_hand FROM r GROUP BY doc_id, run""",
    "d13_moved": f"""WITH {_P}, {_C}, l AS (SELECT doc_id, max(idx) AS last FROM chapters GROUP BY doc_id) SELECT doc_id, CASE WHEN idx % 5 = 3 AND idx < last THEN idx + 1 WHEN idx % 5 = 4 THEN idx - 1 ELSE idx END AS idx, start FROM chapters JOIN l USING (doc_id)""",
    "d13_merge": f"""WITH {_P}, {_C} SELECT doc_id, idx // 2 AS idx, min(start) AS start, max("end") AS "end" FROM chapters GROUP BY doc_id, idx // 2""",
    "d15_kept_titles": f"""WITH {_P}, {_C} SELECT c.doc_id, idx, coalesce(substr(l.text, 1, 20), 'Chapter ' || idx) AS title FROM chapters c LEFT JOIN lines l ON l.doc_id = c.doc_id AND l.start = c.start AND l.pos % 10 = 0""",
    "d16_candidates": f"""WITH {_P}, k AS (SELECT doc_id, start, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM lines WHERE length({sql_trim('text')}) BETWEEN 1 AND 60)
      SELECT doc_id, (n - 1) // 120 AS batch, count(*) AS n, min(start) AS first FROM k WHERE n <= 1200 GROUP BY doc_id, (n - 1) // 120""",
    "d20_outline": f"""WITH {_P}, {_C} SELECT c.doc_id, idx, count(*) AS n, min(l.start) AS first FROM lines l JOIN chapters c ON c.doc_id = l.doc_id AND l.start >= c.start AND l.start < c."end" WHERE length(l.text) BETWEEN 1 AND 40 GROUP BY ALL""",
    "j01_sentence_chapters": f"""WITH {_P}, {_C}, {_S} SELECT s.doc_id, s.start AS at, idx FROM sents s JOIN chapters c ON c.doc_id = s.doc_id AND s.start >= c.start AND s.start < c."end\"""",
    "j06_overlaps": f"""WITH {_P}, {_S}, pr AS (SELECT doc_id, pos // 2 AS pair, min(start) AS a, max(start + length(text)) AS b FROM lines GROUP BY ALL)
      SELECT pr.doc_id, pair, min(s.start) AS first, max(s.start) AS last, count(*) AS n FROM pr JOIN sents s ON s.doc_id = pr.doc_id AND pr.b > s.start AND pr.a < s."end" GROUP BY ALL""",
    "j08_mark_at": f"""WITH {_P}, {_MARKS}, pt AS (SELECT DISTINCT doc_id, start + 12 AS at FROM lines), h AS (SELECT pt.doc_id, pt.at, mark_id, row_number() OVER (PARTITION BY pt.doc_id, pt."at" ORDER BY m_end - m_start, mark_id) AS r FROM pt JOIN marks m ON m.doc_id = pt.doc_id AND m_start <= pt.at AND pt.at < m_end)
      SELECT doc_id, "at", mark_id AS mark FROM h WHERE r = 1""",
    "j09_pieces": f"""WITH {_P}, {_MARKS}, sp AS (SELECT doc_id, pos AS span_id, start, start + length(text) AS "end" FROM lines WHERE length(text) > 0),
      tch AS (SELECT s.doc_id, s.span_id, s.start, s."end", mark_id, m_start, m_end FROM sp s JOIN marks m ON m.doc_id = s.doc_id AND m_end > s.start AND m_start < s."end"),
      cut AS (SELECT doc_id, span_id, start AS at FROM sp UNION SELECT doc_id, span_id, "end" FROM sp UNION SELECT doc_id, span_id, m_start FROM tch WHERE m_start > start UNION SELECT doc_id, span_id, m_end FROM tch WHERE m_end < "end"),
      pc AS (SELECT doc_id, span_id, "at" AS start, lead("at") OVER (PARTITION BY doc_id, span_id ORDER BY "at") AS "end" FROM cut),
      rk AS (SELECT p.doc_id, p.span_id, p.start, p."end", t.mark_id, row_number() OVER (PARTITION BY p.doc_id, p.span_id, p.start ORDER BY t.m_end - t.m_start NULLS LAST, t.mark_id) AS r
        FROM pc p LEFT JOIN tch t ON t.doc_id = p.doc_id AND t.span_id = p.span_id AND t.m_start <= p.start AND p.start < t.m_end WHERE p."end" IS NOT NULL)
      SELECT doc_id, span_id, start, "end", mark_id AS mark FROM rk WHERE r = 1""",
    "j12_segments": f"""WITH {_P}, {_SEGS}, j AS (SELECT *, CASE WHEN linear AND lag(linear) OVER w AND lag(oe) OVER w = os AND lag(ns - os) OVER w = ns - os THEN 0 ELSE 1 END AS new FROM segs WHERE NOT (linear AND oe <= os) WINDOW w AS (PARTITION BY doc_id ORDER BY os)),
      r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY os) AS run FROM j)
      SELECT doc_id, min(os) AS os, max(oe) AS oe, CAST(min(ns) AS BIGINT) AS ns, CAST(max(ne) AS BIGINT) AS ne, bool_and(linear) AS linear FROM r GROUP BY doc_id, run""",
    "j12_remap": f"""WITH {_P}, {_SEGS}, {_S}, ln AS (SELECT doc_id, max(oe) AS ol, max(ne) AS nl FROM segs GROUP BY doc_id), pt AS (SELECT doc_id, start AS at FROM sents UNION SELECT doc_id, "end" + 7 FROM sents)
      SELECT pt.doc_id, pt.at, CAST(CASE WHEN s.os IS NULL THEN nl + greatest(0, pt.at - ol) WHEN linear THEN least(ns + pt.at - os, ne) ELSE ns + ((pt.at - os) * (ne - ns)) // greatest(1, oe - os) END AS BIGINT) AS new_at
      FROM pt JOIN ln USING (doc_id) LEFT JOIN segs s ON s.doc_id = pt.doc_id AND pt.at >= os AND pt.at < oe""",
}
