"""Queries of rewrites: documents whose chapters of five lines are worded anew by turns, with chapters added between."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.text import WS
from foliant.operators import graph, spans, structure, versions
from foliant.plans.common import SQL_PARAGRAPHS, table


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text").where("text IS NOT NULL")


def _chapters(docs, size=5):
    return structure.chapter_bodies(docs, size).select("doc_id", "idx", "start", F.col("body"), F.concat(F.lit("Part "), F.col("idx").cast("string")).alias("title"))


def _slots(chapters):
    """Each third chapter has a new opening and other small words; after each third one stands a new chapter."""
    kind = F.col("idx") % 3
    anew = F.concat(F.lit("A new opening.\n"), F.regexp_replace(F.regexp_replace("body", " the ", " that "), " de ", " du "))
    own = chapters.select("doc_id", (F.col("idx") * 2).alias("pos"), "idx", F.when(kind == 1, anew).alias("text"), F.concat(F.lit("New "), F.col("title")).alias("title"))
    added = chapters.where(kind == 2).select("doc_id", (F.col("idx") * 2 + 1).alias("pos"), F.lit(None).cast("long").alias("idx"), F.concat(F.lit("Added after "), F.col("title"), F.lit(" \n")).alias("text"), F.lit("Added").alias("title"))
    return own.union(added)


def _made(spark, sf):
    docs = _docs(spark, sf)
    chapters = graph.written(_chapters(docs), "chapters")  # read four times
    return graph.written(versions.rewritten(docs, chapters.select("doc_id", "idx", "start"), _slots(chapters)), "rewritten")


def _lengths(made):
    return made.select("doc_id", "old_len", "new_len")


def _units(spark, sf):
    s = spans.sentences(_docs(spark, sf))
    return s.select("doc_id", F.col("start").cast("long").alias("unit"), F.lit("fr").alias("target"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("text").alias("source"), F.lit(False).alias("stale"))


def j13_rewritten(spark, sf):
    return _made(spark, sf).select("doc_id", "old_len", "new_len", F.sha2("text", 256).alias("sha"))


def j13_chapters(spark, sf):
    return versions.new_chapters(_made(spark, sf))


def j13_units(spark, sf):
    return versions.moved_units(_units(spark, sf), _made(spark, sf)).select("doc_id", "unit", "start", "end", "stale")


def j13_moved(spark, sf):
    """Scenes, reading places and chapter numbers of words after the rewrite."""
    docs, made = _docs(spark, sf), _made(spark, sf)
    segs, lengths = versions.segments(made), _lengths(made)
    scenes = _chapters(docs, 4).select("doc_id", F.lit("scene").alias("what"), "idx", "start", (F.col("start") + F.length("body")).cast("long").alias("end"))
    progress = docs.select("doc_id", F.lit("progress").alias("what"), F.lit(0).cast("long").alias("idx"), F.floor(F.length("text") / 2).alias("start"), (F.length("text") + 9).cast("long").alias("end"))
    return versions.moved(scenes.union(progress), ["start", "end"], segs, lengths).drop("was")


def j13_renumbered(spark, sf):
    """How many words each chapter has, filed under its new number."""
    counts = _chapters(_docs(spark, sf)).select("doc_id", "idx", F.size(F.split("body", f"{WS}+")).cast("long").alias("n"))
    return versions.renumbered(counts, "idx", versions.new_chapters(_made(spark, sf))).drop("was")


def j13_undone(spark, sf):
    """Units that went through a rewrite and back; they are named by where they began."""
    return versions.undone(versions.moved_units(_units(spark, sf), _made(spark, sf))).select("doc_id", "unit", "start", "end", "stale")


def j13_wordings(spark, sf):
    docs = _docs(spark, sf)
    chapters = _chapters(docs)
    return versions.kept_wordings(docs, chapters.select("doc_id", "idx", "start", "title"), _slots(chapters)).select("doc_id", "idx", "hash", "title")


def j05_rehomed(spark, sf):
    """Wordings of chapters of five lines after these are cut anew, by seven."""
    docs = _docs(spark, sf)
    five, seven = _chapters(docs), _chapters(docs, 7)
    after = seven.select("doc_id", "idx", "start", (F.col("start") + F.length("body") + 1).cast("long").alias("end"))
    kept = five.select("doc_id", "idx", F.sha2("body", 256).alias("hash"))
    return versions.rehomed(kept, five.select("doc_id", "idx", "start"), after).select("doc_id", "idx", "hash", F.col("was.idx").alias("was"))


QUERIES = {f.__name__: f for f in (j13_rewritten, j13_chapters, j13_units, j13_moved, j13_renumbered, j13_undone, j13_wordings, j05_rehomed)}


def _five(size: int = 5) -> str:
    return f"SELECT doc_id, pos // {size} AS idx, min(start) AS start, string_agg(text, chr(10) ORDER BY pos) AS body FROM lines GROUP BY ALL"


_W = f"WITH lines AS (SELECT * FROM ({SQL_PARAGRAPHS}) WHERE text IS NOT NULL), five AS ({_five()})"
_MADE = rf"""{_W}, docs AS (SELECT doc_id, text, length(text) AS old_len FROM documents WHERE text IS NOT NULL),
old AS (SELECT doc_id, idx, start AS os, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS oe, body FROM five),
slots AS (SELECT doc_id, idx * 2 AS pos, idx, os, coalesce(oe, old_len) AS oe, CASE WHEN idx % 3 = 1 THEN 'A new opening.' || chr(10) || replace(replace(body, ' the ', ' that '), ' de ', ' du ') ELSE body END AS body, idx % 3 <> 1 AS linear, 'New Part ' || idx AS title FROM old JOIN docs USING (doc_id)
  UNION ALL SELECT doc_id, idx * 2 + 1, NULL, NULL, NULL, 'Added after Part ' || idx, false, 'Added' FROM old WHERE idx % 3 = 2),
bodies AS (SELECT * EXCLUDE (body), regexp_replace(body, '{WS}+$', '') AS body FROM slots),
part AS (SELECT *, CASE WHEN body = '' THEN '' ELSE body || chr(10) || chr(10) END AS part FROM bodies),
placed AS (SELECT *, CAST(coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ns, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS n FROM part),
seg AS (SELECT doc_id, os, oe, ns, ns + length(body) AS ne, linear, body FROM placed WHERE os IS NOT NULL),
made AS (SELECT doc_id, CASE WHEN last(body ORDER BY pos) = '' THEN string_agg(part, '' ORDER BY pos) ELSE left(string_agg(part, '' ORDER BY pos), length(string_agg(part, '' ORDER BY pos)) - 2) END AS text FROM placed GROUP BY doc_id),
lens AS (SELECT doc_id, old_len, length(made.text) AS new_len FROM docs JOIN made USING (doc_id))"""


def _at(rows: str, cols: list[str], keep: str) -> str:
    """Each column of rows where the segments lead it; offsets beyond the text go on behind it."""
    joins = " ".join(f"LEFT JOIN seg s_{c} ON s_{c}.doc_id = r.doc_id AND r.{c} >= s_{c}.os AND r.{c} < s_{c}.oe" for c in cols)
    value = lambda c: f"CASE WHEN s_{c}.os IS NULL THEN new_len + greatest(0, r.{c} - old_len) WHEN s_{c}.linear THEN least(s_{c}.ns + r.{c} - s_{c}.os, s_{c}.ne) ELSE s_{c}.ns + ((r.{c} - s_{c}.os) * (s_{c}.ne - s_{c}.ns)) // greatest(1, s_{c}.oe - s_{c}.os) END"
    return f"SELECT {keep}, {', '.join(f'CAST({value(c)} AS BIGINT) AS {c}' for c in cols)} FROM ({rows}) r JOIN lens ON lens.doc_id = r.doc_id {joins}"


def _sql() -> dict[str, str]:
    from foliant.plans.structure import _sentences_sql

    u = f"""SELECT doc_id, start AS unit, start, "end" AS stop, substr(text, start + 1, "end" - start) AS source FROM (WITH {_sentences_sql()} SELECT * FROM sents) JOIN documents USING (doc_id)"""
    return {
        "j13_rewritten": f"{_MADE} SELECT doc_id, old_len, new_len, sha256(text) AS sha FROM lens JOIN made USING (doc_id)",
        "j13_chapters": f'{_MADE} SELECT doc_id, n AS idx, ns AS start, coalesce(lead(ns) OVER (PARTITION BY doc_id ORDER BY pos), new_len) AS "end", idx AS old_idx, title FROM placed JOIN lens USING (doc_id)',
        "j13_moved": f"""{_MADE}, four AS ({_five(4)}), r AS (SELECT doc_id, 'scene' AS what, idx, start, start + length(body) AS stop FROM four UNION ALL SELECT doc_id, 'progress', 0, old_len // 2, old_len + 9 FROM docs)
          SELECT doc_id, what, idx, start, stop AS "end" FROM ({_at('SELECT * FROM r', ['start', 'stop'], 'r.doc_id, r.what, r.idx')})""",
        "j13_renumbered": f"{_MADE} SELECT doc_id, n AS idx, CAST(len(string_split_regex(f.body, '{WS}+')) AS BIGINT) AS n FROM (SELECT doc_id, idx AS was, n FROM placed WHERE idx IS NOT NULL) p JOIN five f ON f.doc_id = p.doc_id AND f.idx = p.was".replace("SELECT doc_id, n AS idx", "SELECT p.doc_id, p.n AS idx"),
        "j13_wordings": rf"""{_MADE}, both_ AS (SELECT doc_id, idx, 0 AS n, 'Part ' || idx AS title, regexp_replace(body, '{WS}+$', '') AS body FROM five WHERE idx % 3 = 1
          UNION ALL SELECT doc_id, idx, 1, title, body FROM slots WHERE idx IS NOT NULL AND NOT linear), h AS (SELECT *, sha256(trim(regexp_replace(body, '{WS}+', ' ', 'g'))) AS hash FROM both_)
          SELECT doc_id, idx, hash, min_by(title, n) AS title FROM h GROUP BY doc_id, idx, hash""",
        "j05_rehomed": f"""{_W}, seven AS ({_five(7)}) SELECT f.doc_id, CASE WHEN row_number() OVER (PARTITION BY f.doc_id, s.idx, f.body ORDER BY f.idx) = 1 THEN s.idx ELSE f.idx END AS idx, sha256(f.body) AS hash, f.idx AS was
          FROM five f JOIN seven s ON s.doc_id = f.doc_id AND f.start >= s.start AND f.start < s.start + length(s.body) + 1""",
        "j13_undone": f'{_W}, u AS ({u}) SELECT doc_id, unit, start, stop AS "end", false AS stale FROM u',
        "j13_units": f"""{_MADE}, u AS ({u}), m AS ({_at('SELECT * FROM u', ['start', 'stop'], 'r.doc_id, r.unit, r.source, r.start AS was, r.stop - r.start AS size')}),
          f AS (SELECT m.*, s.ns, s.body FROM m JOIN seg s ON s.doc_id = m.doc_id AND m.was >= s.os AND m.was < s.oe AND NOT s.linear),
          p AS (SELECT *, string_split(body, source) AS ps FROM f),
          o AS (SELECT doc_id, unit, g, start, ns, (SELECT sum(length(x)) FROM unnest(ps[1:g]) t(x)) + (g - 1) * length(source) AS spot FROM (SELECT *, unnest(range(1, len(ps))) AS g FROM p)),
          b AS (SELECT doc_id, unit, arg_min(spot, (abs(spot - (start - ns)), spot)) AS spot FROM o GROUP BY doc_id, unit),
          w AS (SELECT p.doc_id, p.unit, p.was, b.spot IS NULL AS stale, CAST(coalesce(p.ns + b.spot, p.start) AS BIGINT) AS s, CASE WHEN b.spot IS NULL THEN greatest(1, p.size) ELSE length(p.source) END AS n FROM p LEFT JOIN b USING (doc_id, unit)),
          q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY s, was, unit) AS k FROM w),
          z AS (SELECT *, k + max(s - k) OVER (PARTITION BY doc_id, n ORDER BY s, was, unit ROWS UNBOUNDED PRECEDING) AS spot FROM q)
          SELECT doc_id, unit, CAST(spot AS BIGINT) AS start, CAST(spot + n AS BIGINT) AS "end", stale FROM z
          UNION ALL SELECT doc_id, unit, start, stop, false FROM m WHERE (doc_id, unit) NOT IN (SELECT (doc_id, unit) FROM f)""",
    }


ORACLE_SQL = _sql()
