"""Versions of chapters: another copy's wordings folded into a text, and all that points into it moved along by one plan.

A rewrite is made in the row of its text: slots say which chapter stays, which is worded anew and what is added, and the
new text, the places of its chapters and the segments that lead from old offsets to new ones come out together. Tables of
offsets are then moved by equi-joins with these segments, tables of chapter numbers by a join with the chapters' new
ones; moved rows keep what they were in `was`, by which a rewrite is undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import BLANKS, WS, canonical_hash, slice_of
from foliant.operators import align, spans
from foliant.operators.spans import once, starts_of

GAP = "\n\n"


def _cut(text: Column, start: Column, end: Column) -> Column:
    return slice_of(text, start.cast("int"), end.cast("int"))




def rewritten(docs: DataFrame, chapters: DataFrame, slots: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, old_len, text, new_len, slots) of the documents that have slots; slots are (pos, idx, os, oe, ns, ne, linear, title).

    chapters has (id, idx, start), one for each idx; a chapter runs to the next start. slots has (id, pos, idx, text,
    title): in order of pos, the chapters of the new text. One without a text is the chapter idx as it is; one with both
    is that chapter worded anew; one without idx is added. Bodies lose the white space at their ends and stand apart by an
    empty line; what is before the first chapter stays. A slot that names no chapter and has no text is left out.
    """
    w = Window.partitionBy(id_col).orderBy("start")
    lengths = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("__t"))
    old = chapters.select(id_col, "idx", F.col("start").cast("long").alias("os"), F.lead("start").over(w).cast("long").alias("oe"))
    own = slots.select(id_col, "pos", "idx", F.col("text").alias("wording"), "title").join(old, [id_col, "idx"], "left").where("os IS NOT NULL OR (idx IS NULL AND wording IS NOT NULL)")
    one = F.struct("pos", "idx", "os", "oe", "wording", "title")
    grouped = own.groupBy(id_col).agg(F.array_sort(F.collect_list(one)).alias("s"))
    grouped = grouped.join(old.groupBy(id_col).agg(F.min("os").alias("first")), id_col, "left")
    rows = lengths.join(grouped, id_col)
    text, size = F.col("__t"), F.length("__t").cast("long")
    body = lambda s: F.rtrim(F.coalesce(s["wording"], _cut(text, s["os"], F.coalesce(s["oe"], size))), F.lit(BLANKS))
    lead = F.substring(text, F.lit(1), F.coalesce("first", F.lit(0)).cast("int"))
    apart = F.when((lead == "") | F.endswith(lead, F.lit(GAP)), lead).when(F.endswith(lead, F.lit("\n")), F.concat(lead, F.lit("\n"))).otherwise(F.concat(lead, F.lit(GAP)))
    rows = rows.select(id_col, "s", "first", "__t", size.alias("old_len"), F.transform("s", body).alias("bodies"), apart.alias("lead"))
    parts = F.transform("bodies", lambda b: F.when(b == "", b).otherwise(F.concat(b, F.lit(GAP))))
    whole = lambda p: F.concat("lead", F.array_join(p, ""))
    cut = lambda t: F.when(F.element_at("bodies", -1) == "", t).otherwise(F.left(t, F.length(t) - len(GAP)))
    rows = rows.select(id_col, "s", "first", "old_len", "lead", "bodies", once(whole(parts), cut).alias("text"), starts_of(parts, 0).alias("at"))

    def placed(s: Column, i: Column) -> Column:
        ns = F.get("at", i) + F.length("lead")
        ends = F.coalesce(s["oe"], F.when(s["os"].isNotNull(), F.col("old_len")))
        return F.struct(s["pos"].alias("pos"), s["idx"].alias("idx"), s["os"].alias("os"), ends.alias("oe"), ns.alias("ns"), (ns + F.length(F.get("bodies", i))).alias("ne"), s["wording"].isNull().alias("linear"), s["title"].alias("title"))

    before = F.struct(F.lit(None).alias("pos"), F.lit(None).alias("idx"), F.lit(0).cast("long").alias("os"), F.coalesce("first", F.lit(0)).cast("long").alias("oe"), F.lit(0).cast("long").alias("ns"), F.coalesce("first", F.lit(0)).cast("long").alias("ne"), F.lit(True).alias("linear"), F.lit(None).alias("title"))
    return rows.select(id_col, "old_len", "text", F.length("text").cast("long").alias("new_len"), F.concat(F.array(before), F.transform("s", placed)).alias("slots"))


def new_chapters(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, idx, start, end, old_idx, title) of rewritten documents; a chapter runs to the next start."""
    n = F.size("slots")
    last = lambda i: F.when(i + 1 < n, F.get("slots", i + 1)["ns"]).otherwise(F.col("new_len"))
    own = F.transform("slots", lambda s, i: F.struct((i - 1).cast("long").alias("idx"), s["ns"].alias("start"), last(i).alias("end"), s["idx"].alias("old_idx"), s["title"].alias("title")))
    return made.select(id_col, F.explode(F.slice(own, 2, n)).alias("c")).select(id_col, "c.*")


def segments(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, os, oe, ns, ne, linear) from old offsets to new ones, neighbours of one shift made one."""
    rows = made.select(id_col, F.explode(F.filter("slots", lambda s: s["os"].isNotNull())).alias("s")).select(id_col, "s.os", "s.oe", "s.ns", "s.ne", "s.linear")
    return spans.merged_segments(rows, id_col)


def moved(rows: DataFrame, cols: list[str], segs: DataFrame, lengths: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with the offsets `cols` where they lie after a rewrite, and `was`, a struct of what they were.

    lengths has (id, old_len, new_len). Rows of documents that are not rewritten stay as they are; null offsets stay null.
    """
    return _moved(rows.withColumn("was", F.struct(*cols)), cols, segs, lengths, spans.SEGMENT, id_col).select(*rows.columns, "was")


def _moved(rows: DataFrame, cols: list[str], segs: DataFrame, lengths: DataFrame, carried: list[str], id_col: str) -> DataFrame:
    """rows with their offsets where they lie now, and for each a struct of its segment."""
    found = spans.held(rows.join(lengths.select(id_col, F.col("old_len").alias("__o"), F.col("new_len").alias("__m")), id_col, "left"), segs, cols, carried, id_col)
    to = {c: F.coalesce(spans.led(F.col(c).cast("long"), F.col(f"__{c}"), F.col("__o"), F.col("__m")), c) for c in cols}
    return found.withColumns(to).drop("__o", "__m")


def undone(rows: DataFrame) -> DataFrame:
    """Moved rows as they were before."""
    before = rows.schema["was"].dataType.names
    return rows.select(*(F.col(f"was.{c}").alias(c) if c in before else F.col(c) for c in rows.columns if c != "was"))


def renumbered(rows: DataFrame, col: str, chapters: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows whose chapter numbers follow their chapters; numbers of no chapter stay."""
    to = chapters.where("old_idx IS NOT NULL").select(id_col, F.col("old_idx").alias(col), F.col("idx").alias("__n"))
    kept = rows.withColumn("was", F.struct(col)).join(to, [id_col, col], "left")
    return kept.withColumn(col, F.coalesce("__n", col)).select(*rows.columns, "was")


def _segments_with_words(made: DataFrame, id_col: str) -> DataFrame:
    """segments() with words: the new ones of the chapters that are worded anew, else null."""
    rows = made.select(id_col, "text", F.explode(F.filter("slots", lambda s: s["os"].isNotNull() & (~s["linear"] | (s["oe"] > s["os"])))).alias("s"))
    words = F.when(~F.col("s.linear"), _cut(F.col("text"), F.col("s.ns"), F.col("s.ne")))
    return rows.select(id_col, *(f"s.{c}" for c in spans.SEGMENT), words.alias("words"))


def _nearest(words: Column, source: Column, guess: Column) -> Column:
    """Of the places of source in words, from the left without overlaps, the nearest to guess, the first of equals; null without one."""
    size = F.length(source)
    parts = F.split(words, F.concat(F.lit("\\Q"), source, F.lit("\\E")))
    at = once(parts, lambda p: F.transform(F.slice(starts_of(p, size), 2, F.size(p)), lambda x: x - size))
    best = F.array_min(F.transform(at, lambda x: F.struct(F.abs(x - guess).alias("d"), x.alias("x"))))
    return F.when(size > 0, best["x"])


def moved_units(units: DataFrame, made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """units (id, unit, target, start, end, source, stale) after a rewrite, with `was`.

    Those in chapters that stay move along. Those in one worded anew are looked for by their source in the new words, where
    they lie nearest to the expected place; one that is not there stays at that place and is stale. Of units of a target
    that would get the same span, the later ones move on by single signs until each has its own.
    """
    before = F.struct("start", "end", "stale")
    rows = _moved(units.withColumn("was", before), ["end", "start"], _segments_with_words(made, id_col), made, [*spans.SEGMENT, "words"], id_col)
    fresh = F.coalesce(~F.col("__start.linear"), F.lit(False))
    at = F.when(fresh, _nearest(F.col("__start.words"), F.col("source"), F.col("start") - F.col("__start.ns")))
    rows = rows.select(*units.columns, "was", fresh.alias("__f"), F.col("__start.ns").alias("__ns"), at.alias("__at"))
    length = F.when(F.col("__at").isNotNull(), F.length("source")).otherwise(F.greatest(F.lit(1), F.col("was.end") - F.col("was.start"))).cast("long")
    rows = rows.withColumn("__n", F.when(F.col("__f"), length)).withColumn("__s", F.coalesce(F.col("__ns") + F.col("__at"), "start"))
    order = Window.partitionBy(id_col, "target", "__n", "__f").orderBy("__s", "was.start", "unit")
    rows = rows.withColumn("__r", F.row_number().over(order).cast("long"))
    apart = F.col("__r") + F.max(F.col("__s") - F.col("__r")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("start", F.when(F.col("__f"), apart).otherwise(F.col("start")))
    rows = rows.withColumns({"end": F.when(F.col("__f"), F.col("start") + F.col("__n")).otherwise(F.col("end")), "stale": F.when(F.col("__f"), F.col("__at").isNull()).otherwise(F.col("stale"))})
    return rows.select(*units.columns, "was")


def moved_notes(notes: DataFrame, made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """notes (id, note, start, end, quote, prefix, suffix) after a rewrite, with `was`.

    A note in a chapter worded anew is looked for in the new words by its quote and what stood around it; one that is not
    found stays at the place its offsets lead to.
    """
    rows = _moved(notes.withColumn("was", F.struct("start", "end")), ["end", "start"], _segments_with_words(made, id_col), made, [*spans.SEGMENT, "words"], id_col)
    seen = align.reanchored(F.col("__start.words"), F.col("start") - F.col("__start.ns"), F.col("quote"), F.col("prefix"), F.col("suffix"))
    rows = rows.withColumn("__x", seen)
    found = {c: F.coalesce(F.col("__start.ns") + F.col(f"__x.{c}"), c) for c in ("start", "end")}
    return rows.withColumns(found).select(*notes.columns, "was")


def kept_wordings(docs: DataFrame, chapters: DataFrame, slots: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, idx, hash, title, text): of each chapter that slots word anew, its wording and the new one; equal ones once.

    chapters has (id, idx, start, title).
    """
    w = Window.partitionBy(id_col).orderBy("start")
    old = chapters.select(id_col, "idx", "start", F.lead("start").over(w).alias("end"), F.col("title").alias("old_title"))
    anew = slots.where("idx IS NOT NULL AND text IS NOT NULL").select(id_col, "idx", F.col("text").alias("wording"), "title").join(old, [id_col, "idx"])
    rows = docs.select(id_col, F.col(text_col).alias("__t")).join(anew, id_col)
    mine = F.regexp_replace(_cut(F.col("__t"), F.col("start"), F.coalesce("end", F.length("__t"))), f"{WS}+\\z", "")
    both = F.array(F.struct(F.lit(0).alias("n"), F.col("old_title").alias("title"), mine.alias("text")), F.struct(F.lit(1).alias("n"), F.col("title"), F.col("wording").alias("text")))
    rows = rows.select(id_col, "idx", F.explode(both).alias("x")).select(id_col, "idx", canonical_hash(F.col("x.text")).alias("hash"), "x")
    return rows.groupBy(id_col, "idx", "hash").agg(F.min("x").alias("x")).select(id_col, "idx", "hash", "x.title", "x.text")


def rehomed(versions: DataFrame, before: DataFrame, after: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """versions (id, idx, hash) filed under the chapter that now holds the place where theirs began, with `was`.

    before has (id, idx, start), after (id, idx, start, end). One that no chapter holds stays where it was; so do all but
    the first, by their old numbers, of equal wordings that come to one chapter.
    """
    at = versions.withColumn("was", F.struct("idx")).join(before.select(id_col, "idx", F.col("start").alias("__at")), [id_col, "idx"], "left")
    now = after.select(id_col, F.col("idx").alias("__to"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    held = spans.points_in(at.where("__at IS NOT NULL").select(id_col, "__at").distinct(), now, "__at", "__s", "__e", id_col).groupBy(id_col, "__at").agg(F.min("__to").alias("__to"))
    rows = at.join(held, [id_col, "__at"], "left")
    n = F.row_number().over(Window.partitionBy(id_col, "__to", "hash").orderBy("idx"))
    rows = rows.withColumn("__k", n).withColumn("idx", F.when((F.col("__k") == 1) & F.col("__to").isNotNull(), F.col("__to")).otherwise(F.col("idx")))
    return rows.select(*versions.columns, "was")
