"""Operators on spans of documents: placing, joining, cutting and moving them.

Joins of points or spans with intervals go by buckets of offsets: each interval is filed under the buckets it touches and
each point under its own, so that the join is an equi-join on (document, bucket) and never a nested loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import BLANKS, sentence_pieces

BUCKET = 2048
#: Parts of a text whose lengths are added up one by one; the sums of such runs are added up in turn.
RUN = 64


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value made only once however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def starts_of(parts: Column, gap: Column | int) -> Column:
    """The place of each part of an array of texts where so many signs stand after each: array<long>, made within the row."""
    summed = lambda values, of: F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + of(x)))

    def runs(sizes: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")))
        return F.transform(at, lambda k: summed(F.slice(sizes, k * RUN + 1, RUN), lambda x: x))

    def joined(within: Column) -> Column:
        before = summed(within, lambda w: F.element_at(w, -1))
        return F.flatten(F.zip_with(within, F.slice(before, 1, F.size(within)), lambda w, b: F.transform(F.slice(w, 1, F.size(w) - 1), lambda x: x + b)))

    sizes = F.transform(parts, lambda x: (F.length(x) + gap).cast("long"))
    return once(sizes, lambda z: once(runs(z), joined))


def placed(parts: Column, gap: int) -> Column:
    """array<struct<text, start>> of the parts of a text."""
    return once(parts, lambda p: F.zip_with(p, starts_of(p, gap), lambda t, s: F.struct(t.alias("text"), s.alias("start"))))


def paragraphs(docs: DataFrame, sep: str = "\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, text, start, end): the parts between separators with their places in the text, empty ones too."""
    rows = docs.select(id_col, F.posexplode(placed(F.split(F.col(text_col), sep), len(sep))).alias("pos", "x"))
    return rows.select(id_col, "pos", "x.text", "x.start").withColumn("end", F.col("start") + F.length("text"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """(id, pos, start, end, text) of the sentences, white space at their ends left out; of Latin script without lang_col."""
    pieces = sentence_pieces(F.col(text_col), F.col(lang_col) if lang_col else None)
    parts = docs.select(id_col, F.posexplode(placed(pieces, 0)).alias("pos", "x")).select(id_col, "pos", F.col("x.text").alias("piece"), F.col("x.start").alias("at"))
    lead = F.length("piece") - F.length(F.ltrim("piece", F.lit(BLANKS)))
    rows = parts.withColumn("start", F.col("at") + lead).withColumn("text", F.btrim("piece", F.lit(BLANKS))).where(F.col("text") != "")
    return rows.select(id_col, "pos", "start", (F.col("start") + F.length("text")).alias("end"), "text")


def normalized(docs: DataFrame, blocks: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, text, start, end) of an array of blocks: blanks squeezed, empty ones dropped, placed with two line ends between them."""
    clean = lambda x: F.trim(F.regexp_replace(F.replace(x, F.lit("\u00a0"), F.lit(" ")), "[ \t]+", " "))
    kept = F.filter(F.transform(blocks, lambda x, i: F.struct(i.alias("pos"), clean(x).alias("text"))), lambda x: x["text"] != "")
    rows = docs.select(id_col, kept.alias("kept"))
    rows = rows.select(id_col, F.explode(F.zip_with("kept", starts_of(F.col("kept.text"), 2), lambda x, s: F.struct(x["pos"].alias("pos"), x["text"].alias("text"), s.alias("start")))).alias("x"))
    return rows.select(id_col, "x.pos", "x.text", "x.start").withColumn("end", F.col("start") + F.length("text"))


def closed(starts: DataFrame, lengths: DataFrame, lead: int = 200, id_col: str = "doc_id") -> DataFrame:
    """(id, title, start, end, confident): each chapter runs to the next start; a lead of more than so many is one, too.

    starts has (id, title, start), lengths (id, length).
    """
    w = Window.partitionBy(id_col).orderBy("start")
    rows = starts.join(lengths, id_col).withColumn("end", F.coalesce(F.lead("start").over(w), F.col("length").cast("long")))
    own = rows.where("end > start").select(id_col, "title", "start", "end", F.lit(True).alias("confident"))
    first = starts.groupBy(id_col).agg(F.min("start").alias("end")).where(F.col("end") > lead)
    return own.union(first.select(id_col, F.lit(""), F.lit(0).cast("long"), "end", F.lit(False)))


def _filed(spans: DataFrame, start: str, end: str, bucket: int) -> DataFrame:
    last = F.greatest(F.col(end) - 1, F.col(start))
    return spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(last / bucket))))


def points_in(points: DataFrame, intervals: DataFrame, at: str, start: str = "start", end: str = "end", on: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """Inner join of points with the intervals [start, end) that hold them."""
    p = points.withColumn("__b", F.floor(F.col(at) / bucket))
    return p.join(_filed(intervals, start, end, bucket), [on, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def overlapping(left: DataFrame, right: DataFrame, l_start: str, l_end: str, r_start: str, r_end: str, on: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """Inner join of spans that overlap; each pair once, in the bucket where the later of their starts lies."""
    pairs = _filed(left, l_start, l_end, bucket).join(_filed(right, r_start, r_end, bucket), [on, "__b"])
    first = F.floor(F.greatest(F.col(l_start), F.col(r_start)) / bucket)
    return pairs.where((F.col(l_end) > F.col(r_start)) & (F.col(l_start) < F.col(r_end)) & (F.col("__b") == first)).drop("__b")


def pieces(spans: DataFrame, marks: DataFrame, on: str = "doc_id", span: str = "span_id", mark: str = "mark_id") -> DataFrame:
    """(on, span, start, end, mark): spans cut at the bounds of the marks, each piece with the shortest mark over it.

    spans has (on, span, start, end) and marks (on, mark, m_start, m_end). Of marks of one length the smallest id counts. The
    marks over a span are gathered in its row, where it is cut.
    """
    pairs = overlapping(spans, marks, "start", "end", "m_start", "m_end", on).select(on, span, "start", "end", F.struct("m_start", "m_end", mark).alias("m"))
    bare = spans.select(on, span, "start", "end", F.lit(None).cast(pairs.schema["m"].dataType).alias("m"))
    held = pairs.union(bare).groupBy(on, span, "start", "end").agg(F.collect_list("m").alias("ms"))

    def shortest(start: Column) -> Column:
        over = F.filter("ms", lambda m: (m["m_start"] <= start) & (start < m["m_end"]))
        return F.array_min(F.transform(over, lambda m: F.struct((m["m_end"] - m["m_start"]).alias("n"), m[mark].alias("m"))))["m"]

    bounds = F.flatten(F.transform("ms", lambda m: F.array(F.greatest(F.col("start"), m["m_start"]), F.least(F.col("end"), m["m_end"]))))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array("start", "end"), bounds)))
    cut = once(cuts, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end"), shortest(a).alias(mark))))
    return held.select(on, span, F.explode(cut).alias("x")).select(on, span, "x.start", "x.end", f"x.{mark}")


def merged_segments(segments: DataFrame, on: str = "doc_id") -> DataFrame:
    """(on, os, oe, ns, ne, linear): neighbouring linear segments of one shift become one; empty linear ones go."""
    kept = segments.where(~(F.col("linear") & (F.col("oe") <= F.col("os"))))
    w = Window.partitionBy(on).orderBy("os")
    joins = F.col("linear") & F.lag("linear").over(w) & (F.lag("oe").over(w) == F.col("os")) & (F.lag(F.col("ns") - F.col("os")).over(w) == F.col("ns") - F.col("os"))
    run = F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w)
    return kept.withColumn("run", run).groupBy(on, "run").agg(F.min("os").alias("os"), F.max("oe").alias("oe"), F.min("ns").alias("ns"), F.max("ne").alias("ne"), F.first("linear").alias("linear")).drop("run")


def held(points: DataFrame, segments: DataFrame, cols: list[str], carried: list[str], on: str = "doc_id") -> DataFrame:
    """points with a struct of `carried` for each of cols, named after it with two strokes: the segment [os, oe) that holds it.

    Segments of a document do not overlap, so the last that begins at or before an offset is the only one that may hold it:
    both are sorted together by document, and no row is joined or copied. Null where none does. The last of cols is looked
    up last, after which the rows are moved no more.
    """
    rows = points.withColumns({"__k": F.lit(1), **{f"__at_{c}": F.col(c).cast("long") for c in cols}})
    for i, c in enumerate(cols):
        own = carried if i == len(cols) - 1 else [x for x in carried if x != "words"]
        seg = segments.select(F.col(on), F.lit(0).alias("__k"), F.col("os").cast("long").alias(f"__at_{c}"), F.struct("oe", *(x for x in own if x != "oe")).alias("__g"))
        order = Window.partitionBy(on).orderBy(f"__at_{c}", "__k", "__g.oe")
        rows = rows.unionByName(seg, allowMissingColumns=True).withColumn("__l", F.last("__g", True).over(order)).where("__k = 1")
        rows = rows.withColumn(f"__{c}", F.when(F.col("__l.oe") > F.col(f"__at_{c}"), F.col("__l"))).drop("__g", "__l")
    return rows.drop("__k", *(f"__at_{c}" for c in cols))


def led(at: Column, segment: Column, old_len: Column, new_len: Column) -> Column:
    """Where an offset lies after a revision that its segment (os, oe, ns, ne, linear) leads; beyond all of them behind the text."""
    x, width = at - segment["os"], F.greatest(F.lit(1).cast("long"), segment["oe"] - segment["os"])
    to = F.when(segment["linear"], F.least(segment["ns"] + x, segment["ne"])).otherwise(segment["ns"] + F.floor(x * (segment["ne"] - segment["ns"]) / width))
    return F.when(at.isNotNull(), F.when(segment.isNotNull(), to).otherwise(new_len + F.greatest(F.lit(0).cast("long"), at - old_len)))


SEGMENT = ["os", "oe", "ns", "ne", "linear"]


def remapped(points: DataFrame, segments: DataFrame, lengths: DataFrame, at: str = "at", on: str = "doc_id") -> DataFrame:
    """points with new_at: their place after a revision. lengths has (on, old_len, new_len)."""
    rows = held(points, segments, [at], SEGMENT, on).join(lengths.select(on, "old_len", "new_len"), on)
    return rows.withColumn("new_at", led(F.col(at), F.col(f"__{at}"), F.col("old_len"), F.col("new_len"))).select(*points.columns, "new_at")


def shortest_over(points: DataFrame, marks: DataFrame, at: str, key: Column, on: str = "doc_id") -> DataFrame:
    """points with mark: the key of the shortest mark [m_start, m_end) over each, the smallest of equals."""
    hit = points_in(points, marks, at, "m_start", "m_end", on)
    cols = points.columns
    return hit.groupBy(*cols).agg(F.min(F.struct((F.col("m_end") - F.col("m_start")).alias("n"), key.alias("k"))).alias("x")).select(*cols, F.col("x.k").alias("mark"))


def placed_units(units: DataFrame, paragraphs: DataFrame, on: str = "doc_id", unit: str = "unit") -> DataFrame:
    """(on, unit, u_start, u_end, pos, shared): each unit in the paragraph it shares most with, the first of equals.

    units has (on, unit, u_start, u_end), paragraphs (on, pos, start, end).
    """
    pairs = overlapping(units, paragraphs, "u_start", "u_end", "start", "end", on)
    shared = F.least("u_end", "end") - F.greatest("u_start", "start")
    best = pairs.groupBy(on, unit, "u_start", "u_end").agg(F.max(F.struct(shared.alias("n"), (-F.col("pos")).alias("p"))).alias("x"))
    return best.select(on, unit, "u_start", "u_end", (-F.col("x.p")).cast("long").alias("pos"), F.col("x.n").alias("shared"))
