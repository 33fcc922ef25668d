"""Structure of documents: chapters, scenes, parts, pages, edits of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import BOUND, WS, base_language, trim
from foliant.operators import spans

#: How the lines that open a chapter look, by language.
PATTERNS = {
    "en": (
        r"(?i)^(chapter|part|book|act|interlude)\b[\s.:—-]*([0-9]+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|twenty|thirty)?\b",
        r"(?i)^(prologue|epilogue|foreword|afterword|preface)\b",
    ),
    "zh": (
        r"^第\s*[0-9０-９零〇一二三四五六七八九十百千万两]+\s*[章回节節卷部篇折]",
        r"^(楔子|序章|序言|序|引子|尾声|尾聲|终章|終章|后记|後記|番外|外传|外傳)(?![\x{4e00}-\x{9fff}])",
    ),
    "any": (r"^[0-9]{1,4}[.、]?$",),
}
MAX_HEADING, MIN_HITS, MAX_PARTS, LEAD = 60, 3, 3, 200
ORNAMENT, REPEATED = r"^[※◇◆○●☆★✽❉❖＊❋⁂]+$", r"^[*·•\-–—_=~#.]+$"


def is_chapter_line(line: Column, language: Column) -> Column:
    """Whether a trimmed line of 60 characters at most looks like one that opens a chapter in its language."""
    hit = line.rlike(PATTERNS["any"][0])
    for code in ("en", "zh"):
        for pattern in PATTERNS[code]:
            hit = hit | ((base_language(language) == code) & line.rlike(pattern.replace(r"\b", BOUND)))
    return (F.length(line) <= MAX_HEADING) & (line != "") & hit


def is_separator(line: Column) -> Column:
    """A scene break: ornaments, or three or more of the repeated signs, 24 at most."""
    bare = F.regexp_replace(line, WS, "")
    return (bare != "") & (F.length(bare) <= 24) & (bare.rlike(ORNAMENT) | (bare.rlike(REPEATED) & (F.length(bare) >= 3)))


def without_caption(title: Column) -> Column:
    label = F.regexp_extract(title, r"""(?i)[.!?”"’]\s+((?:chapter|book|part)\s+(?:[0-9]+|[ivxlcdm]+)\.?)$""", 1)
    return F.when(label != "", label).otherwise(title)


def chapters_from_patterns(paragraphs: DataFrame, docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", sep_len: int = 1) -> DataFrame:
    """(id, title, start, end, confident): chapters by lines that match; all of a text in one where fewer than three do."""
    facts = docs.select(id_col, lang_col, F.length(text_col).cast("long").alias("length"))
    lines = paragraphs.join(facts, id_col).withColumn("title", trim(F.col("text")))
    starts = lines.where(is_chapter_line(F.col("title"), F.col(lang_col))).withColumn("hits", F.count(F.lit(1)).over(Window.partitionBy(id_col)))
    starts = starts.where(F.col("hits") >= MIN_HITS).select(id_col, "title", "start")
    lengths = facts.select(id_col, "length")
    whole = lengths.join(starts.select(id_col).distinct(), id_col, "left_anti").where("length > 0")
    return spans.closed(starts, lengths, LEAD, id_col).union(whole.select(id_col, F.lit(""), F.lit(0).cast("long"), "length", F.lit(False)))


def heading_starts(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, title, start): chapters by headings. blocks has (id, start, end, text, heading), heading null for running text.

    The chapter level is heading_level(). A heading above it with the next one straight under it is an act's label: the
    chapter that follows starts there, at the first of several such labels. Other headings above the level are chapters, too.
    """
    w = Window.partitionBy(id_col).orderBy("start")
    after = blocks.withColumn("under", F.lead("heading").over(w)).where("heading IS NOT NULL")
    levels = heading_level(after.select(id_col, F.col("heading").alias("level")), id_col)
    kept = after.join(levels, id_col).where("heading <= level")
    kept = kept.withColumn("label", F.coalesce((F.col("heading") < F.col("level")) & (F.col("under") > F.col("heading")), F.lit(False)))
    run = F.coalesce(F.sum((~F.col("label")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    title = F.max(F.when(~F.col("label"), without_caption(trim(F.col("text")))))
    return kept.withColumn("run", run).groupBy(id_col, "run").agg(title.alias("title"), F.min("start").alias("start")).where("title IS NOT NULL").select(id_col, "title", "start")


#: How many starts a way of finding chapters must give, in the order in which the ways are tried.
WAYS = (("headings", 2), ("patterns", MIN_HITS), ("spine", 2))


def detected_chapters(blocks: DataFrame, docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """(id, method, title, start, end, confident): chapters by headings, or else by lines that look like one, or else by
    the file's own boundaries; all of a text in one where none of these gives enough, and none of an empty text.

    blocks has (id, start, end, text, heading, boundary), docs (id, lang, length).
    """
    line = trim(F.col("text"))
    matched = blocks.join(docs.select(id_col, lang_col), id_col).where(is_chapter_line(line, F.col(lang_col))).select(id_col, line.alias("title"), "start")
    spine = blocks.where("boundary").select(id_col, line.alias("title"), "start")
    found = [heading_starts(blocks, id_col), matched, spine]
    rows = None
    for k, (df, (_, least)) in enumerate(zip(found, WAYS)):
        own = df.withColumn("way", F.lit(k)).withColumn("least", F.lit(least))
        rows = own if rows is None else rows.unionByName(own)
    n = F.count(F.lit(1)).over(Window.partitionBy(id_col, "way"))
    rows = rows.withColumn("n", n).where("n >= least").withColumn("best", F.min("way").over(Window.partitionBy(id_col))).where("way = best")
    lengths = docs.select(id_col, F.col("length").cast("long").alias("length"))
    ways = rows.select(id_col, "way").distinct()
    method = F.element_at(F.array(*(F.lit(name) for name, _ in WAYS)), F.col("way") + 1)
    closed = spans.closed(rows.select(id_col, "title", "start"), lengths, LEAD, id_col).join(ways.select(id_col, method.alias("method")), id_col)
    whole = lengths.join(ways, id_col, "left_anti").where("length > 0")
    whole = whole.select(id_col, F.lit("none").alias("method"), F.lit("").alias("title"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), F.lit(False).alias("confident"))
    return closed.select(id_col, "method", "title", "start", "end", "confident").unionByName(whole)


def heading_level(headings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, level): the level of chapters. Levels of three headings at most are parts if the next level has more."""
    n = headings.groupBy(id_col, "level").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(id_col).orderBy("level")
    after = F.lead("n").over(w)
    stops = n.withColumn("stop", after.isNull() | (F.col("n") > MAX_PARTS) | (after <= F.col("n")))
    return stops.where("stop").groupBy(id_col).agg(F.min("level").alias("level"))


def grouped_chapters(paragraphs: DataFrame, size: int = 5, id_col: str = "doc_id") -> DataFrame:
    """(id, idx, start, end): chapters of so many paragraphs, for texts without headings; they tile the text."""
    return paragraphs.groupBy(id_col, F.floor(F.col("pos") / size).alias("idx")).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def chapter_bodies(docs: DataFrame, size: int = 5, text_col: str = "text") -> DataFrame:
    """docs' other columns with (idx, start, body): chapters of so many lines, cut where the text lies."""
    lines = spans.placed(F.split(F.col(text_col), "\n"), 1)
    others = [c for c in docs.columns if c != text_col]
    at = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / size).cast("int"))
    body = lambda k: F.array_join(F.transform(F.slice("lines", k * size + 1, size), lambda x: x["text"]), "\n")
    cut = F.transform(at, lambda k: F.struct(k.cast("long").alias("idx"), F.get("lines", k * size)["start"].alias("start"), body(k).alias("body")))
    rows = docs.where(F.col(text_col).isNotNull()).select(*others, lines.alias("lines")).select(*others, F.explode(cut).alias("x"))
    return rows.select(*others, "x.idx", "x.start", "x.body")


def scenes(blocks: DataFrame, text_of: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, scene, start, end) of documents that have separators: runs of blocks between these, gaps and islands."""
    marked = blocks.withColumn("sep", is_separator(F.col(text_of)).cast("int"))
    w = Window.partitionBy(id_col).orderBy("start")
    run = marked.withColumn("run", F.sum("sep").over(w)).withColumn("any", F.max("sep").over(Window.partitionBy(id_col)))
    out = run.where("any = 1 AND sep = 0").groupBy(id_col, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return out.withColumn("scene", F.row_number().over(w).cast("long")).select(id_col, "scene", "start", "end")


def scenes_from_breaks(start: Column, end: Column, breaks: Column) -> Column:
    """array<struct<start, end>>: a range cut at the distinct breaks inside it; none without such breaks."""
    inside = F.array_sort(F.array_distinct(F.filter(breaks, lambda b: (b > start) & (b < end))))
    pairs = F.zip_with(F.concat(F.array(start), inside), F.concat(inside, F.array(end)), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return F.when(F.size(inside) > 0, pairs).otherwise(F.slice(pairs, 1, 0))


def runs(rows: DataFrame, name: str, order: str, by: str) -> DataFrame:
    """(by, name, first, last, n) of runs of one name in a row; groups with one run have none."""
    w = Window.partitionBy(by).orderBy(order)
    marked = rows.withColumn("new", F.when(F.lag(name).over(w).eqNullSafe(F.col(name)), 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("new").over(w))
    out = numbered.groupBy(by, "run", name).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("all", F.count(F.lit(1)).over(Window.partitionBy(by))).where("`all` >= 2").select(by, name, "first", "last", "n")


def pages_of(marks: DataFrame, lengths: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, number, start, end): page marks (id, number, start) that rise, each up to the next; others are skipped."""
    w = Window.partitionBy(id_col).orderBy("start", "number")
    before = F.max("number").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = marks.where(F.coalesce(F.col("number") > 0, F.lit(False))).withColumn("before", before).where("before IS NULL OR number > before").drop("before")
    return kept.join(lengths, id_col).withColumn("end", F.coalesce(F.lead("start").over(w), F.col("length").cast("long"))).drop("length")


def split_at(chapters: DataFrame, cuts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chapters (id, idx, start, end) cut at offsets (id, at) inside them and numbered anew."""
    inside = spans.points_in(cuts, chapters, "at", on=id_col).where("at > start").select(id_col, F.col("at").alias("start")).distinct()
    ends = chapters.groupBy(id_col).agg(F.max("end").alias("last"))
    starts = chapters.select(id_col, "start").union(inside).distinct()
    w = Window.partitionBy(id_col).orderBy("start")
    out = starts.join(ends, id_col).withColumn("end", F.coalesce(F.lead("start").over(w), F.col("last")))
    return out.select(id_col, (F.row_number().over(w) - 1).cast("long").alias("idx"), "start", "end")


def merged_with_next(chapters: DataFrame, at: Column, id_col: str = "doc_id") -> DataFrame:
    """Chapters (id, idx, start, end) where each that `at` holds for takes in the one after it; numbered anew."""
    w = Window.partitionBy(id_col).orderBy("idx")
    joined = chapters.withColumn("on", at).withColumn("new", F.when(F.coalesce(F.lag("on").over(w), F.lit(False)), 0).otherwise(1))
    out = joined.withColumn("run", F.sum("new").over(w)).groupBy(id_col, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return out.select(id_col, (F.col("run") - 1).cast("long").alias("idx"), "start", "end")


def with_edits(chapters: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chapters (id, idx, start, end, title, by_hand) after edits (id, idx, action, title), one for each chapter, numbered anew.

    action is rename, or above or below for a chapter whose break goes: its words join the chapter above or below it, the
    first one's always that below and the last one's that above. What joins bears the title of its first chapter that was
    not taken away, or of its first where all were. An empty title of a renamed chapter is one; edits of no chapter do nothing.
    """
    w = Window.partitionBy(id_col).orderBy("idx")
    rows = chapters.join(edits.select(id_col, "idx", "action", trim(F.coalesce("title", F.lit(""))).alias("given")), [id_col, "idx"], "left")
    gone = F.coalesce(F.col("action").isin("above", "below"), F.lit(False))
    last = F.lead("idx").over(w).isNull()
    rows = rows.withColumns({"gone": gone, "joins": F.when(gone, F.when((F.col("action") == "above") & F.lag("idx").over(w).isNotNull() | last, "above").otherwise("below"))})
    broken = F.coalesce((F.col("joins") == "above") | (F.lag("joins").over(w) == "below"), F.lit(False))
    rows = rows.withColumn("run", F.sum(F.when(broken & F.lag("idx").over(w).isNotNull(), 0).otherwise(1)).over(w))
    title = F.when(F.col("action") == "rename", F.col("given")).otherwise(F.col("title"))
    head = F.min(F.struct("gone", "idx", title.alias("title")))
    out = rows.groupBy(id_col, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), head.alias("h"), F.bool_or(F.col("by_hand") | F.col("action").isNotNull()).alias("by_hand"))
    return out.select(id_col, (F.col("run") - 1).cast("long").alias("idx"), "start", "end", F.col("h.title").alias("title"), "by_hand")


def with_moves(chapters: DataFrame, moves: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chapters (id, idx, …) of which some change places with the one before or after, as moves (id, idx, by) say, by -1 or 1.

    Their offsets stay, so what points into the text does. A move beyond the ends does nothing; of moves that would touch
    one chapter twice the first by number counts, then the next that touches none of its chapters.
    """
    sizes = chapters.groupBy(id_col).agg(F.max("idx").alias("last"))
    low = moves.where("by IN (-1, 1)").select(id_col, F.least("idx", F.col("idx") + F.col("by")).alias("low")).distinct()
    low = low.join(sizes, id_col).where("low >= 0 AND low < last")
    w = Window.partitionBy(id_col).orderBy("low")
    low = low.withColumn("island", F.col("low") - F.row_number().over(w))
    low = low.withColumn("n", F.row_number().over(Window.partitionBy(id_col, "island").orderBy("low"))).where("n % 2 = 1")
    swapped = low.select(id_col, F.explode(F.array(F.struct(F.col("low").alias("idx"), (F.col("low") + 1).alias("to")), F.struct((F.col("low") + 1).alias("idx"), F.col("low").alias("to")))).alias("x")).select(id_col, "x.idx", "x.to")
    return chapters.join(swapped, [id_col, "idx"], "left").withColumn("idx", F.coalesce("to", "idx")).select(*chapters.columns)


def with_kept_titles(detected: DataFrame, edited: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Detected chapters with the titles that were given by hand at the same starts."""
    own = edited.select(id_col, "start", F.col("title").alias("given"))
    return detected.join(own, [id_col, "start"], "left").withColumn("title", F.coalesce("given", "title")).drop("given")


def hints_of(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end, heading, boundary) of the blocks that carry structure; the others can be had from the text again."""
    return blocks.where("heading IS NOT NULL OR boundary").select(id_col, "start", "end", "heading", F.coalesce("boundary", F.lit(False)).alias("boundary"))


def blocks_from_hints(docs: DataFrame, hints: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, text, heading, boundary): a text's paragraphs between blank lines, with the hints at their starts."""
    own = spans.paragraphs(docs, "\n\n", id_col, text_col).where(trim(F.col("text")) != "").select(id_col, "start", "end", "text")
    return own.join(hints.select(id_col, "start", "heading", "boundary"), [id_col, "start"], "left").select(id_col, "start", "end", "text", "heading", F.coalesce("boundary", F.lit(False)).alias("boundary"))


def resolved_links(links: DataFrame, anchors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end, href, at): links that lead somewhere, at being the place of an anchor within the document.

    links has (id, start, end, href), anchors (id, anchor, at). Of anchors of one name the first counts; a fragment names
    one as it is or with % signs decoded, else without regard to case. Other links stay if they are web or mail addresses.
    """
    first = lambda name: anchors.groupBy(id_col, name.alias("name")).agg(F.min(F.struct("at", "anchor")).alias("x"))
    exact = first(F.col("anchor")).select(id_col, F.col("name").alias("wanted"), F.col("x.anchor").alias("a1"), F.col("x.at").alias("at1"))
    folded = first(F.lower("anchor")).select(id_col, F.col("name").alias("low"), F.col("x.anchor").alias("a2"), F.col("x.at").alias("at2"))
    raw = F.substring(F.col("href"), F.lit(2), F.length("href"))
    wanted = F.when(F.startswith("href", F.lit("#")), F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))
    rows = links.withColumn("wanted", wanted).withColumn("low", F.lower("wanted")).join(exact, [id_col, "wanted"], "left").join(folded, [id_col, "low"], "left")
    name = F.coalesce("a1", "a2")
    href = F.when(name.isNotNull(), F.concat(F.lit("#"), name)).when(F.col("href").rlike("(?i)^(https?:|mailto:)"), F.col("href"))
    return rows.select(id_col, "start", "end", href.alias("href"), F.coalesce("at1", "at2").alias("at")).where("href IS NOT NULL")


#: Signs of the text at a reader's place that are looked for again, and the fewest of them that tell enough.
PROBE, LEAST_PROBE = 48, 12


def placed_again(text: Column, at: Column, new: Column) -> Column:
    """Where a reader's place in a text is in its new version: the probe's occurrence nearest to the same share of it.

    Occurrences are taken from the left without overlaps. Where the probe is too short or gone it is the share itself.
    """
    probe = F.substring(text, at + 1, F.lit(PROBE))
    guess = F.when(F.length(text) > 0, F.floor(at.cast("double") * F.length(new) / F.length(text) + 0.5)).otherwise(0).cast("long")
    parts = F.split(new, F.concat(F.lit("\\Q"), probe, F.lit("\\E")))
    size = F.length(probe)
    places = F.transform(F.slice(spans.starts_of(parts, size), 2, F.size(parts)), lambda x: x - size)
    best = F.array_min(F.transform(places, lambda x: F.struct(F.abs(x - guess).alias("off"), x.alias("at"))))["at"]
    return F.when((F.length(trim(probe)) >= LEAST_PROBE) & F.contains(new, probe), best).otherwise(guess)


#: What stands in a field that has no name in it.
NO_NAME = (
    "unknown",
    "n/a",
    "na",
    "none",
    "null",
    "undefined",
    "unspecified",
    "untitled",
    "no part",
    "not applicable",
    "part",
    "volume",
    "book",
    "section",
    "-",
    "—",
    "–",
    "?",
    "未知",
    "无",
    "無",
    "未分卷",
    "未命名",
    "不详",
    "不詳",
    "无标题",
    "無標題",
)


def meaningful_name(name: Column) -> Column:
    """A part's name without white space at its ends; empty where it says nothing."""
    bare = trim(F.coalesce(name, F.lit("")))
    return F.when(F.lower(bare).isin(*NO_NAME), "").otherwise(bare)
