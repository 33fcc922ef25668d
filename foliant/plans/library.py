"""Queries of the library's upkeep: references, re-filing, glossaries and units, cards, imports, exports, the queue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import cast, records, resolve, spans, structure
from foliant.plans.cast import _B, _N, _U, _bodies, _names, _sents, _units
from foliant.plans.common import SQL_PARAGRAPHS, sql_squeeze, sql_trim, table
from foliant.plans.resolve import _PAIRS, _books
from foliant.plans.structure import _C, _P, _S, _chapters, _lines


def _n(by, order):
    return F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")


def t08_languages(spark, sf):
    """Language tags as the translator knows them: the base, Chinese by script or region."""
    tag = F.concat(F.col("lang"), F.when(F.col("doc_id") % 3 == 0, "-TW").when(F.col("doc_id") % 3 == 1, "_CN").otherwise(""))
    low = F.lower(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("zh"), F.substring(tag, F.lit(3), F.length(tag)))).otherwise(tag))
    out = F.when(~low.rlike("^zh"), X.base_language(low)).when(low.rlike("hant|tw|hk|mo"), "zh-Hant").otherwise("zh-Hans")
    return table(spark, sf, "documents").select("doc_id", out.alias("language"))


def t13_same_author(spark, sf):
    """Customers and suppliers of a nation whose names may be one author's."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.regexp_replace("c_name", "Customer#0+", "No ").alias("a"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), F.regexp_replace("s_name", "Supplier#0+", "no, ").alias("b"))
    return resolve.author_pairs(c, s, "n").select("c_custkey", "s_suppkey")


def t16_patterns(spark, sf):
    p = table(spark, sf, "part")
    like = F.when(X.has_word_breaks(F.col("p_name")), F.array(F.concat(X.escape_like(F.col("p_brand")), F.lit("%")), F.concat(F.lit("% "), X.escape_like(F.col("p_brand")), F.lit("%")))).otherwise(F.array(F.concat(F.lit("%"), F.col("p_brand"), F.lit("%"))))
    return p.select("p_partkey", F.array_join(like, "|").alias("patterns"), F.concat(F.lit("%"), F.array_join(F.split("p_brand", ""), "%"), F.lit("%")).alias("loose"))


def t19_digests(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.hex(F.encode(F.substring("text", 1, 16), "utf-8")).alias("hex"))


def t24_bundle_dates(spark, sf):
    """Names of daily bundles and the dates read back from them."""
    name = F.concat(F.lit("library-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit(".zip"))
    return table(spark, sf, "orders").select("o_orderkey", name.alias("name"), F.try_to_date(F.regexp_extract(name, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)).cast("string").alias("day"))


def t25_titles(spark, sf):
    p = table(spark, sf, "part")
    both = X.title_and_series(F.when(F.col("p_size") > 20, F.concat("p_name", F.lit(" ("), "p_type", F.lit(" #"), F.col("p_size").cast("string"), F.lit(")"))).otherwise(F.col("p_name")))
    return p.select("p_partkey", both.alias("t")).select("p_partkey", "t.title", "t.series")


def t26_kinds(spark, sf):
    low = F.lower("p_type")
    kind = F.when(low.rlike("brass|steel"), "reference").when(low.rlike("copper|tin"), "poetry").otherwise("novel")
    return table(spark, sf, "part").groupBy("p_type").agg(F.min(kind).alias("kind"), F.count(F.lit(1)).alias("n"))


def t27_ties(spark, sf):
    """Roles as ties: user and assistant stand for servant and master."""
    label = F.when(F.col("role") == "user", "his old Teacher").when(F.col("role") == "assistant", "student").otherwise("nobody")
    c = table(spark, sf, "conversations").select("conv_id", "turn", X.tie(label).alias("tie"))
    return c.select("conv_id", "turn", "tie", X.opposite_tie(F.col("tie")).alias("opposite"), X.tie_group(F.col("tie")).alias("family"))


def t38_images(spark, sf):
    """Image markers made of pages' addresses and read back."""
    marker = F.concat(F.lit("![page "), F.col("page_id").cast("string"), F.lit("]("), F.col("url"), F.lit(")"))
    got = lambda i: F.regexp_extract(marker, r"^!\[([^\]]*)\]\(([^)]*)\)$", i)
    return table(spark, sf, "pages").select("page_id", got(1).alias("alt"), got(2).alias("src"))


def t39_stars(spark, sf):
    n = F.floor(F.col("c_acctbal") / 2000).cast("int")
    return table(spark, sf, "customer").select("c_custkey", F.when(n.between(1, 5), n).alias("stars"), F.when(F.col("c_acctbal") < 0, "wishlist").when(F.col("c_acctbal") < 3000, "reading").otherwise("read").alias("status"))


def d06_captions(spark, sf):
    lines = _lines(spark, sf).where("pos = 1").withColumn("t", F.concat(F.substring("text", 1, 30), F.lit(". Chapter "), (F.col("doc_id") % 40).cast("string")))
    return lines.select("doc_id", structure.without_caption(F.col("t")).alias("title"))


def d14_split_points(spark, sf):
    """Sentence starts as places to cut, with whether a line starts there."""
    s = spans.sentences(table(spark, sf, "documents")).select("doc_id", "start", F.sha2(F.substring("text", 1, 60), 256).alias("preview"))
    starts = _lines(spark, sf).select("doc_id", "start", F.lit(True).alias("p")).distinct()
    return s.join(starts, ["doc_id", "start"], "left").select("doc_id", "start", "preview", F.coalesce("p", F.lit(False)).alias("paragraph"))


def d17_previews(spark, sf):
    rows = _lines(spark, sf).withColumn("t", X.trim(F.col("text"))).where("t <> ''").withColumn("i", _n("doc_id", ["pos"]) - 1).where("i < 120")
    return rows.select("doc_id", "i", F.col("start").alias("offset"), F.substring("t", 1, 90).alias("preview"))


def d19_tiles(spark, sf):
    """Scenes from each third line as anchors; the first of a chapter starts with it."""
    anchors = _lines(spark, sf).where("pos % 3 = 1").select("doc_id", F.col("start").alias("at"))
    hit = spans.points_in(anchors, _chapters(spark, sf), "at").distinct()
    w = Window.partitionBy("doc_id", "idx").orderBy("at")
    first = F.when(F.row_number().over(w) == 1, F.col("start")).otherwise(F.col("at"))
    return hit.select("doc_id", "idx", first.alias("s"), F.coalesce(F.lead("at").over(w), F.col("end")).alias("e")).where("e > s")


def d21_layout(spark, sf):
    """Lines with the list mark they begin with, if any."""
    mark = F.regexp_extract("text", r"^(•|◦|[0-9]{1,3}[.)])[ \t]+", 1)
    lines = _lines(spark, sf).withColumn("text", F.when(F.col("pos") % 5 == 0, F.concat(((F.col("pos") / 5).cast("int") + 1).cast("string"), F.lit(". "), F.col("text"))).otherwise(F.col("text")))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.nullif(mark, F.lit("")).alias("marker"), F.length(F.regexp_replace("text", r"^(•|◦|[0-9]{1,3}[.)])[ \t]+", "")).cast("long").alias("n"))


def d22_bodies(spark, sf):
    """Numbered lines of chapters, at most 12,000 characters of each."""
    own = _lines(spark, sf).where("trim(text) <> ''").withColumn("idx", F.floor(F.col("pos") / 5))
    rows = own.withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "idx").orderBy("pos")))
    out = records.listed(rows, ["doc_id", "idx"], F.col("pos"), F.concat(F.col("i").cast("string"), F.lit(": "), F.col("text")), "\n", "body")
    return out.select("doc_id", "idx", F.sha2(F.substring("body", 1, 12000), 256).alias("sha"))


def d23_context(spark, sf):
    """What went before each chapter: the openings of the last six, oldest first."""
    rows = _bodies(spark, sf).select("doc_id", "idx", X.opening(F.col("body"), 220).alias("brief"))
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(-6, -1)
    return rows.select("doc_id", "idx", F.sha2(F.array_join(F.collect_list("brief").over(w), "\n"), 256).alias("sha"))


def j02_references(spark, sf):
    """Sentences as chapter:line references."""
    points = spans.sentences(table(spark, sf, "documents")).select("doc_id", F.col("start").alias("at"))
    lines = _lines(spark, sf).select("doc_id", "pos", "start", "end").where("end > start")
    hit = spans.points_in(points, lines, "at")
    return hit.select("doc_id", "at", F.concat_ws(":", (F.floor(F.col("pos") / 5) + 1).cast("string"), (F.col("pos") % 5 + 1).cast("string")).alias("ref"))


def j03_counts(spark, sf):
    """Sentences in the second quarter of each document."""
    s = spans.sentences(table(spark, sf, "documents")).join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return s.where("start >= n_chars / 4 AND start < n_chars / 2").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def j04_refile(spark, sf):
    """Lines filed by fours go to the chapter that holds them now; those in none stay."""
    lines = _lines(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), (F.col("start") + 1).alias("at"), F.floor(F.col("pos") / 4).alias("old"))
    hit = spans.points_in(lines, _chapters(spark, sf), "at").select("doc_id", "pos", "idx")
    return lines.join(hit, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("idx", "old").alias("idx"), (F.col("idx").isNotNull() & (F.col("idx") != F.col("old"))).alias("moved"))


def j07_quotes(spark, sf):
    """The middle third of each chapter, line by line, clipped to it."""
    third = _chapters(spark, sf).select("doc_id", "idx", (F.col("start") + F.floor((F.col("end") - F.col("start")) / 3)).alias("q_start"), (F.col("end") - F.floor((F.col("end") - F.col("start")) / 3)).alias("q_end"))
    lines = _lines(spark, sf).select("doc_id", "pos", "text", "start", "end").where("end > start")
    hit = spans.overlapping(third.where("q_end > q_start"), lines, "q_start", "q_end", "start", "end")
    lo, hi = F.greatest("start", "q_start"), F.least("end", "q_end")
    part = F.concat((F.col("pos") + 1).cast("string"), F.lit(" "), F.substring(F.col("text"), (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")))
    return records.listed(hit, ["doc_id", "idx"], F.col("pos"), part, "\n", "quote").select("doc_id", "idx", F.sha2("quote", 256).alias("sha"))


def j14_layout(spark, sf):
    """Translated units, sentences that have slipped by nine characters, laid out over lines: how many, and how many of them whole."""
    s = spans.sentences(table(spark, sf, "documents"))
    units = s.select("doc_id", F.col("pos").cast("long").alias("unit"), (F.col("start") + 9).alias("u_start"), (F.col("end") + 9).alias("u_end"))
    lines = _lines(spark, sf).select("doc_id", "pos", "start", "end").where("end > start")
    laid = spans.placed_units(units, lines)
    return laid.groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("shared") == F.col("u_end") - F.col("u_start")).alias("whole"), F.min("u_start").alias("first"))


def j16_ranges(spark, sf):
    """Pairs of nations whose orders fall within the years 1995 and 1996."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    r = o.groupBy("c_nationkey", "o_orderpriority").agg(F.min(F.year("o_orderdate")).alias("first"), F.max(F.year("o_orderdate")).alias("last"))
    return r.where("last >= 1995 AND first <= 1996").select("c_nationkey", "o_orderpriority", "first", "last")


def c01_needles(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.explode(cast.needles(F.col("p_brand"), F.replace(F.col("p_name"), F.lit(" "), F.lit("，")))).alias("needle"))


def c11_upsert(spark, sf):
    """Incoming names matched with parts by their own name or an alias, the first part counts."""
    p = table(spark, sf, "part")
    known = p.select(F.col("p_partkey").alias("id"), F.explode(F.array(F.lower(F.trim("p_name")), F.lower(F.concat_ws(" ", "p_brand", "p_size")))).alias("k")).groupBy("k").agg(F.min("id").alias("id"))
    inc = p.select(F.col("p_partkey").alias("rid"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat_ws(" ", F.upper("p_brand"), F.col("p_size") + 1)).alias("name"))
    return inc.join(known, F.lower(F.trim("name")) == F.col("k"), "left").select("rid", F.coalesce("id", F.col("rid") + 1000000).alias("id"), F.col("id").isNull().alias("made"))


def c12_fields(spark, sf):
    """Fields of a part and its newer ones: those it has stay, others are added."""
    have = F.array(F.struct(F.lit("brand").alias("label"), F.col("p_brand").alias("value")), F.struct(F.lit("Size").alias("label"), F.col("p_size").cast("string").alias("value")))
    new = F.array(F.struct(F.lit("size").alias("label"), F.lit("?").alias("value")), F.struct(F.lit("type").alias("label"), F.col("p_type").alias("value")))
    labels = F.transform(have, lambda h: F.lower(h["label"]))
    merged = F.concat(have, F.filter(new, lambda x: ~F.array_contains(labels, F.lower(x["label"]))))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(merged, lambda x: F.concat_ws("=", x["label"], x["value"])), ";").alias("fields"))


def c20_numbered(spark, sf):
    """Turns as numbered answers, parsed back: lines without a number belong to the one before."""
    t = table(spark, sf, "conversations")
    answers = records.listed(t, ["conv_id"], F.col("turn"), F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.col("text")), "\n", "answer")
    lines = answers.select("conv_id", F.posexplode(F.split("answer", "\n")).alias("pos", "line"))
    own = F.nullif(F.regexp_extract("line", r"^\s*([0-9]{1,4})[.、)．:]\s*", 1), F.lit("")).cast("long")
    lines = lines.withColumn("number", F.last(own, True).over(Window.partitionBy("conv_id").orderBy("pos"))).where("number IS NOT NULL")
    rest = X.trim(F.regexp_replace("line", r"^\s*[0-9]{1,4}[.、)．:]\s*", ""))
    out = records.listed(lines.withColumn("rest", rest).where("rest <> ''"), ["conv_id", "number"], F.col("pos"), F.col("rest"), " ", "text")
    return out.select("conv_id", "number", F.sha2("text", 256).alias("sha"))


def c21_seed(spark, sf):
    """Names that are not among the first twenty yet."""
    return _names(spark, sf, 50).join(_names(spark, sf, 20), ["lang", "name"], "left_anti")


def c22_new_units(spark, sf):
    """Sentences that have no unit of their span yet; those at even offsets have one."""
    own = spans.sentences(table(spark, sf, "documents")).select("doc_id", "start", "end")
    return own.join(own.where("start % 2 = 0"), ["doc_id", "start", "end"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def c24_resplit(spark, sf):
    """Units by lines reconciled with sentences: kept, removed and added for each document."""
    old = _lines(spark, sf).where("length(text) > 0").select("doc_id", "start", "end", F.lit(1).alias("o"))
    new = spans.sentences(table(spark, sf, "documents")).select("doc_id", "start", "end", F.lit(1).alias("n"))
    both = old.join(new, ["doc_id", "start", "end"], "full")
    return both.groupBy("doc_id").agg(F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("kept"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("o").isNull()).alias("added"))


def c29_backs(spark, sf):
    """Each user's event types in the order they first came."""
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return records.listed(first, ["user_id"], F.col("f"), F.col("event_type"), " / ", "backs")


def c30_budget(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.least(F.lit(12), F.greatest(F.lit(3), X.half_up(F.length("text") / 2500))).cast("long").alias("cards"))


def c32_import(spark, sf):
    """Cards of parts: one of each key, without those of small parts, which are known."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", X.card_key(F.col("p_name")).alias("key"))
    one = p.groupBy("key").agg(F.min("p_partkey").alias("p_partkey"), F.count(F.lit(1)).alias("n"))
    return one.join(p.where("p_size <= 2").select("key").distinct(), "key", "left_anti")


def e05_copies(spark, sf):
    """What the parts of the smallest size are copies of."""
    small = table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("id"))
    pairs = resolve.like_pairs(_books(spark, sf)).select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("x"), "likeness")
    return pairs.select("x.id", "x.other", "likeness").join(small, "id")


def e15_ceiling(spark, sf):
    """The newest hundred orders a priority stay in the index."""
    return records.top(table(spark, sf, "orders"), ["o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 100).select("o_orderpriority", "o_orderkey", "place")


def e18_prefixes(spark, sf):
    """Beginnings of nations' names that stand for one nation only."""
    n = table(spark, sf, "nation")
    p = n.select("n_nationkey", F.explode(F.transform(F.sequence(F.lit(1), F.length("n_name")), lambda i: F.substring(F.lower("n_name"), F.lit(1), i))).alias("prefix"))
    return p.groupBy("prefix").agg(F.count(F.lit(1)).alias("k"), F.min("n_nationkey").alias("n_nationkey")).where("k = 1").select("prefix", "n_nationkey")


def q17_deck(spark, sf):
    """Every customer with the state of the study of orders, fresh ones with the state at the start."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("reps"), F.max("o_orderdate").alias("last"))
    c = table(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("reps", F.lit(0).cast("long")).alias("reps"), F.when(F.col("reps").isNull(), 2.5).otherwise(2.6).alias("ease"), F.col("last").isNull().alias("fresh"))


def i04_relabels(spark, sf):
    """Documents of which every third is in Han signs, whatever its language was said to be."""
    text = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "etaoin", "的一是不了人")).otherwise(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", "lang", X.detect_language(text).alias("found"))
    return d.where(X.script_of(F.col("lang")) != X.script_of(F.col("found"))).select("doc_id", "found")


def i05_notes(spark, sf):
    """Turns as notes: one of each text but for white space, without those that the first ten conversations have."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.regexp_replace("text", r"\s+", ""), 256).alias("key"))
    one = t.where("conv_id >= 10").groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("x"))
    return one.join(t.where("conv_id < 10").select("key"), "key", "left_anti").select("x.conv_id", "x.turn")


def i06_undo(spark, sf):
    """Customers after an import that set balances to zero is undone by what was saved of it."""
    c = table(spark, sf, "customer")
    was = c.where("c_custkey % 4 = 0").select("c_custkey", F.col("c_acctbal").alias("was"))
    now = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("bal"))
    return now.join(was, "c_custkey", "left").select("c_custkey", F.coalesce("was", "bal").alias("bal"))


def i07_restore(spark, sf):
    """Documents of two sources by their natural key: already there, or waiting."""
    key = F.concat(X.canonical_hash(F.col("text")), F.lit("::"), F.lower(F.substring("text", 1, 20)))
    d = table(spark, sf, "documents").select("doc_id", "source", key.alias("k"))
    have = d.where("source <> 'src0'").select("k").distinct().withColumn("have", F.lit(True))
    rows = d.where("source = 'src0'").join(have, "k", "left")
    return rows.groupBy("source").agg(F.count_if(F.col("have")).alias("duplicates"), F.count_if(F.col("have").isNull()).alias("waiting"))


def i09_copies(spark, sf):
    kind = F.when(F.col("o_comment_") % 3 == 0, "daily").when(F.col("o_comment_") % 3 == 1, "base").otherwise("full")
    o = table(spark, sf, "orders").withColumn("o_comment_", F.col("o_orderkey"))
    return o.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("newest"), F.round(F.sum("o_totalprice"), 2).alias("bytes"))


def i10_pending(spark, sf):
    """Held annotations that apply to documents with the text they were made for: how many, and the first."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    held = d.where("doc_id % 2 = 0").groupBy("h").agg(F.count(F.lit(1)).alias("held"), F.min("doc_id").alias("first"))
    return d.where("doc_id % 2 = 1").join(held, "h").select("doc_id", "held", "first")


def i12_scene_units(spark, sf):
    return _bodies(spark, sf).select("doc_id", "idx", F.length(F.substring("body", 1, 5000)).cast("long").alias("n"), F.ceil(F.length("body") / 5000).cast("long").alias("units"))


def i14_notes(spark, sf):
    """Lines with a name in them as notes by chapter; free ones count under -1."""
    lines = _lines(spark, sf).select("doc_id", F.col("start").alias("at"), F.contains("text", F.lit("The")).alias("named")).where("named OR at % 7 = 0")
    hit = spans.points_in(lines.where("named"), _chapters(spark, sf), "at").select("doc_id", "at", "idx")
    rows = lines.join(hit, ["doc_id", "at"], "left").withColumn("idx", F.coalesce("idx", F.lit(-1).cast("long")))
    return rows.groupBy("doc_id", "idx").agg(F.count(F.lit(1)).alias("n"))


def i15_books(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"))


def i16_shelf_search(spark, sf):
    """Every part ranked for "re" by name, brand and type; misses are left out."""
    p = table(spark, sf, "part")
    best = F.least(resolve.rank(0, F.col("p_name"), "re"), resolve.rank(1, F.col("p_brand"), "re"), resolve.rank(5, F.col("p_type"), "re"))
    return p.select("p_partkey", best.alias("rank")).where("rank IS NOT NULL")


def i18_suppress(spark, sf):
    """Names and brands of large parts that no small part bears."""
    p = table(spark, sf, "part").select("p_size", X.title_key(F.concat("p_name", F.lit(" "), "p_brand")).alias("k"))
    return p.where("p_size > 25").join(p.where("p_size <= 25").select("k"), "k", "left_anti").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def i21_seen(spark, sf):
    """Candidates seen as catalog rows, their facts as JSON, the newest three a brand."""
    p = records.top(table(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.desc("p_partkey")], 3)
    return p.select("p_brand", "p_partkey", F.to_json(F.struct("p_name", "p_size")).alias("payload"), "place")


def x01_titles(spark, sf):
    """Titles of chapters for export: numbers where the first line is long; a repeated one is dropped from the text."""
    lines = _lines(spark, sf).where("pos % 5 = 0")
    title = F.when(F.length(X.trim(F.col("text"))).between(1, 60), X.trim(F.col("text"))).otherwise((F.floor(F.col("pos") / 5) + 1).cast("string"))
    return lines.select("doc_id", F.floor(F.col("pos") / 5).alias("idx"), title.alias("title"))


def x06_annotations(spark, sf):
    """Marks as lines of a CSV file in order, with their chapters."""
    lines = _lines(spark, sf).where("length(text) > 40").select("doc_id", F.col("start").alias("at"), F.substring("text", 1, 30).alias("quote"))
    hit = spans.points_in(lines, _chapters(spark, sf), "at").withColumn("place", _n("doc_id", ["at"]))
    return hit.select("doc_id", "place", F.concat_ws(",", F.col("idx").cast("string"), X.csv_cell(F.col("quote"))).alias("line"))


def x07_bible(spark, sf):
    """Each language's names with where they first and last occur, as Markdown."""
    found = cast.mentions(_bodies(spark, sf), _names(spark, sf, 10), "lang")
    rows = found.groupBy("lang", "name").agg(F.sum("count").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    line = F.concat(F.lit("- **"), F.col("name"), F.lit("** "), F.concat_ws(" ", F.col("n").cast("string"), F.col("first").cast("string"), F.col("last").cast("string")))
    return records.listed(rows, ["lang"], F.col("name"), line, "\n", "md")


def x10_bilingual(spark, sf):
    """Each document's sentences with what was made of them, edited before machine text, or nothing."""
    u = _units(table(spark, sf, "documents")).withColumn("edited", F.when(F.col("stale"), F.concat(F.lit("*"), F.col("text"))))
    out = records.listed(u, ["doc_id"], F.col("start"), F.concat(F.col("text"), F.lit("\n"), F.coalesce("edited", "machine", F.lit(""))), "\n\n", "md")
    return out.select("doc_id", F.sha2("md", 256).alias("sha"))


def x13_quotes(spark, sf):
    """The first line of every document as a quote with its source."""
    return _lines(spark, sf).where("pos = 0").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select("doc_id", F.concat(F.lit("> "), X.squeeze(F.col("text")), F.lit("\n> — "), F.col("source")).alias("md"))


def x16_remap_ids(spark, sf):
    """Order lines of suppliers merged by tens into the first of each ten."""
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") - F.col("s_suppkey") % 10).alias("to"))
    return table(spark, sf, "lineitem").join(ids, "l_suppkey").groupBy("to").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("orders"))


def x17_trash(spark, sf):
    """Events thrown away on the 30th of January 2024: what is older than thirty days by the 25th of February goes."""
    e = table(spark, sf, "events").withColumn("gone", F.col("ts") < F.lit("2024-01-26").cast("timestamp_ntz"))
    return e.groupBy("event_type").agg(F.count_if(F.col("gone")).alias("expired"), F.count_if(~F.col("gone")).alias("kept"))


def w01_claim(spark, sf):
    """The next open order of each priority, its tries counted up."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'O'")
    best = o.groupBy("o_orderpriority").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("x"), F.count(F.lit(1)).alias("waiting"))
    return best.select("o_orderpriority", "x.o_orderkey", "waiting")


def w04_requeue(spark, sf):
    """Interrupted orders, status P, waiting again."""
    state = F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("requeued"))


def w06_changes(spark, sf):
    """How far each user's log has come: what a reader keeps as its offset."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("token"), F.count(F.lit(1)).alias("n"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[0] in "tdjceqixw" and name[1:3].isdigit()}

_AKEY = r"array_to_string(list_sort(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')), ' ')"
_CKEY = r"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}\s]+', ' ', 'g'), '^\s*(the|a|an)\s+', ''), '\s+', ' ', 'g')), '([a-z]{2}[^s])s$', '\1')"
_RE = lambda f, v: f"CASE WHEN instr(lower({v}), 're') = 0 THEN NULL WHEN instr(lower({v}), 're') = 1 THEN {f * 3} WHEN regexp_matches(substr({v}, instr(lower({v}), 're') - 1, 1), '[\\s\\p{{P}}]') THEN {f * 3 + 1} ELSE {f * 3 + 2} END"
ORACLE_SQL = {
    "t08_languages": """WITH t AS (SELECT doc_id, lower(CASE WHEN doc_id % 5 = 0 THEN 'zh' || substr(g, 3) ELSE g END) AS g FROM (SELECT doc_id, lang || CASE WHEN doc_id % 3 = 0 THEN '-TW' WHEN doc_id % 3 = 1 THEN '_CN' ELSE '' END AS g FROM documents))
      SELECT doc_id, CASE WHEN NOT starts_with(g, 'zh') THEN string_split_regex(g, '[-_]')[1] WHEN regexp_matches(g, 'hant|tw|hk|mo') THEN 'zh-Hant' ELSE 'zh-Hans' END AS language FROM t""",
    "t13_same_author": f"""WITH c AS (SELECT c_custkey, c_nationkey AS n, regexp_replace(c_name, 'Customer#0+', 'No ') AS a FROM customer), s AS (SELECT s_suppkey, s_nationkey AS n, regexp_replace(s_name, 'Supplier#0+', 'no, ') AS b FROM supplier)
      SELECT c_custkey, s_suppkey FROM c JOIN s USING (n) WHERE contains({_AKEY.format('a')}, {_AKEY.format('b')}) OR contains({_AKEY.format('b')}, {_AKEY.format('a')})""",
    "t16_patterns": "SELECT p_partkey, p_brand || '%|% ' || p_brand || '%' AS patterns, '%' || array_to_string(string_split(p_brand, ''), '%') || '%' AS loose FROM part",
    "t19_digests": "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, hex(encode(substr(text, 1, 16))) AS hex FROM documents",
    "t24_bundle_dates": "SELECT o_orderkey, 'library-' || strftime(o_orderdate, '%Y-%m-%d') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '.zip' AS name, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    "t25_titles": "SELECT p_partkey, p_name AS title, CASE WHEN p_size > 20 THEN p_type || ' #' || p_size END AS series FROM part",
    "t26_kinds": "SELECT p_type, CASE WHEN regexp_matches(lower(p_type), 'brass|steel') THEN 'reference' WHEN regexp_matches(lower(p_type), 'copper|tin') THEN 'poetry' ELSE 'novel' END AS kind, count(*) AS n FROM part GROUP BY p_type",
    "t27_ties": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'mentor' WHEN 'assistant' THEN 'student' END AS tie, CASE role WHEN 'user' THEN 'student' WHEN 'assistant' THEN 'mentor' END AS opposite, CASE WHEN role IN ('user', 'assistant') THEN 'power' END AS family FROM conversations",
    "t38_images": "SELECT page_id, 'page ' || page_id AS alt, url AS src FROM pages",
    "t39_stars": "SELECT c_custkey, CASE WHEN floor(c_acctbal / 2000) BETWEEN 1 AND 5 THEN CAST(floor(c_acctbal / 2000) AS INTEGER) END AS stars, CASE WHEN c_acctbal < 0 THEN 'wishlist' WHEN c_acctbal < 3000 THEN 'reading' ELSE 'read' END AS status FROM customer",
    "d06_captions": f"""WITH {_P}, t AS (SELECT doc_id, substr(text, 1, 30) || '. Chapter ' || (doc_id % 40) AS t FROM lines WHERE pos = 1) SELECT doc_id, CASE WHEN regexp_extract(t, '(?i)[.!?”"’]\\s+((?:chapter|book|part)\\s+(?:[0-9]+|[ivxlcdm]+)\\.?)$', 1) <> '' THEN regexp_extract(t, '(?i)[.!?”"’]\\s+((?:chapter|book|part)\\s+(?:[0-9]+|[ivxlcdm]+)\\.?)$', 1) ELSE t END AS title FROM t""",
    "d14_split_points": f"WITH {_P}, {_sents()} SELECT s.doc_id, s.start, sha256(substr(t, 1, 60)) AS preview, EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = s.doc_id AND l.start = s.start) AS paragraph FROM sents s",
    "d17_previews": f"WITH {_P}, k AS (SELECT doc_id, start, {sql_trim('text')} AS t, pos FROM lines), r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, start, t FROM k WHERE t <> '') SELECT doc_id, i, start AS \"offset\", substr(t, 1, 90) AS preview FROM r WHERE i < 120",
    "d19_tiles": f"""WITH {_P}, {_C}, a AS (SELECT DISTINCT c.doc_id, c.idx, c.start, c."end" AS ce, l.start AS x FROM lines l JOIN chapters c ON c.doc_id = l.doc_id AND l.start >= c.start AND l.start < c."end" WHERE l.pos % 3 = 1),
      r AS (SELECT doc_id, idx, CASE WHEN row_number() OVER w = 1 THEN start ELSE x END AS s, coalesce(lead(x) OVER w, ce) AS e FROM a WINDOW w AS (PARTITION BY doc_id, idx ORDER BY x)) SELECT doc_id, idx, s, e FROM r WHERE e > s""",
    "d21_layout": f"WITH {_P}, t AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 0 THEN (pos // 5 + 1) || '. ' || text ELSE text END AS t FROM lines) SELECT doc_id, pos, nullif(regexp_extract(t, '^(•|◦|[0-9]{{1,3}}[.)])[ \\t]+', 1), '') AS marker, length(regexp_replace(t, '^(•|◦|[0-9]{{1,3}}[.)])[ \\t]+', '')) AS n FROM t",
    "d22_bodies": f"WITH {_P}, r AS (SELECT doc_id, pos // 5 AS idx, pos, text, row_number() OVER (PARTITION BY doc_id, pos // 5 ORDER BY pos) AS i FROM lines WHERE trim(text) <> '') SELECT doc_id, idx, sha256(substr(string_agg(i || ': ' || text, chr(10) ORDER BY pos), 1, 12000)) AS sha FROM r GROUP BY doc_id, idx",
    "d23_context": f"WITH {_B}, b AS (SELECT doc_id, idx, {sql_squeeze('body')} AS t FROM bodies), k AS (SELECT doc_id, idx, CASE WHEN length(t) > 220 THEN rtrim(substr(t, 1, 220)) || '…' ELSE t END AS t FROM b) SELECT doc_id, idx, sha256(coalesce(array_to_string(list(t) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), chr(10)), '')) AS sha FROM k",
    "j02_references": f"WITH {_P}, {_S} SELECT s.doc_id, s.start AS \"at\", (pos // 5 + 1) || ':' || (pos % 5 + 1) AS ref FROM sents s JOIN lines l ON l.doc_id = s.doc_id AND s.start >= l.start AND s.start < l.start + length(l.text)",
    "j03_counts": f"WITH {_S} SELECT doc_id, count(*) AS n FROM sents JOIN documents USING (doc_id) WHERE start >= n_chars / 4 AND start < n_chars / 2 GROUP BY doc_id",
    "j04_refile": f"""WITH {_P}, {_C} SELECT l.doc_id, pos, coalesce(c.idx, pos // 4) AS idx, c.idx IS NOT NULL AND c.idx <> pos // 4 AS moved FROM lines l LEFT JOIN chapters c ON c.doc_id = l.doc_id AND l.start + 1 >= c.start AND l.start + 1 < c."end\"""",
    "j07_quotes": f"""WITH {_P}, {_C}, q AS (SELECT doc_id, idx, start + ("end" - start) // 3 AS a, "end" - ("end" - start) // 3 AS b FROM chapters)
      SELECT q.doc_id, idx, sha256(string_agg((pos + 1) || ' ' || substr(text, greatest(start, a) - start + 1, least(start + length(text), b) - greatest(start, a)), chr(10) ORDER BY pos)) AS sha FROM q JOIN lines l ON l.doc_id = q.doc_id AND b > l.start AND a < l.start + length(text) WHERE length(text) > 0 AND b > a GROUP BY q.doc_id, idx""",
    "j14_layout": f"""WITH {_P}, {_S}, o AS (SELECT s.doc_id, s.start + 9 AS a, s."end" + 9 AS b, pos, least(s."end" + 9, l.start + length(l.text)) - greatest(s.start + 9, l.start) AS n FROM sents s JOIN lines l ON l.doc_id = s.doc_id AND s."end" + 9 > l.start AND s.start + 9 < l.start + length(l.text)),
      k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, a ORDER BY n DESC, pos) = 1) SELECT doc_id, pos, count(*) AS n, count(*) FILTER (WHERE n = b - a) AS whole, min(a) AS first FROM k GROUP BY doc_id, pos""",
    "j16_ranges": "SELECT c_nationkey, o_orderpriority, CAST(min(year(o_orderdate)) AS INTEGER) AS first, CAST(max(year(o_orderdate)) AS INTEGER) AS last FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING max(year(o_orderdate)) >= 1995 AND min(year(o_orderdate)) <= 1996",
    "c01_needles": "SELECT p_partkey, needle FROM (SELECT p_partkey, unnest(list_concat([p_brand], string_split(p_name, ' '))) AS needle FROM part) WHERE length(needle) > 1",
    "c11_upsert": """WITH k AS (SELECT k, min(id) AS id FROM (SELECT p_partkey AS id, lower(trim(p_name)) AS k FROM part UNION ALL SELECT p_partkey, lower(p_brand || ' ' || p_size) FROM part) GROUP BY k),
      i AS (SELECT p_partkey AS rid, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE upper(p_brand) || ' ' || (p_size + 1) END AS name FROM part) SELECT rid, coalesce(id, rid + 1000000) AS id, id IS NULL AS made FROM i LEFT JOIN k ON k.k = lower(trim(name))""",
    "c12_fields": "SELECT p_partkey, 'brand=' || p_brand || ';Size=' || p_size || ';type=' || p_type AS fields FROM part",
    "c20_numbered": f"SELECT conv_id, turn + 1 AS number, sha256({sql_trim('regexp_replace(text, ' + chr(39) + '[ ]*' + chr(39) + ' || chr(10) || ' + chr(39) + '+[ ]*' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}) AS sha FROM conversations WHERE trim(text) <> ''",
    "c21_seed": f"WITH {_N} SELECT lang, source AS name FROM terms WHERE rank BETWEEN 21 AND 50",
    "c22_new_units": f"WITH {_S} SELECT doc_id, count(*) AS n FROM sents WHERE start % 2 <> 0 GROUP BY doc_id",
    "c24_resplit": f"""WITH {_P}, {_S}, o AS (SELECT doc_id, start, start + length(text) AS e FROM lines WHERE length(text) > 0) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, count(*) FILTER (WHERE o.doc_id IS NOT NULL AND n.doc_id IS NOT NULL) AS kept, count(*) FILTER (WHERE n.doc_id IS NULL) AS removed, count(*) FILTER (WHERE o.doc_id IS NULL) AS added
      FROM o FULL JOIN sents n ON o.doc_id = n.doc_id AND o.start = n.start AND o.e = n."end" GROUP BY 1""",
    "c29_backs": "SELECT user_id, string_agg(event_type, ' / ' ORDER BY f, i) AS backs FROM (SELECT user_id, event_type, min(ts) AS f, arg_min(event_id, ts) AS i FROM events GROUP BY ALL) GROUP BY user_id",
    "c30_budget": "SELECT doc_id, least(12, greatest(3, CAST(floor(length(text) / CAST(2500 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT))) AS cards FROM documents",
    "c32_import": f"WITH k AS (SELECT p_partkey, p_size, {_CKEY} AS key FROM part) SELECT key, min(p_partkey) AS p_partkey, count(*) AS n FROM k GROUP BY key HAVING count(*) FILTER (WHERE p_size <= 2) = 0",
    "e05_copies": f"WITH {_PAIRS}, d AS (SELECT a AS id, b AS other, likeness FROM pairs UNION ALL SELECT b, a, likeness FROM pairs) SELECT id, other, likeness FROM d JOIN part ON p_partkey = id WHERE p_size = 1",
    "e15_ceiling": "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 100",
    "e18_prefixes": "SELECT prefix, min(n_nationkey) AS n_nationkey FROM (SELECT n_nationkey, n, substr(n, 1, i) AS prefix FROM (SELECT n_nationkey, lower(n_name) AS n, unnest(range(1, length(n_name) + 1)) AS i FROM nation)) GROUP BY prefix HAVING count(*) = 1",
    "q17_deck": "SELECT c_custkey, count(o_orderkey) AS reps, CASE WHEN count(o_orderkey) = 0 THEN CAST(2.5 AS DOUBLE) ELSE CAST(2.6 AS DOUBLE) END AS ease, count(o_orderkey) = 0 AS fresh FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "i04_relabels": "WITH t AS (SELECT doc_id, lang, substr(CASE WHEN doc_id % 3 = 0 THEN translate(text, 'etaoin', '的一是不了人') ELSE text END, 1, 20000) AS t FROM documents) SELECT doc_id, 'zh-Hans' AS found FROM t WHERE (length(t) - length(regexp_replace(t, '" + X.CJK + "', '', 'g'))) / greatest(1, length(t)) > 0.15 AND lang NOT IN ('zh', 'ja')",
    "i05_notes": "WITH t AS (SELECT conv_id, turn, regexp_replace(text, '\\s+', '', 'g') AS k FROM conversations) SELECT conv_id, turn FROM t WHERE conv_id >= 10 AND k NOT IN (SELECT k FROM t WHERE conv_id < 10) QUALIFY row_number() OVER (PARTITION BY k ORDER BY conv_id, turn) = 1",
    "i06_undo": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal WHEN c_custkey % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal END AS bal FROM customer",
    "i07_restore": f"WITH d AS (SELECT source, {sql_squeeze('text')} || '::' || lower(substr(text, 1, 20)) AS k FROM documents) SELECT source, count(*) FILTER (WHERE k IN (SELECT k FROM d WHERE source <> 'src0')) AS duplicates, count(*) FILTER (WHERE k NOT IN (SELECT k FROM d WHERE source <> 'src0')) AS waiting FROM d WHERE source = 'src0' GROUP BY source",
    "i09_copies": "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'base' ELSE 'full' END AS kind, count(*) AS n, max(o_orderdate) AS newest, round(sum(o_totalprice), 2) AS bytes FROM orders GROUP BY 1",
    "i10_pending": "SELECT a.doc_id, count(*) AS held, min(b.doc_id) AS first FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id % 2 = 1 AND b.doc_id % 2 = 0 GROUP BY a.doc_id",
    "i12_scene_units": f"WITH {_B} SELECT doc_id, idx, length(substr(body, 1, 5000)) AS n, CAST(ceil(length(body) / CAST(5000 AS DOUBLE)) AS BIGINT) AS units FROM bodies",
    "i14_notes": f"""WITH {_P}, {_C}, l AS (SELECT doc_id, start, contains(text, 'The') AS named FROM lines WHERE contains(text, 'The') OR start % 7 = 0) SELECT l.doc_id, coalesce(c.idx, -1) AS idx, count(*) AS n FROM l LEFT JOIN chapters c ON named AND c.doc_id = l.doc_id AND l.start >= c.start AND l.start < c."end" GROUP BY ALL""",
    "i15_books": "SELECT o_custkey, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey",
    "i16_shelf_search": f"SELECT p_partkey, rank FROM (SELECT p_partkey, least({_RE(0, 'p_name')}, {_RE(1, 'p_brand')}, {_RE(5, 'p_type')}) AS rank FROM part) WHERE rank IS NOT NULL",
    "i18_suppress": r"WITH k AS (SELECT p_size, regexp_replace(lower(p_name || p_brand), '[^\p{L}\p{N}]+', '', 'g') AS k FROM part) SELECT k, count(*) AS n FROM k WHERE p_size > 25 AND k NOT IN (SELECT k FROM k WHERE p_size <= 25) GROUP BY k",
    "i21_seen": """SELECT p_brand, p_partkey, '{"p_name":"' || p_name || '","p_size":' || p_size || '}' AS payload, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS place FROM part QUALIFY place <= 3""",
    "x01_titles": f"WITH {_P} SELECT doc_id, pos // 5 AS idx, CASE WHEN length({sql_trim('text')}) BETWEEN 1 AND 60 THEN {sql_trim('text')} ELSE CAST(pos // 5 + 1 AS VARCHAR) END AS title FROM lines WHERE pos % 5 = 0",
    "x06_annotations": f"""WITH {_P}, {_C}, q AS (SELECT c.doc_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY l.start) AS place, idx, substr(text, 1, 30) AS q FROM lines l JOIN chapters c ON c.doc_id = l.doc_id AND l.start >= c.start AND l.start < c."end" WHERE length(text) > 40)
      SELECT doc_id, place, idx || ',' || CASE WHEN regexp_matches(q, '[",\\n]') THEN '"' || replace(q, '"', '""') || '"' ELSE q END AS line FROM q""",
    "x07_bible": f"""WITH {_N}, {_B}, m AS (SELECT b.lang, doc_id, source AS name, (length(body) - length(replace(body, source, ''))) // length(source) AS c FROM bodies b JOIN terms t ON t.lang = b.lang AND t.rank <= 10 WHERE contains(body, source)),
      g AS (SELECT lang, name, CAST(sum(c) AS BIGINT) AS n, min(doc_id) AS f, max(doc_id) AS l FROM m GROUP BY ALL) SELECT lang, string_agg('- **' || name || '** ' || n || ' ' || f || ' ' || l, chr(10) ORDER BY name) AS md FROM g GROUP BY lang""",
    "x10_bilingual": f"WITH {_sents()}, u AS ({_U}) SELECT doc_id, sha256(string_agg(text || chr(10) || coalesce(CASE WHEN stale THEN '*' || text END, machine, ''), chr(10) || chr(10) ORDER BY start)) AS sha FROM u GROUP BY doc_id",
    "x13_quotes": f"WITH lines AS ({SQL_PARAGRAPHS}) SELECT l.doc_id, '> ' || {sql_squeeze('l.text')} || chr(10) || '> — ' || source AS md FROM lines l JOIN documents d ON d.doc_id = l.doc_id WHERE pos = 0",
    "x16_remap_ids": 'SELECT l_suppkey - l_suppkey % 10 AS "to", count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1',
    "x17_trash": "SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-26') AS expired, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-26') AS kept FROM events GROUP BY event_type",
    "w01_claim": "SELECT o_orderpriority, o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS waiting FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1",
    "w04_requeue": "SELECT CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS state, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS requeued FROM orders GROUP BY 1",
    "w06_changes": "SELECT user_id, max(event_id) AS token, count(*) AS n FROM events GROUP BY user_id",
}
