"""The cast of documents and the words of a glossary: candidates, mentions, timelines, pairs, memory, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import BOUND, WS, half_up, occurrences, trim
from foliant.operators.spans import starts_of

NAME = rf"{BOUND}([A-Z][a-z]{{2,}}(?:{WS}+[A-Z][a-z]{{2,}})?){BOUND}"
OPENS = rf"[.!?。！？\n][\"'”’)\]]?{WS}*\z"
BARS, TOP_PAIRS, AROUND, MAX_QUOTES = 60, 120, 42, 12


def needles(name: Column, alias: Column) -> Column:
    """The names an entity is found by: its own and its aliases, two letters at least."""
    parts = F.concat(F.array(name), F.split(F.coalesce(alias, F.lit("")), "[,，、]"))
    return F.filter(F.transform(parts, trim), lambda x: F.length(x) > 1)


def capitalised(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, source, total, mid): capitalised words or pairs of words, and how often they don't open a sentence."""
    rows = docs.select(*keys, F.split(F.regexp_replace(F.col(text_col), NAME, "\x01$1\x02"), "\x01").alias("p"))

    def seen(i: Column) -> Column:
        before = F.replace(F.get("p", i - 1), F.lit("\x02"), F.lit(""))
        opens = (before == "") & (i == 1) | F.right(before, F.lit(3)).rlike(OPENS)
        return F.struct(F.substring_index(F.get("p", i), "\x02", 1).alias("source"), opens.alias("opens"))

    at = F.when(F.size("p") > 1, F.sequence(F.lit(1), F.size("p") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(*keys, F.explode(F.transform(at, seen)).alias("x")).select(*keys, "x.source", "x.opens")  # no place carries its text along
    return rows.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("total"), F.sum((~F.col("opens")).cast("long")).alias("mid"))


def candidates(docs: DataFrame, by: str, at_least: int = 3, most: int = 200) -> DataFrame:
    """(by, source, total, rank): names seen inside a sentence and often enough, the most frequent of each group."""
    seen = capitalised(docs, [by]).where((F.col("mid") > 0) & (F.col("total") >= at_least))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("total"), "source")).cast("long")
    return seen.select(by, "source", "total", rank.alias("rank")).where(F.col("rank") <= most)


def _with_names(chapters: DataFrame, names: DataFrame, by: str) -> DataFrame:
    """chapters with the array of their group's names: a row a group is sent to every task, each with as many names as were asked for."""
    return chapters.join(F.broadcast(names.groupBy(by).agg(F.array_sort(F.collect_set("name")).alias("names"))), by)


def mentions(chapters: DataFrame, names: DataFrame, by: str, body: str = "body") -> DataFrame:
    """(chapter columns, name, count) of the names of a chapter's group that occur in it, from the left without overlaps.

    A body is searched for all its names where it lies; only names and counts leave the row.
    """
    counted = F.transform(F.filter("names", lambda n: F.contains(F.col(body), n)), lambda n: F.struct(n.alias("name"), occurrences(F.col(body), n).alias("count")))
    cols = [c for c in chapters.columns if c != body]
    return _with_names(chapters, names, by).select(*cols, F.explode(counted).alias("x")).select(*cols, "x.name", "x.count").where("count > 0")


def concordance(chapters: DataFrame, names: DataFrame, by: str, id_col: str = "doc_id", most: int = MAX_QUOTES) -> DataFrame:
    """(by, name, doc, offset, quote, rank): the first places of each name in each document with what stands around them.

    chapters has (by, id, start, body). Quotes are cut where the body lies, as many of a chapter as a document can have.
    """
    body = F.col("body")
    own = _with_names(chapters, names, by).select(by, id_col, "start", "body", F.explode(F.filter("names", lambda n: F.contains(body, n))).alias("name"))
    size = F.length("name")
    parts = F.split("body", F.concat(F.lit("\\Q"), F.col("name"), F.lit("\\E")))
    places = F.slice(F.transform(F.slice(starts_of(parts, size), 2, F.size(parts)), lambda x: x - size), 1, most)

    def quoted(at: Column) -> Column:
        lo, hi = F.greatest(F.lit(0), at - AROUND), F.least(F.length(body), at + size + AROUND)
        cut = F.trim(F.regexp_replace(F.substring(body, lo.cast("int") + 1, (hi - lo).cast("int")), f"{WS}+", " "))
        quote = F.concat(F.when(lo > 0, "…").otherwise(""), cut, F.when(hi < F.length(body), "…").otherwise(""))
        return F.struct((F.col("start") + at).cast("long").alias("offset"), quote.alias("quote"))

    found = own.select(by, "name", id_col, F.explode(F.transform(places, quoted)).alias("x")).select(by, "name", id_col, "x.offset", "x.quote")
    rank = F.row_number().over(Window.partitionBy(by, "name", id_col).orderBy("offset")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def bars(points: DataFrame, by: str, idx: str, value: str, most: int = BARS) -> DataFrame:
    """(by, bar, total): values summed over at most so many bars of equal width; empty bars are kept."""
    size = points.groupBy(by).agg((F.max(idx) + 1).alias("__n"))
    size = size.withColumn("per", F.greatest(F.lit(1), F.ceil(F.col("__n") / most)).cast("long")).withColumn("bars", F.ceil(F.col("__n") / F.col("per")).cast("long"))
    sums = points.join(size, by).groupBy(by, F.floor(F.col(idx) / F.col("per")).alias("bar")).agg(F.sum(value).alias("total"))
    grid = size.select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("bars") - 1)).alias("bar"))
    return grid.join(sums, [by, "bar"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))


def co_occurring(found: DataFrame, by: list[str], name: str, chapter: str, most: int = TOP_PAIRS) -> DataFrame:
    """(by, a, b, shared, first, last, rank): names that share a chapter, those over the longest stretch first."""
    one = found.select(*by, chapter, F.col(name).alias("a")).distinct()
    pairs = one.join(one.withColumnRenamed("a", "b"), [*by, chapter]).where("a < b")
    pairs = pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min(chapter).alias("first"), F.max(chapter).alias("last"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col("last") - F.col("first")), "a", "b")).cast("long")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most)


def widened_relations(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, first, last, label) of edges recorded in either direction: one each, its range widened.

    rows has from_id, to_id, first, last, label, manual, seq. A label given by hand counts before others, then the newest;
    one that was recorded in the other direction is marked by a leading ~.
    """
    flipped = F.col("from_id") > F.col("to_id")
    label = F.when(flipped, F.concat(F.lit("~"), F.col("label"))).otherwise(F.col("label"))
    edges = rows.select(*by, F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"), "first", "last", F.struct("manual", "seq", label.alias("label")).alias("x"))
    return edges.groupBy(*by, "a", "b").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("x").alias("x")).withColumn("label", F.col("x.label")).drop("x")


def memory_overlap(body: Column, source: Column) -> Column:
    """How many of the source's runs of four characters, one after the other, occur in the body."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(source) - 3), F.lit(4))
    found = F.filter(at, lambda i: (F.length(source) >= 4) & F.contains(body, F.substring(source, i, F.lit(4))))
    return F.size(found).cast("long")


START_EASE, HARDEST, EASIEST = 2.5, 1.3, 2.8
DAY, AGAIN = 86_400_000, 600_000


def schedules(answers: DataFrame, by: list[str]) -> DataFrame:
    """(by, reps, lapses, ease, interval_days, due_at, last_at) after all answers (at in ms, seq, ok) in order.

    Right answers come again after 1, 6 and then the interval times the ease before the answer; wrong ones start anew.
    """
    zero = F.struct(F.lit(0).cast("long").alias("reps"), F.lit(0).cast("long").alias("lapses"), F.lit(START_EASE).alias("ease"), F.lit(0).cast("long").alias("days"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("due"))

    def step(s: Column, x: Column) -> Column:
        reps = s["reps"] + 1
        days = F.when(reps == 1, 1).when(reps == 2, 6).otherwise(F.greatest(F.lit(1).cast("long"), half_up(s["days"] * s["ease"]))).cast("long")
        right = F.struct(reps.alias("reps"), s["lapses"].alias("lapses"), F.least(F.lit(EASIEST), s["ease"] + 0.1).alias("ease"), days.alias("days"), x["at"].alias("at"), (x["at"] + days * DAY).alias("due"))
        wrong = F.struct(F.lit(0).cast("long").alias("reps"), (s["lapses"] + 1).alias("lapses"), F.greatest(F.lit(HARDEST), s["ease"] - 0.2).alias("ease"), F.lit(0).cast("long").alias("days"), x["at"].alias("at"), (x["at"] + AGAIN).alias("due"))
        return F.when(x["ok"], right).otherwise(wrong)

    folded = answers.groupBy(*by).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("at", "seq", "ok"))), zero, step).alias("s"))
    return folded.select(*by, "s.reps", "s.lapses", F.round("s.ease", 6).alias("ease"), F.col("s.days").alias("interval_days"), F.col("s.due").alias("due_at"), F.col("s.at").alias("last_at"))


def deck(cards: DataFrame, now: int, by: str, order: str) -> DataFrame:
    """The due cards of each deck with their rank: seen ones first, then by the time they are due."""
    w = Window.partitionBy(by).orderBy(F.col("last_at").isNull(), "due_at", order)
    return cards.where(F.col("due_at") <= now).withColumn("rank", F.row_number().over(w).cast("long"))


def draft_groups(drafts: DataFrame, known: DataFrame, key: Column, by: str) -> DataFrame:
    """(by, key, n, chapters, repeated): drafts of cards that are not known, grouped by key. known has (by, key)."""
    rows = drafts.withColumn("key", key).where("key <> ''").join(known.select(by, "key").distinct(), [by, "key"], "left_anti")
    out = rows.groupBy(by, "key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chapter").alias("chapters"))
    return out.withColumn("repeated", F.col("chapters") > 1)


def pending_spans(units: DataFrame, by: str, size: int = 25) -> DataFrame:
    """(by, chapter, chunk, n, first, last): units without a machine text, or stale ones, in chunks of a chapter."""
    open_ = units.where(F.col("machine").isNull() | F.col("stale"))
    n = F.row_number().over(Window.partitionBy(by, "chapter").orderBy("start"))
    rows = open_.withColumn("chunk", F.floor((n - 1) / size))
    return rows.groupBy(by, "chapter", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("start").alias("last"))
