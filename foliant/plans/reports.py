"""Relational reports over the star schema, the event log, documents and conversations.

A customer stands for a book, orders for its chapters, order lines for observations, parts for entities.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import records, spans
from foliant.plans.common import SQL_PARAGRAPHS, table
from foliant.sources import files


def q01_shelf(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "last")


def q02_evidence(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.join(table(spark, sf, "documents"), "doc_id", "left").select("doc_id", F.sha2(F.substring(F.coalesce("text", F.lit("")), 1, 2000), 256).alias("sha"))


def q03_parts(spark, sf):
    o = table(spark, sf, "orders")
    g = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    high = o.where("o_totalprice > 300000").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("high"))
    return g.join(high, ["o_orderstatus", "o_orderpriority"], "left")


def q04_entities(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") < 10).alias("small"), F.min(F.lower("p_name")).alias("first"))


def q05_cast(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "l_linenumber", "p_name", "p_type")


def q06_terms(spark, sf):
    """Parts that are noted as large or occur in an order line of fifty."""
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    hit = li.where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(True))
    return p.join(hit, "p_partkey", "left").where("p_size >= 45 OR hit").select("p_partkey", "p_size", F.coalesce("hit", F.lit(False)).alias("hit"))


def q07_company(spark, sf):
    """Suppliers that share an order with those of nation 3, by how many."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    own = li.join(table(spark, sf, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey").withColumnRenamed("l_suppkey", "a")
    return own.join(li.withColumnRenamed("l_suppkey", "b"), "l_orderkey").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def q08_scenes_at(spark, sf):
    o = table(spark, sf, "orders")
    at = table(spark, sf, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    mean = o.agg(F.round(F.avg("o_totalprice"), 2)).scalar()
    return o.join(at, "o_custkey", "left_semi").select("o_orderkey", F.round("o_totalprice", 2).alias("price"), mean.alias("mean"))


def q09_recent(spark, sf):
    """The twenty newest error events with their user's event count."""
    e = table(spark, sf, "events")
    first = e.where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "user_id")
    return first.join(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")


def q10_relations(spark, sf):
    """Relations between nations by orders: each order seen from its customer's and its supplier's side."""
    li, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    pairs = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey).where("c_nationkey <> s_nationkey")
    n = pairs.groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.explode(F.array(F.struct(F.col("a").alias("nation"), F.col("b").alias("other")), F.struct(F.col("b").alias("nation"), F.col("a").alias("other")))).alias("x"), "n").select("x.nation", "x.other", "n")


def q11_changed(spark, sf):
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("changed"))
    return last.where("changed >= TIMESTAMP '1998-01-01'").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "changed", (F.col("c_acctbal") > 5000).alias("heavy"))


def q12_counts(spark, sf):
    """Row counts of the library's tables in one row each."""
    out = None
    for t in ("customer", "orders", "lineitem", "part", "documents", "conversations"):
        one = table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def q13_excerpts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"), F.countDistinct("l_orderkey").alias("orders"))


def q14_targets(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.length("text") > 200, 1).otherwise(0)).alias("long"))


def q15_pending(spark, sf):
    return table(spark, sf, "lineitem").where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pending"))


def q16_study(spark, sf):
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("later"), F.max("o_orderdate").alias("last"))
    rows = c.join(o, c.c_custkey == o.o_custkey, "left")
    zero = F.lit(0).cast("long")
    return rows.select("c_custkey", F.coalesce("total", zero).alias("total"), (F.coalesce("total", zero) - F.coalesce("later", zero)).alias("due"), "last")


def q18_facets(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.expr("CAST(row_number() OVER (PARTITION BY substr(p_type, 1, 3) ORDER BY n DESC, p_type) AS BIGINT)"))


def q19_topics(spark, sf):
    """The parts' names of each order in one text, with the customer's segment."""
    li, p, o, c = (table(spark, sf, t) for t in ("lineitem", "part", "orders", "customer"))
    rows = li.join(p, li.l_partkey == p.p_partkey)
    names = records.listed(rows, ["l_orderkey"], F.struct("l_linenumber", "p_partkey"), F.col("p_name"), " · ", "names")
    return names.join(o, names.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey, "left").select("l_orderkey", "names", "c_mktsegment")


def q20_nearby(spark, sf):
    """Types of parts never sold with a discount of ten percent, and the most frequent of those."""
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    sold = li.where("l_discount >= 0.1").select(F.col("l_partkey").alias("p_partkey"))
    n = p.join(sold, "p_partkey", "left_anti").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "p_type").limit(24)


def q21_lists(spark, sf):
    n, c, r = (table(spark, sf, t) for t in ("nation", "customer", "region"))
    return n.join(r, n.n_regionkey == r.r_regionkey).join(c, c.c_nationkey == n.n_nationkey, "left").groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("n"))


def q22_tags(spark, sf):
    return records.listed(table(spark, sf, "nation"), ["n_regionkey"], F.col("n_name"), F.lower("n_name"), ",", "tags")


def q23_queue(spark, sf):
    o = table(spark, sf, "orders").withColumn("state", F.expr("CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"))
    return records.top(o, ["o_orderpriority"], [F.col("state"), F.col("o_orderdate"), F.col("o_orderkey")], 50).select("o_orderkey", "o_orderpriority", "state", "place")


def q24_metering(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(F.when(F.col("value") > 50, F.col("value")).otherwise(0.0)), 4).alias("large"))


def q25_timeline(spark, sf):
    """One event a user, type and minute: the first."""
    e = table(spark, sf, "events").withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return e.groupBy("user_id", "event_type", "minute").agg(F.min("event_id").alias("event_id"))


def q26_prune(spark, sf):
    """The newest thousand events of each type stay."""
    return records.top(table(spark, sf, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 1000).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"))


def q27_upsert(spark, sf):
    """The last event of each user and type as their state."""
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return records.newest(e, ["user_id", "event_type"], ["ts", "event_id"])


def q28_having(spark, sf):
    """Orders all of whose lines have one return flag, and that no line of supplier 1 is in."""
    li = table(spark, sf, "lineitem")
    one = li.groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("k"), F.count(F.lit(1)).alias("n"), F.count("l_returnflag").alias("m"), F.min("l_returnflag").alias("flag")).where("k = 1 AND n = m")
    return one.join(li.where("l_suppkey = 1").select("l_orderkey"), "l_orderkey", "left_anti").select("l_orderkey", "flag")


def q29_aggregated(spark, sf):
    return records.listed(table(spark, sf, "conversations"), ["conv_id"], F.col("turn"), F.col("role"), ">", "roles")


def q30_backfill(spark, sf):
    """Distinct trimmed names of a nation's customers with the first id of each."""
    return table(spark, sf, "customer").groupBy("c_nationkey", F.trim(F.substring("c_name", 1, 15)).alias("name")).agg(F.min("c_custkey").alias("id"))


def q31_merge_text(spark, sf):
    d = table(spark, sf, "events").select("event_id", F.when(F.col("props").rlike("[0-9]{2,}"), F.col("props")).alias("a"), F.when(F.col("value") > 30, F.col("event_type")).alias("b"))
    return d.select("event_id", F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(F.concat("a", F.lit("\n"), "b")).alias("text"))


def q32_changes(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max("ts").alias("changed_at"), F.max(F.when(F.col("event_type").isin("purchase", "signup"), F.col("ts"))).alias("content_at"))


def q33_prefix(spark, sf):
    return table(spark, sf, "customer").where(F.startswith(F.lower("c_name"), F.lit("customer#00000"))).select("c_custkey", "c_name")


def q34_reviewed(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice > 400000").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'read' WHEN 'O' THEN 'wishlist' ELSE 'reading' END").alias("shelf"))


def t32_json_rows(spark, sf):
    """Complete flat objects in the events' properties, read by their number."""
    e = table(spark, sf, "events").select("event_id", F.explode(F.regexp_extract_all("props", F.lit(r"(\{[^{}]*\})"), 1)).alias("j"))
    return e.select("event_id", F.from_json("j", "k BIGINT")["k"].alias("k"))


def i01_plan(spark, sf):
    """Incoming customers matched by id, or else by name and nation."""
    c = table(spark, sf, "customer")
    inc = c.select((F.col("c_custkey") + 700).alias("rid"), F.col("c_custkey").alias("source_id"), F.upper("c_name").alias("name"), "c_nationkey")
    own = c.select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("k"), F.col("c_nationkey").alias("nation"))
    by_id = inc.join(own.select("id"), F.col("rid") == F.col("id"), "left").withColumnRenamed("id", "first")
    return by_id.join(own, (F.lower("name") == F.col("k")) & (F.col("c_nationkey") == F.col("nation")), "left").select("rid", F.coalesce("first", "id").alias("id"))


def i02_fill(spark, sf):
    """Customers filled with newer ones: balances replace, segments only fill."""
    c = table(spark, sf, "customer")
    base = c.where("c_custkey % 3 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("seg"), F.col("c_acctbal").alias("bal"))
    inc = c.where("c_custkey % 3 <> 1").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.when(F.col("c_custkey") % 5 == 0, F.lit(0.0)).alias("bal"))
    return records.filled(base, inc, ["c_custkey"], ["seg"], ["bal"])


def i03_events(spark, sf):
    """Dates of an order line as events of their own."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = li.select("l_orderkey", "l_linenumber", F.explode(F.array(F.struct(F.lit("wishlist").alias("kind"), F.col("o_orderdate").alias("at")), F.struct(F.lit("read").alias("kind"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("at")))).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", "x.kind", "x.at").where("at IS NOT NULL").groupBy("kind", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def i08_verify(spark, sf):
    """Labelled documents whose text a copy lacks: the copy has no documents of source src3."""
    docs = table(spark, sf, "documents")
    return table(spark, sf, "labels").join(docs.where("source <> 'src3'"), "doc_id", "left_anti").join(docs.where("length(text) > 0").select("doc_id"), "doc_id", "left_semi").select("doc_id")


def i13_entries(spark, sf):
    """Customers, suppliers and parts as one list of entries with a fingerprint for each kind."""
    cols = lambda t, k, i, n: table(spark, sf, t).select(F.lit(k).alias("kind"), F.col(i).alias("id"), F.col(n).alias("name"))
    rows = cols("customer", "book", "c_custkey", "c_name").unionByName(cols("supplier", "place", "s_suppkey", "s_name")).unionByName(cols("part", "term", "p_partkey", "p_name"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"), F.sum(F.length("name")).alias("signs"))


def i17_shelves(spark, sf):
    return table(spark, sf, "orders").groupBy(F.expr("CASE o_orderstatus WHEN 'F' THEN 'read' WHEN 'O' THEN 'wishlist' ELSE 'reading' END").alias("shelf")).agg(F.count(F.lit(1)).alias("n"))


def i20_base64(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.base64(F.encode("p_name", "utf-8")).alias("b64"), (F.decode(F.unbase64(F.base64(F.encode("p_name", "utf-8"))), "utf-8") == F.col("p_name")).alias("same"))


def x02_text(spark, sf):
    """Each conversation as one Markdown text."""
    turns = table(spark, sf, "conversations")
    out = records.listed(turns, ["conv_id"], F.col("turn"), F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.col("text")), "\n\n", "md")
    return out.select("conv_id", F.length("md").cast("long").alias("n"), F.sha2("md", 256).alias("sha"))


def x03_html(spark, sf):
    lines = spans.paragraphs(table(spark, sf, "documents")).where("length(text) > 0")
    out = records.listed(lines, ["doc_id"], F.col("pos"), F.concat(F.lit("<p>"), X.escape_html(F.col("text")), F.lit("</p>")), "\n", "html")
    return out.select("doc_id", F.sha2("html", 256).alias("sha"))


def x11_screenplay(spark, sf):
    """Conversations as screenplay elements: system turns are action, the others a character and its dialogue."""
    turns = table(spark, sf, "conversations")
    kinds = F.when(F.col("role") == "system", F.array(F.struct(F.lit("action").alias("type"), F.col("text").alias("t")))).otherwise(F.array(F.struct(F.lit("character").alias("type"), F.upper("role").alias("t")), F.struct(F.lit("dialogue").alias("type"), F.col("text").alias("t"))))
    return turns.select("conv_id", "turn", F.posexplode(kinds).alias("i", "x")).select("conv_id", "turn", F.col("i").cast("long").alias("i"), "x.type", F.sha2("x.t", 256).alias("sha"))


def x12_csv(spark, sf):
    """Customers as lines of a library's list, with all its columns."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("chapters"), F.max("o_orderdate").alias("rated_at"), F.min("o_orderdate").alias("created_at"))
    c = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    books = c.select(
        "c_custkey", F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"')).alias("title"), F.lit(None).cast("string").alias("author"), F.sha2("c_name", 256).alias("source_hash"),
        F.lit(None).cast("string").alias("isbn"), F.col("c_nationkey").alias("year"), F.lower("c_mktsegment").alias("status"), F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey") % 5 + 1).alias("stars"),
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("two\r\nlines "), F.col("c_name"))).alias("review"), "rated_at", "created_at", F.array(F.lit("a"), F.col("c_mktsegment")).alias("tags"), F.lit("novel").alias("kind"),
        F.lit("en").alias("language"), F.length("c_name").alias("words"), F.coalesce("chapters", F.lit(0)).alias("chapters"), F.lit(0).alias("notes"), F.lit(None).cast("string").alias("summary"), F.lit("x,y").alias("source_name"),
    )
    return files.library_lines(books, "c_custkey")


def x15_chain(spark, sf):
    """Customers from a weekly base and a day's changes: balances are light, names heavy."""
    c = table(spark, sf, "customer")
    base = c.where("c_custkey % 11 <> 0").select("c_custkey", F.col("c_acctbal").alias("bal"), F.col("c_name").alias("name"))
    daily = c.where("c_custkey % 4 = 0").select("c_custkey", (F.col("c_custkey") % 8 == 0).alias("from_base"), F.lit(1.5).alias("bal"), F.concat(F.col("c_name"), F.lit("*")).alias("name"))
    present = c.where("c_custkey % 5 <> 0 AND (c_custkey % 11 <> 0 OR c_custkey % 4 = 0)")
    return records.chained(base, daily, present, "c_custkey", ["bal"], ["name"])


def x18_sweep(spark, sf):
    """Parts that no order line of a high discount names, as unreferenced files."""
    refs = table(spark, sf, "lineitem").where("l_discount >= 0.1").select(F.col("l_partkey").alias("p_partkey"))
    files = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("at"))
    return records.unreferenced(files, refs, "p_partkey", "at", 40)


def x19_changed(spark, sf):
    """Documents whose text has not been sent: every one but those with a label, which were sent as they are."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return records.changed(d, d.join(table(spark, sf, "labels").select("doc_id"), "doc_id"), "doc_id", "digest")


def w03_backoff(spark, sf):
    """The waits between the tries of failed jobs, users' errors in turn, five tries at most."""
    e = table(spark, sf, "events").where("event_type = 'error'")
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("errors"))
    return n.select("user_id", F.explode(F.sequence(F.lit(1), F.least(F.lit(4), F.col("errors").cast("int")))).alias("try")).select("user_id", F.col("try").cast("long").alias("try"), F.pow(F.lit(2.0), F.col("try")).cast("long").alias("wait_s"))


def w05_batches(spark, sf):
    """Jobs in batches of 200 for each priority."""
    o = records.numbered(table(spark, sf, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"])
    return o.groupBy("o_orderpriority", F.floor((F.col("n") - 1) / 200).alias("batch")).agg(F.count(F.lit(1)).alias("jobs"), F.min("o_orderkey").alias("first"))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] in "qixtw" and name[1:3].isdigit()}

_STATE = "CASE o_orderstatus WHEN 'F' THEN 'read' WHEN 'O' THEN 'wishlist' ELSE 'reading' END"
ORACLE_SQL = {
    "q01_shelf": "SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last FROM customer",
    "q02_evidence": "SELECT l.doc_id, sha256(substr(coalesce(text, ''), 1, 2000)) AS sha FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id",
    "q03_parts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, nullif(count(*) FILTER (WHERE o_totalprice > 300000), 0) AS high FROM orders GROUP BY ALL",
    "q04_entities": "SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size < 10) AS small, min(lower(p_name)) AS first FROM part GROUP BY p_brand",
    "q05_cast": "SELECT l_orderkey, l_linenumber, p_name, p_type FROM lineitem JOIN part ON p_partkey = l_partkey",
    "q06_terms": "SELECT p_partkey, p_size, hit FROM (SELECT *, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50) AS hit FROM part) WHERE p_size >= 45 OR hit",
    "q07_company": "WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS shared FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey <> y.l_suppkey JOIN supplier ON s_suppkey = x.l_suppkey AND s_nationkey = 3 GROUP BY ALL",
    "q08_scenes_at": "SELECT o_orderkey, round(o_totalprice, 2) AS price, (SELECT round(avg(o_totalprice), 2) FROM orders) AS mean FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)",
    "q09_recent": "SELECT event_id, f.user_id, (SELECT count(*) FROM events e WHERE e.user_id = f.user_id) AS n FROM (SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20) f",
    "q10_relations": "WITH p AS (SELECT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey) SELECT nation, other, count(*) AS n FROM (SELECT a AS nation, b AS other FROM p UNION ALL SELECT b, a FROM p) GROUP BY ALL",
    "q11_changed": "SELECT c_custkey, max(o_orderdate) AS changed, any_value(c_acctbal) > 5000 AS heavy FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING max(o_orderdate) >= TIMESTAMP '1998-01-01'",
    "q12_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem", "part", "documents", "conversations")),
    "q13_excerpts": "SELECT l_partkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_partkey",
    "q14_targets": "SELECT role, count(*) AS n, CAST(sum(CASE WHEN length(text) > 200 THEN 1 ELSE 0 END) AS BIGINT) AS long FROM conversations GROUP BY role",
    "q15_pending": "SELECT l_orderkey, count(*) AS pending FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey",
    "q16_study": "SELECT c_custkey, count(o_orderkey) AS total, count(o_orderkey) - count(*) FILTER (WHERE o_orderstatus = 'O') AS due, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "q18_facets": "SELECT p_type, count(*) AS n, row_number() OVER (PARTITION BY substr(p_type, 1, 3) ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY p_type",
    "q19_topics": "SELECT l_orderkey, string_agg(p_name, ' · ' ORDER BY l_linenumber, p_partkey) AS names, any_value(c_mktsegment) AS c_mktsegment FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY l_orderkey",
    "q20_nearby": "SELECT p_type, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount >= CAST(0.1 AS DOUBLE)) GROUP BY p_type ORDER BY n DESC, p_type LIMIT 24",
    "q21_lists": "SELECT r_name, n_name, count(c_custkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL",
    "q22_tags": "SELECT n_regionkey, string_agg(lower(n_name), ',' ORDER BY n_name) AS tags FROM nation GROUP BY n_regionkey",
    "q23_queue": "SELECT o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS state, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS place FROM orders QUALIFY place <= 50",
    "q24_metering": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(sum(CASE WHEN value > 50 THEN value ELSE CAST(0 AS DOUBLE) END), 4) AS large FROM events GROUP BY event_type",
    "q25_timeline": "SELECT user_id, event_type, date_trunc('minute', ts) AS minute, min(event_id) AS event_id FROM events GROUP BY ALL",
    "q26_prune": "SELECT event_type, count(*) AS n, min(ts) AS oldest FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000) GROUP BY event_type",
    "q27_upsert": "SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "q28_having": "SELECT l_orderkey, min(l_returnflag) AS flag FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_suppkey = 1) GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1 AND count(*) = count(l_returnflag)",
    "q29_aggregated": "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id",
    "q30_backfill": "SELECT c_nationkey, trim(substr(c_name, 1, 15)) AS name, min(c_custkey) AS id FROM customer GROUP BY ALL",
    "q31_merge_text": "SELECT event_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a || chr(10) || b END AS text FROM (SELECT event_id, CASE WHEN regexp_matches(props, '[0-9]{2,}') THEN props END AS a, CASE WHEN value > 30 THEN event_type END AS b FROM events)",
    "q32_changes": "SELECT user_id, max(ts) AS changed_at, max(ts) FILTER (WHERE event_type IN ('purchase', 'signup')) AS content_at FROM events GROUP BY user_id",
    "q33_prefix": "SELECT c_custkey, c_name FROM customer WHERE starts_with(lower(c_name), 'customer#00000')",
    "q34_reviewed": f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, {_STATE} AS shelf FROM orders WHERE o_totalprice > 400000",
    "t32_json_rows": "SELECT event_id, CAST(json_extract(j, '$.k') AS BIGINT) AS k FROM (SELECT event_id, unnest(regexp_extract_all(props, '\\{[^{}]*\\}')) AS j FROM events)",
    "i01_plan": "SELECT c.c_custkey + 700 AS rid, coalesce(a.c_custkey, b.c_custkey) AS id FROM customer c LEFT JOIN customer a ON a.c_custkey = c.c_custkey + 700 LEFT JOIN customer b ON lower(b.c_name) = lower(upper(c.c_name)) AND b.c_nationkey = c.c_nationkey",
    "i02_fill": """WITH b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS seg, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0), i AS (SELECT c_custkey AS k, c_mktsegment AS seg, CASE WHEN c_custkey % 5 = 0 THEN CAST(0 AS DOUBLE) END AS bal FROM customer WHERE c_custkey % 3 <> 1)
      SELECT coalesce(b.k, i.k) AS c_custkey, coalesce(b.seg, i.seg) AS seg, coalesce(i.bal, b.bal) AS bal, CASE WHEN b.k IS NULL THEN 'added' WHEN i.k IS NOT NULL AND (coalesce(b.seg, i.seg) IS DISTINCT FROM b.seg OR coalesce(i.bal, b.bal) IS DISTINCT FROM b.bal) THEN 'filled' ELSE 'untouched' END AS outcome FROM b FULL JOIN i ON b.k = i.k""",
    "i03_events": "SELECT kind, strftime(at_, '%Y-%m') AS month, count(*) AS n FROM (SELECT 'wishlist' AS kind, o_orderdate AS at_ FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'read', l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F') WHERE at_ IS NOT NULL GROUP BY ALL",
    "i08_verify": "SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3' AND length(text) > 0)",
    "i13_entries": "SELECT kind, count(*) AS n, min(name) AS first, CAST(sum(length(name)) AS BIGINT) AS signs FROM (SELECT 'book' AS kind, c_name AS name FROM customer UNION ALL SELECT 'place', s_name FROM supplier UNION ALL SELECT 'term', p_name FROM part) GROUP BY kind",
    "i17_shelves": f"SELECT {_STATE} AS shelf, count(*) AS n FROM orders GROUP BY 1",
    "i20_base64": "SELECT p_partkey, base64(encode(p_name)) AS b64, true AS same FROM part",
    "x02_text": "SELECT conv_id, length(md) AS n, sha256(md) AS sha FROM (SELECT conv_id, string_agg('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS md FROM conversations GROUP BY conv_id)",
    "x03_html": f"""WITH lines AS ({SQL_PARAGRAPHS}) SELECT doc_id, sha256(string_agg('<p>' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</p>', chr(10) ORDER BY pos)) AS sha FROM lines WHERE text <> '' GROUP BY doc_id""",
    "x11_screenplay": "SELECT conv_id, turn, CAST(0 AS BIGINT) AS i, CASE WHEN role = 'system' THEN 'action' ELSE 'character' END AS type, sha256(CASE WHEN role = 'system' THEN text ELSE upper(role) END) AS sha FROM conversations UNION ALL SELECT conv_id, turn, 1, 'dialogue', sha256(text) FROM conversations WHERE role <> 'system'",
    "x12_csv": """WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS r, min(o_orderdate) AS a FROM orders GROUP BY o_custkey)
      SELECT c_custkey, '"' || c_name || ', ""' || c_mktsegment || '""' || '",,' || sha256(c_name) || ',,' || c_nationkey || ',' || lower(c_mktsegment) || ',' || CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey % 5 + 1 ELSE 0 END || ',' || CASE WHEN c_nationkey % 2 = 0 THEN '"two' || chr(10) || 'lines ' || c_name || '"' ELSE '' END
        || ',' || coalesce(strftime(r, '%Y-%m-%d'), '') || ',' || coalesce(strftime(a, '%Y-%m-%d'), '') || ',"a, ' || c_mktsegment || '",novel,en,' || length(c_name) || ',' || coalesce(n, 0) || ',0,,"x,y"' AS line FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
    "x15_chain": """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CAST(1.5 AS DOUBLE) ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN c_name || '*' WHEN c_custkey % 11 <> 0 THEN c_name END AS name, c_custkey % 4 = 0 AS changed FROM customer WHERE c_custkey % 5 <> 0 AND (c_custkey % 11 <> 0 OR c_custkey % 4 = 0)""",
    "x18_sweep": "SELECT p_partkey, p_size AS at FROM part WHERE p_size < 40 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount >= CAST(0.1 AS DOUBLE))",
    "x19_changed": "SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "w03_backoff": 'WITH n AS (SELECT user_id, count(*) AS c FROM events WHERE event_type = \'error\' GROUP BY user_id), t AS (SELECT user_id, unnest(range(1, least(4, c) + 1)) AS k FROM n) SELECT user_id, k AS "try", CAST(2 ** k AS BIGINT) AS wait_s FROM t',
    "w05_batches": "SELECT o_orderpriority, (n - 1) // 200 AS batch, count(*) AS jobs, min(o_orderkey) AS first FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) GROUP BY ALL",
}
