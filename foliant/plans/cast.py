"""Queries of cast, glossary and study operators. The names of a language are those its documents hold most."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.functions.text import WS
from foliant.operators import cast, graph, spans, structure
from foliant.plans.common import SQL_PARAGRAPHS, table

NOW = 1_706_000_000_000


def c17_terms(spark, sf):
    """The most frequent names of each language."""
    return cast.candidates(table(spark, sf, "documents"), "lang")


def _names(spark, sf, most=20):
    return cast.candidates(table(spark, sf, "documents"), "lang", most=most).select("lang", F.col("source").alias("name"))


def _bodies(spark, sf):
    """(lang, doc_id, idx, start, body) of chapters of five lines."""
    return structure.chapter_bodies(table(spark, sf, "documents").select("lang", "doc_id", "text"))


def _mentions(spark, sf):
    return cast.mentions(_bodies(spark, sf), _names(spark, sf), "lang")


def c02_mentions(spark, sf):
    return _mentions(spark, sf).select("doc_id", "idx", "name", "count")


def c03_timelines(spark, sf):
    return _mentions(spark, sf).groupBy("doc_id", "name").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("chapters"))


def c04_frequency(spark, sf):
    total = _mentions(spark, sf).groupBy("lang", "name").agg(F.sum("count").alias("total"))
    named = _names(spark, sf).join(total, ["lang", "name"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    return named.withColumn("rank", F.expr("CAST(row_number() OVER (PARTITION BY lang ORDER BY total DESC, name) AS BIGINT)"))


def c05_concordance(spark, sf):
    return cast.concordance(_bodies(spark, sf), _names(spark, sf, 5), "lang").select("name", "doc_id", "offset", F.sha2("quote", 256).alias("sha"), "rank")


def c06_bars(spark, sf):
    day = F.datediff("ts", F.lit("2024-01-01")).cast("long") * 24 + F.hour("ts")
    return cast.bars(table(spark, sf, "events").select("event_type", day.alias("h"), F.lit(1).cast("long").alias("n")), "event_type", "h", "n")


def c07_pairs(spark, sf):
    return cast.co_occurring(_mentions(spark, sf), ["doc_id"], "name", "idx")


def c09_circle(spark, sf):
    pairs = cast.co_occurring(_mentions(spark, sf), ["doc_id"], "name", "idx")
    return graph.circle(pairs.select("doc_id", "a", "b"), "doc_id", 320.0)


def _orders(spark, sf):
    """Customers as edges: those whose orders fall on one day and priority follow each other."""
    o = table(spark, sf, "orders")
    after = F.expr("lead(o_custkey) OVER (PARTITION BY o_orderdate, o_orderpriority ORDER BY o_orderkey)")
    return o.select(F.col("o_custkey").alias("a"), after.alias("b")).where("b IS NOT NULL AND a % 40 = b % 40 AND a <> b")


def c10_components(spark, sf):
    return graph.components(_orders(spark, sf))


def c10_reachable(spark, sf):
    start = table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("start"))
    return graph.reachable(_orders(spark, sf), start)


def c13_relations(spark, sf):
    """Suppliers and parts of one order line and another as relations recorded in either direction."""
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("from_id"), (F.col("l_partkey") % 50).alias("to_id"), F.col("l_linenumber").cast("long").alias("first"), (F.col("l_linenumber") + 2).cast("long").alias("last"), F.col("l_returnflag").alias("label"), (F.col("l_linestatus") == "F").alias("manual"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return cast.widened_relations(li.where("from_id <> to_id"), [])


def c15_subjects(spark, sf):
    """Users of two or more described events with them in one text."""
    e = table(spark, sf, "events").where("event_type IN ('error', 'signup') AND length(trim(props)) > 0")
    lines = F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.col("event_type"), F.lit(" / "), F.col("props")).alias("line"))))
    out = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), lines.alias("x")).where("n >= 2")
    return out.select("user_id", "n", F.sha2(F.array_join(F.transform("x", lambda s: s["line"]), "\n"), 256).alias("sha"))


def c18_terms_in(spark, sf):
    """The names of its language that a document holds."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return cast.mentions(docs, _names(spark, sf), "lang", "text").select("doc_id", "name")


def c19_memory(spark, sf):
    """The user's turns of a conversation that each answer is nearest to."""
    turns = table(spark, sf, "conversations")
    body = turns.where("role = 'assistant'").select("conv_id", "turn", "text")
    memory = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("m"), F.col("text").alias("source"))
    scored = body.join(memory, "conv_id").select("conv_id", "turn", "m", cast.memory_overlap(F.col("text"), F.col("source")).alias("score")).where("score > 0")
    return scored.withColumn("rank", F.expr("CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, m) AS BIGINT)")).where("rank <= 5")


def _units(docs, id_col="doc_id"):
    """Sentences as translation units: short ones have a machine text, each seventh is stale."""
    s = spans.sentences(docs, id_col)
    n = F.length("text")
    return s.select(id_col, F.floor(F.col("start") / 2000).alias("chapter"), "start", "text", F.when(n < 60, F.lower("text")).alias("machine"), (n % 7 == 0).alias("stale"))


def c23_pending(spark, sf):
    return cast.pending_spans(_units(table(spark, sf, "documents")), "doc_id")


def c25_stale(spark, sf):
    """Units that hold one of the names of the language go stale, too."""
    names = _names(spark, sf, 5).groupBy("lang").agg(F.collect_list("name").alias("names"))
    # five names a language go to every document, so that no text is dealt by its language
    docs = table(spark, sf, "documents").join(F.broadcast(names), "lang").select(F.struct("doc_id", "names").alias("doc"), "text")
    hit = F.exists("doc.names", lambda n: F.contains(F.col("text"), n))
    rows = _units(docs, "doc").select("doc.doc_id", "stale", hit.alias("hit"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("stale")).alias("before"), F.count_if(F.col("stale") | F.col("hit")).alias("after"))


def _cards(spark, sf):
    e = table(spark, sf, "events")
    return cast.schedules(e.select("user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), (F.col("value") > 20).alias("ok")), ["user_id", "event_type"])


def c26_schedules(spark, sf):
    """Events as answers: those of a value over 20 are right."""
    return _cards(spark, sf)


def c27_deck(spark, sf):
    return cast.deck(_cards(spark, sf), NOW, "user_id", "event_type").select("user_id", "event_type", "due_at", "rank")


def c27_next(spark, sf):
    return _cards(spark, sf).where(F.col("due_at") > NOW).groupBy("user_id").agg(F.min("due_at").alias("next_due"))


def c28_drafts(spark, sf):
    """Line openings as drafts of cards; those of a document's first chapter are known."""
    lines = spans.paragraphs(table(spark, sf, "documents")).select("doc_id", F.floor(F.col("pos") / 5).alias("chapter"), F.array_join(F.slice(F.split("text", " "), 1, 1), " ").alias("front"))
    known = lines.where("chapter = 0").select("doc_id", X.card_key(F.col("front")).alias("key"))
    return cast.draft_groups(lines.where("chapter > 0"), known, X.card_key(F.col("front")), "doc_id")


def c31_facets(spark, sf):
    """Tags of parts, the words of their types, with how many hold them."""
    tags = table(spark, sf, "part").select("p_brand", F.explode(F.array_distinct(F.split(F.lower("p_type"), " "))).alias("tag"))
    return tags.groupBy("p_brand", "tag").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (c02_mentions, c03_timelines, c04_frequency, c05_concordance, c06_bars, c07_pairs, c09_circle, c10_components, c10_reachable, c13_relations, c15_subjects, c17_terms, c18_terms_in, c19_memory, c23_pending, c25_stale, c26_schedules, c27_deck, c27_next, c28_drafts, c31_facets)}

_N = rf"""seen AS (SELECT lang, string_split(regexp_replace(text, '\b([A-Z][a-z]{{2,}}(?:{WS}+[A-Z][a-z]{{2,}})?)\b', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM documents),
ix AS (SELECT lang, p, unnest(range(2, len(p) + 1)) AS i FROM seen),
cap AS (SELECT lang, split_part(p[i], chr(2), 1) AS source, (i = 2 AND p[1] = '') OR regexp_matches(right(replace(p[i - 1], chr(2), ''), 3), '[.!?。！？\n]["''”’)\]]?{WS}*$') AS opens FROM ix),
cnt AS (SELECT lang, source, count(*) AS total, count(*) FILTER (WHERE NOT opens) AS mid FROM cap GROUP BY ALL),
terms AS (SELECT lang, source, total, row_number() OVER (PARTITION BY lang ORDER BY total DESC, source) AS rank FROM cnt WHERE mid > 0 AND total >= 3)"""
_B = f"""lines AS ({SQL_PARAGRAPHS}), ch AS (SELECT doc_id, pos // 5 AS idx, min(start) AS start, max(start + length(text)) AS e FROM lines GROUP BY ALL),
bodies AS (SELECT lang, doc_id, idx, start, substr(text, start + 1, e - start) AS body FROM ch JOIN documents USING (doc_id))"""
_M = """ment AS (SELECT b.lang, doc_id, idx, source AS name, CAST((length(body) - length(replace(body, source, ''))) // length(source) AS BIGINT) AS count
  FROM bodies b JOIN terms t ON t.lang = b.lang AND t.rank <= 20 WHERE contains(body, source))"""
_PAIRS = """prs AS (SELECT x.doc_id, x.name AS a, y.name AS b, count(*) AS shared, min(x.idx) AS first, max(x.idx) AS last FROM ment x JOIN ment y ON x.doc_id = y.doc_id AND x.idx = y.idx AND x.name < y.name GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY last - first DESC, a, b) AS rank FROM prs)"""
_EDGES = """ed AS (SELECT a, b FROM (SELECT o_custkey AS a, lead(o_custkey) OVER (PARTITION BY o_orderdate, o_orderpriority ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL AND a % 40 = b % 40 AND a <> b),
both_ AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach AS (SELECT a AS s, b AS n FROM both_ UNION SELECT r.s, e.b FROM reach r JOIN both_ e ON r.n = e.a)"""
_U = "SELECT doc_id, start // 2000 AS chapter, start, t AS text, CASE WHEN length(t) < 60 THEN lower(t) END AS machine, length(t) % 7 = 0 AS stale FROM sents"


def _sents() -> str:
    from foliant.plans.structure import _S

    return _S.replace(' FROM q WHERE', ", t FROM q WHERE")


_CARDS = """ev AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS at_, value > 20 AS ok, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
fold AS (SELECT user_id, event_type, i, CAST(CASE WHEN ok THEN 1 ELSE 0 END AS BIGINT) AS reps, CAST(CASE WHEN ok THEN 0 ELSE 1 END AS BIGINT) AS lapses, CASE WHEN ok THEN CAST(2.6 AS DOUBLE) ELSE CAST(2.3 AS DOUBLE) END AS ease, CAST(CASE WHEN ok THEN 1 ELSE 0 END AS BIGINT) AS days, at_ FROM ev WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_type, e.i, CASE WHEN ok THEN reps + 1 ELSE 0 END, CASE WHEN ok THEN lapses ELSE lapses + 1 END, CASE WHEN ok THEN least(CAST(2.8 AS DOUBLE), ease + CAST(0.1 AS DOUBLE)) ELSE greatest(CAST(1.3 AS DOUBLE), ease - CAST(0.2 AS DOUBLE)) END,
    CASE WHEN NOT ok THEN 0 WHEN reps = 0 THEN 1 WHEN reps = 1 THEN 6 ELSE greatest(1, CAST(floor(days * ease + CAST(0.5 AS DOUBLE)) AS BIGINT)) END, e.at_
  FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.i = f.i + 1),
cards AS (SELECT user_id, event_type, reps, lapses, round(ease, 6) AS ease, days AS interval_days, CASE WHEN reps > 0 THEN at_ + days * 86400000 ELSE at_ + 600000 END AS due_at, at_ AS last_at FROM fold QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY i DESC) = 1)"""
_CARDKEY = r"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(front), '[^\p{L}\p{N}\s]+', ' ', 'g'), '^\s*(the|a|an)\s+', ''), '\s+', ' ', 'g')), '([a-z]{2}[^s])s$', '\1')"
ORACLE_SQL = {
    "c17_terms": f"WITH {_N} SELECT lang, source, total, rank FROM terms WHERE rank <= 200",
    "c02_mentions": f"WITH {_N}, {_B}, {_M} SELECT doc_id, idx, name, count FROM ment",
    "c03_timelines": f"WITH {_N}, {_B}, {_M} SELECT doc_id, name, min(idx) AS first, max(idx) AS last, count(*) AS chapters FROM ment GROUP BY ALL",
    "c04_frequency": f"WITH {_N}, {_B}, {_M}, s AS (SELECT t.lang, source AS name, CAST(coalesce(sum(count), 0) AS BIGINT) AS total FROM terms t LEFT JOIN ment m ON m.lang = t.lang AND m.name = source WHERE rank <= 20 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY lang ORDER BY total DESC, name) AS rank FROM s",
    "c05_concordance": f"""WITH {_N}, {_B}, h AS (SELECT b.lang, doc_id, start, body, source AS name, string_split(body, source) AS ps FROM bodies b JOIN terms t ON t.lang = b.lang AND t.rank <= 5 WHERE contains(body, source)),
      k AS (SELECT *, unnest(range(1, len(ps))) AS i FROM h), f AS (SELECT *, list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * length(name) AS a FROM k),
      q AS (SELECT name, doc_id, start + a AS off, greatest(0, a - 42) AS lo, least(length(body), a + length(name) + 42) AS hi, body FROM f),
      r AS (SELECT name, doc_id, CAST(off AS BIGINT) AS "offset", sha256(CASE WHEN lo > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(body, CAST(lo AS BIGINT) + 1, CAST(hi - lo AS BIGINT)), '{WS}+', ' ', 'g')) || CASE WHEN hi < length(body) THEN '…' ELSE '' END) AS sha,
        row_number() OVER (PARTITION BY name, doc_id ORDER BY off) AS rank FROM q) SELECT * FROM r WHERE rank <= 12""",
    "c06_bars": """WITH h AS (SELECT event_type, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS h FROM events), n AS (SELECT event_type, max(h) + 1 AS n, greatest(1, CAST(ceil((max(h) + 1) / 60.0) AS BIGINT)) AS per FROM h GROUP BY event_type),
      g AS (SELECT event_type, per, unnest(range(0, CAST(ceil(n / CAST(per AS DOUBLE)) AS BIGINT))) AS bar FROM n) SELECT g.event_type, bar, count(h.h) AS total FROM g LEFT JOIN h ON h.event_type = g.event_type AND h.h // per = bar GROUP BY ALL""",
    "c07_pairs": f"WITH {_N}, {_B}, {_M}, {_PAIRS} SELECT * FROM top WHERE rank <= 120",
    "c09_circle": f"""WITH {_N}, {_B}, {_M}, {_PAIRS}, nd AS (SELECT doc_id, unnest([a, b]) AS node FROM top WHERE rank <= 120), dg AS (SELECT doc_id, node, count(*) AS degree FROM nd GROUP BY ALL),
      pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY degree DESC, node) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM dg)
      SELECT doc_id, node, degree, round(160 + 116 * cos(i / CAST(n AS DOUBLE) * 2 * pi() - pi() / 2), 6) AS x, round(160 + 116 * sin(i / CAST(n AS DOUBLE) * 2 * pi() - pi() / 2), 6) AS y FROM pl""",
    "c10_components": f"WITH RECURSIVE {_EDGES} SELECT s AS node, least(s, min(n)) AS root FROM reach GROUP BY s",
    "c10_reachable": f"WITH RECURSIVE {_EDGES} SELECT c_custkey AS start, coalesce(n, c_custkey) AS node FROM customer LEFT JOIN reach ON s = c_custkey WHERE c_nationkey = 3",
    "c13_relations": """WITH r AS (SELECT l_suppkey % 50 AS f, l_partkey % 50 AS t, l_linenumber AS n, l_returnflag AS label, l_linestatus = 'F' AS manual, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_suppkey % 50 <> l_partkey % 50)
      SELECT least(f, t) AS a, greatest(f, t) AS b, CAST(min(n) AS BIGINT) AS first, CAST(max(n) + 2 AS BIGINT) AS last, arg_max(CASE WHEN f > t THEN '~' || label ELSE label END, CAST(manual AS BIGINT) * 1000000000000 + seq) AS label FROM r GROUP BY 1, 2""",
    "c15_subjects": "SELECT user_id, count(*) AS n, sha256(string_agg(event_type || ' / ' || props, chr(10) ORDER BY event_id)) AS sha FROM events WHERE event_type IN ('error', 'signup') AND length(trim(props)) > 0 GROUP BY user_id HAVING count(*) >= 2",
    "c18_terms_in": f"WITH {_N} SELECT doc_id, t.source AS name FROM documents d JOIN terms t ON t.lang = d.lang AND rank <= 20 WHERE contains(text, t.source)",
    "c19_memory": """WITH s AS (SELECT a.conv_id, a.turn, u.turn AS m, len(list_filter(range(1, length(u.text) - 2, 4), lambda i: contains(a.text, substr(u.text, i, 4)))) AS score FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.role = 'user' WHERE a.role = 'assistant'),
      r AS (SELECT conv_id, turn, m, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, m) AS rank FROM s WHERE score > 0) SELECT * FROM r WHERE rank <= 5""",
    "c23_pending": f"WITH {_sents()}, u AS ({_U}), n AS (SELECT doc_id, chapter, start, (row_number() OVER (PARTITION BY doc_id, chapter ORDER BY start) - 1) // 25 AS chunk FROM u WHERE machine IS NULL OR stale) SELECT doc_id, chapter, chunk, count(*) AS n, min(start) AS first, max(start) AS last FROM n GROUP BY ALL",
    "c25_stale": f"WITH {_N}, {_sents()}, u AS ({_U}), g AS (SELECT lang, list(source) AS names FROM terms WHERE rank <= 5 GROUP BY lang) SELECT u.doc_id, count(*) FILTER (WHERE stale) AS before, count(*) FILTER (WHERE stale OR len(list_filter(names, lambda n: contains(u.text, n))) > 0) AS after FROM u JOIN documents d USING (doc_id) JOIN g USING (lang) GROUP BY u.doc_id",
    "c26_schedules": f"WITH RECURSIVE {_CARDS} SELECT * FROM cards",
    "c27_deck": f"WITH RECURSIVE {_CARDS} SELECT user_id, event_type, due_at, row_number() OVER (PARTITION BY user_id ORDER BY due_at, event_type) AS rank FROM cards WHERE due_at <= {NOW}",
    "c27_next": f"WITH RECURSIVE {_CARDS} SELECT user_id, min(due_at) AS next_due FROM cards WHERE due_at > {NOW} GROUP BY user_id",
    "c28_drafts": f"""WITH lines AS ({SQL_PARAGRAPHS}), l AS (SELECT doc_id, pos // 5 AS chapter, split_part(text, ' ', 1) AS front FROM lines), k AS (SELECT doc_id, chapter, {_CARDKEY} AS key FROM l)
      SELECT doc_id, key, count(*) AS n, count(DISTINCT chapter) AS chapters, count(DISTINCT chapter) > 1 AS repeated FROM k WHERE chapter > 0 AND key <> '' AND NOT EXISTS (SELECT 1 FROM k o WHERE o.doc_id = k.doc_id AND o.key = k.key AND o.chapter = 0) GROUP BY doc_id, key""",
    "c31_facets": "SELECT p_brand, tag, count(*) AS n FROM (SELECT p_brand, unnest(list_distinct(string_split(lower(p_type), ' '))) AS tag FROM part) GROUP BY ALL",
}
