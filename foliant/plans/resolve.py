"""Queries of entity resolution and search, over parts, suppliers, customers and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import resolve
from foliant.plans.common import sql_squeeze, table


def _books(spark, sf):
    """Parts as books: name, brand as author, no edition; those of an even size have a text."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.lit(None).cast("string").alias("edition"), (F.col("p_size") * 100000 + F.col("p_partkey")).alias("created"), (F.col("p_size") % 2 == 0).alias("has_text"))


def e01_blocks(spark, sf):
    sizes = resolve.blocks(resolve.keyed(_books(spark, sf))).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    return sizes


def e02_pairs(spark, sf):
    """Like titles within each brand."""
    return resolve.like_pairs(_books(spark, sf))


def e03_groups(spark, sf):
    books = _books(spark, sf)
    return resolve.duplicate_groups(books, resolve.like_pairs(books))


def e04_modes(spark, sf):
    """How many books each group would merge, and whether all of it can be done at once."""
    books = _books(spark, sf)
    rows = resolve.duplicate_groups(books, resolve.like_pairs(books)).join(books.select("id", "has_text"), "id")
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.bool_and(~F.col("near") & ~F.col("has_text")).alias("safe"), F.count_if(F.col("has_text")).alias("texts"))


def e06_shelf(spark, sf):
    """Suppliers' and customers' numbers as records looked up among the parts by id or by the name of another part."""
    part = table(spark, sf, "part")
    inc = part.select(F.col("p_partkey").alias("rid"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") + 1).alias("library_id"), F.upper("p_name").alias("title"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("author"))
    return resolve.shelf_match(inc, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author")))


def e07_merge(spark, sf):
    """One part for each name: the cheapest, then the first."""
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return resolve.merged_candidates(rows, X.title_key(F.col("p_name")), [F.col("p_retailprice"), F.col("p_partkey")])


def e09_pair_keys(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.concat_ws("|", F.least("l_partkey", "l_suppkey"), F.greatest("l_partkey", "l_suppkey")).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def e10_search(spark, sf):
    """Parts, suppliers and customers that hold "00", ranked by field and place, the first twelve of each kind."""
    needle = "00"
    part = table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.least(resolve.rank(0, F.col("p_name"), needle), resolve.rank(1, F.col("p_partkey").cast("string"), needle)).alias("rank"))
    supplier = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), resolve.rank(2, F.col("s_name"), needle).alias("rank"))
    customer = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), resolve.rank(3, F.col("c_name"), needle).alias("rank"))
    rows = part.unionByName(supplier).unionByName(customer).where("rank IS NOT NULL")
    return rows.withColumn("place", F.expr("CAST(row_number() OVER (PARTITION BY kind ORDER BY rank, id) AS BIGINT)")).where("place <= 12")


def e11_content(spark, sf):
    return resolve.hits(table(spark, sf, "documents"), "that", F.col("n_chars"))


def e12_snippets(spark, sf):
    docs = table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("that")))
    return docs.select("doc_id", resolve.snippet(F.col("text"), "that").alias("snippet"))


def e13_catalog(spark, sf):
    """Names found at a word's start before those found inside, forty at most for each brand."""
    p = table(spark, sf, "part")
    low = F.lower("p_name")
    tier = F.when(low.like("re%") | low.like("% re%"), 0).when(low.like("%re%"), 1).when(low.like("%r%e%"), 2)
    rows = p.select("p_brand", "p_partkey", tier.cast("int").alias("tier")).where("tier IS NOT NULL")
    return rows.withColumn("place", F.expr("CAST(row_number() OVER (PARTITION BY p_brand ORDER BY tier, p_partkey) AS BIGINT)")).where("place <= 40")


def e19_flags(spark, sf):
    """What is wrong with documents: one line only, no label, of low quality; the flags in a fixed order."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.contains("text", F.lit("\n")).alias("lines"))
    rows = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    flags = F.array_compact(F.array(F.when(~F.col("lines") & (F.col("n_chars") >= 200), "oneChapter"), F.when(F.col("quality").isNull(), "details"), F.when(F.col("quality") == 0, "cover")))
    return rows.select("doc_id", F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def l04_shingles(spark, sf):
    """The likeness of each document and the one of the id before it by pairs of words."""
    docs = table(spark, sf, "documents").select("doc_id", resolve.shingles(F.col("text")).alias("s"))
    rows = docs.join(docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("s").alias("prev")), "doc_id")
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.round(resolve.jaccard(F.col("s"), F.col("prev")), 9).alias("jaccard"))


def l06_identity(spark, sf):
    """Each document's version and how many share it."""
    d = table(spark, sf, "documents").select("doc_id", X.canonical_hash(F.col("text")).alias("v"))
    n = d.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return d.join(n, "v").select("doc_id", "n")


def l10_labels(spark, sf):
    """Versions of a customer's orders of a priority, v1 to vn by age, where there are two or more."""
    o = table(spark, sf, "orders")
    rows = o.selectExpr("o_custkey", "o_orderpriority", "o_orderkey", "row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS v", "count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n")
    return rows.where("n >= 2").select("o_orderkey", F.concat(F.lit("v"), F.col("v").cast("string")).alias("label"))


QUERIES = {f.__name__: f for f in (e01_blocks, e02_pairs, e03_groups, e04_modes, e06_shelf, e07_merge, e09_pair_keys, e10_search, e11_content, e12_snippets, e13_catalog, e19_flags, l04_shingles, l06_identity, l10_labels)}

_TK = r"regexp_replace(regexp_replace(lower({0}), '[(\[【][^)\]】]*[)\]】]\s*$', ''), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_K = f"""k AS (SELECT p_partkey AS id, p_brand AS author, p_size, {_TK.format('p_name')} AS key, {_TK.format("regexp_replace(p_name, '(?i)^[ ]*(the|a|an)[ ]+', '')")} AS loose,
  array_to_string(regexp_extract_all(lower(p_name), '[0-9]+|\\b[ivx]+\\b'), ',') AS vols FROM part)"""
_AK = r"array_to_string(list_sort(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')), ' ')"
_SAME = f"(contains({_AK.format('a.author')}, {_AK.format('b.author')}) OR contains({_AK.format('b.author')}, {_AK.format('a.author')}))"
_PAIRS = f"""{_K}, pr AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.key = b.key THEN 'same' WHEN a.vols = b.vols AND abs(length(a.loose) - length(b.loose)) <= 2
    AND (left(a.loose, 3) = left(b.loose, 3) OR right(a.loose, 3) = right(b.loose, 3)) AND levenshtein(a.loose, b.loose) <= CASE WHEN least(length(a.loose), length(b.loose)) < 5 THEN 0 WHEN least(length(a.loose), length(b.loose)) < 14 THEN 1 ELSE 2 END THEN 'near' END AS likeness
  FROM k a JOIN k b ON a.id < b.id AND {_SAME}),
hd AS (SELECT id, min(id) OVER (PARTITION BY key, loose, vols, author) AS head FROM k),
pairs AS (SELECT p.a, p.b, likeness FROM pr p JOIN hd x ON p.a = x.id JOIN hd y ON p.b = y.id WHERE likeness IS NOT NULL AND ((x.id = x.head AND y.id = y.head) OR x.head = y.head AND p.a = x.head))"""
_GROUPS = f"""{_PAIRS}, both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS s, b AS n FROM both_ UNION SELECT r.s, e.b FROM reach r JOIN both_ e ON r.n = e.a),
cp AS (SELECT s AS id, least(s, min(n)) AS grp FROM reach GROUP BY s), nr AS (SELECT grp, bool_or(likeness = 'near') AS near FROM pairs JOIN cp ON pairs.a = cp.id GROUP BY grp),
rows_ AS (SELECT cp.id, grp, p_size % 2 = 0 AS has_text, row_number() OVER (PARTITION BY grp ORDER BY p_size % 2, p_size * 100000 + p_partkey) AS r FROM cp JOIN part ON p_partkey = cp.id)"""
_RANK = lambda f, v: f"CASE WHEN instr(lower({v}), '00') = 0 THEN NULL WHEN instr(lower({v}), '00') = 1 THEN {f * 3} WHEN regexp_matches(substr({v}, instr(lower({v}), '00') - 1, 1), '[\\s\\p{{P}}]') THEN {f * 3 + 1} ELSE {f * 3 + 2} END"
_SH = r"""tk AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents), sh AS (SELECT doc_id, source, CASE WHEN len(t) = 1 THEN t ELSE list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) END AS s FROM tk)"""
ORACLE_SQL = {
    "e01_blocks": f"WITH {_K} SELECT block, count(*) AS n FROM (SELECT id, unnest(list_distinct(['t:' || key, 'm:' || key, 'p:' || left(loose, 3), 's:' || right(loose, 3)])) AS block FROM k) WHERE length(block) > 2 GROUP BY block",
    "e02_pairs": f"WITH {_PAIRS} SELECT a, b, likeness FROM pairs",
    "e03_groups": f'WITH RECURSIVE {_GROUPS} SELECT id, grp AS "group", near, r = 1 AS keeper FROM rows_ JOIN nr USING (grp)',
    "e04_modes": f'WITH RECURSIVE {_GROUPS} SELECT grp AS "group", count(*) AS n, bool_and(NOT near AND NOT has_text) AS safe, count(*) FILTER (WHERE has_text) AS texts FROM rows_ JOIN nr USING (grp) GROUP BY grp',
    "e06_shelf": f"""WITH i AS (SELECT p_partkey AS rid, CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 1 END AS lib, {_TK.format('upper(p_name)')} AS key, CASE WHEN p_size > 25 THEN p_brand END AS author FROM part),
      s AS (SELECT p_partkey AS id, {_TK.format('p_name')} AS k, p_brand AS author FROM part), h AS (SELECT rid, 1 AS how, id FROM i JOIN s ON lib = id UNION ALL SELECT rid, 2, id FROM i a JOIN s b ON a.key = b.k WHERE a.author IS NULL OR {_SAME})
      SELECT i.rid, x.id, coalesce(x.how, 0) AS how FROM i LEFT JOIN (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY rid ORDER BY how, id) = 1) x ON x.rid = i.rid""",
    "e07_merge": f"SELECT p_partkey, p_name, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY {_TK.format('p_name')} ORDER BY p_retailprice, p_partkey) = 1",
    "e09_pair_keys": "SELECT least(l_partkey, l_suppkey) || '|' || greatest(l_partkey, l_suppkey) AS pair, count(*) AS n FROM lineitem GROUP BY 1",
    "e10_search": f"""WITH r AS (SELECT 'part' AS kind, p_partkey AS id, least({_RANK(0, 'p_name')}, {_RANK(1, 'CAST(p_partkey AS VARCHAR)')}) AS rank FROM part UNION ALL SELECT 'supplier', s_suppkey, {_RANK(2, 's_name')} FROM supplier UNION ALL SELECT 'customer', c_custkey, {_RANK(3, 'c_name')} FROM customer)
      SELECT kind, id, rank, row_number() OVER (PARTITION BY kind ORDER BY rank, id) AS place FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY rank, id) <= 12""",
    "e11_content": f"""WITH h AS (SELECT doc_id, text, instr(lower(text), 'that') AS a FROM documents WHERE contains(lower(text), 'that') ORDER BY n_chars DESC, doc_id LIMIT 8),
      b AS (SELECT doc_id, text, a, instr(substr(lower(text), a + 4), 'that') AS r FROM h), p AS (SELECT doc_id, text, a - 1 AS off FROM b UNION ALL SELECT doc_id, text, a + 4 + r - 2 FROM b WHERE r > 0)
      SELECT doc_id, off AS "offset", {sql_squeeze("substr(text, greatest(0, off - 70) + 1, least(length(text), off + 74) - greatest(0, off - 70))")} AS excerpt FROM p""",
    "e12_snippets": f"SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || substr(f, a + 1, 120) AS snippet FROM (SELECT doc_id, f, greatest(0, instr(lower(f), 'that') - 31) AS a FROM (SELECT doc_id, {sql_squeeze('text')} AS f FROM documents WHERE contains(lower(text), 'that')))",
    "e13_catalog": """WITH t AS (SELECT p_brand, p_partkey, CASE WHEN lower(p_name) LIKE 're%' OR lower(p_name) LIKE '% re%' THEN 0 WHEN lower(p_name) LIKE '%re%' THEN 1 WHEN lower(p_name) LIKE '%r%e%' THEN 2 END AS tier FROM part)
      SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY tier, p_partkey) AS place FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY tier, p_partkey) <= 40""",
    "e19_flags": """WITH f AS (SELECT d.doc_id, unnest([CASE WHEN NOT contains(text, chr(10)) AND n_chars >= 200 THEN 'oneChapter' END, CASE WHEN quality IS NULL THEN 'details' END, CASE WHEN quality = 0 THEN 'cover' END]) AS flag FROM documents d LEFT JOIN labels USING (doc_id))
      SELECT flag, count(*) AS n, min(doc_id) AS first FROM f WHERE flag IS NOT NULL GROUP BY flag""",
    "l04_shingles": f"WITH {_SH}, j AS (SELECT x.doc_id, x.s, y.s AS q, len(list_intersect(x.s, y.s)) AS b FROM sh x JOIN sh y ON x.doc_id = y.doc_id + 1) SELECT doc_id, len(s) AS n, round(CASE WHEN len(s) + len(q) = 0 THEN 1 ELSE CAST(b AS DOUBLE) / greatest(1, len(s) + len(q) - b) END, 9) AS jaccard FROM j",
    "l06_identity": f"SELECT doc_id, count(*) OVER (PARTITION BY {sql_squeeze('text')}) AS n FROM documents",
    "l10_labels": "SELECT o_orderkey, 'v' || row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS label FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderpriority) >= 2",
}
