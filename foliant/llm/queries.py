"""The thin queries of the training-data operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import chat, decontaminate, fim, language, license_scan, line_dedup, packing, pii, prefix_trie, simhash, syncmers, url_filters, warc
from foliant.plans.common import table as _table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's URL ends in the id of the document it was made of; that document's labels are the URL's."""
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    of = pages.select("url", F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT)").alias("doc_id"))
    labelled = of.join(labels, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filters.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict", "confidence", F.array_join("tokens", " ").alias("mined_rule"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    changed = F.col("keep_bitmap").isNotNull()
    digest = F.when(changed, line_dedup.kept_sha256(F.when(changed, F.col("text").cast("binary")), "keep_bitmap")).otherwise(F.sha2(F.coalesce("text", F.lit("")), 256))
    return out.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, lower_key, length(lower_key) AS n
  FROM (
    SELECT doc_id, pos, line,
           translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (
      SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    )
  )
), common AS (
  SELECT lower_key, min(doc_id) AS first_id FROM lines WHERE n >= 10 GROUP BY lower_key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.lower_key IS NOT NULL AND l.doc_id <> c.first_id AS gone
  FROM lines l LEFT JOIN common c ON l.lower_key = c.lower_key AND l.n >= 10
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


#: Marker words of user and assistant in the raw transcripts that op4 reads; the last style has no markers.
STYLES = (("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "System: "), ("### User\n", "### Assistant\n", "### System\n"), ("[user] ", "[assistant] ", "[system] "), ("", "", ""))


def _raw_transcripts(turns: DataFrame) -> DataFrame:
    """Conversations as raw text, their roles gone: a style by conversation, and a quarter of the markers left out."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    mark = F.lit("")
    for i, words in enumerate(STYLES):
        for role, word in zip(("user", "assistant", "system"), words):
            mark = F.when((style == i) & (F.col("role") == role), word).otherwise(mark)
    mark = F.when(F.pmod(F.xxhash64("turn", "conv_id"), F.lit(4)) == 0, "").otherwise(mark)
    return turns.select("conv_id", "turn", F.concat(mark, F.coalesce("text", F.lit(""))).alias("text"), "role")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns and roles of the raw transcripts' lines, by a model of three quarters of the conversations."""
    raw = _raw_transcripts(_table(spark, sf_dir, "conversations"))
    learned = raw.where(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 4 != 2)
    return chat.parse(raw.drop("role"), chat.fit(learned))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Every window of an item's size that starts at a shingle of an item of that size, or ends the text, compared shingle by shingle.
OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, w, len(w) AS n FROM (
    SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents)
), iw AS (
  SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM (
    SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ 	-
]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0
), ds AS (
  SELECT doc_id, n, k, p - 1 AS p, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, k, unnest(range(1, n - k + 2)) AS p FROM dw, (SELECT DISTINCT k FROM iw) WHERE n >= k)
), its AS (
  SELECT item_id, n, k, q - 1 AS q, array_to_string(w[q : q + k - 1], ' ') AS s
  FROM (SELECT item_id, w, n, k, unnest(range(1, n - k + 2)) AS q FROM iw)
), item_counts AS (SELECT item_id, n, k, s, count(*) AS c FROM its GROUP BY ALL),
laid AS (
  SELECT DISTINCT ds.doc_id, i.n, i.k, least(ds.p, greatest(0, ds.n - i.n)) AS start, ds.n AS len
  FROM ds JOIN (SELECT DISTINCT n, k, s FROM its) i ON ds.s = i.s AND ds.k = i.k
), own AS (
  SELECT l.doc_id, l.start, l.n, l.k, least(l.n, l.len) - l.k + 1 AS n_own, ds.s, count(*) AS c
  FROM laid l JOIN ds ON ds.doc_id = l.doc_id AND ds.k = l.k AND ds.p >= l.start AND ds.p <= l.start + l.n - l.k
  GROUP BY ALL
), both_ AS (
  SELECT o.doc_id, i.item_id, o.start, o.n_own, o.n - o.k + 1 AS n_item, sum(least(o.c, i.c)) AS b
  FROM own o JOIN item_counts i ON i.n = o.n AND i.k = o.k AND i.s = o.s
  GROUP BY ALL
), sims AS (
  SELECT doc_id, item_id, start, CAST(b AS DOUBLE) / CAST(n_own + n_item - b AS DOUBLE) AS similarity FROM both_
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM sims WHERE similarity >= 0.8
)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, similarity FROM ranked WHERE r = 1
"""


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents")).withColumn("base", pii.of_base_kinds(F.col("spans")))
    counts = [pii.count_of(F.col("base"), k).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_next(_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    files = warc.archive(spark, pages)
    return warc.read_records(warc.lookup(pages, files)).drop("url", "payload")


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM p GROUP BY ALL)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN g USING (payload_digest, payload_bytes)
"""


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        license_scan.labels(base).alias("base_labels"),
        license_scan.labels(F.col("spans")).alias("labels"),
        score.alias("score"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(_table(spark, sf_dir, "documents"), texts=False)


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT doc_id, t, n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d
  FROM d
), f AS (
  SELECT doc_id, t, n, least(a, b) AS a, greatest(a, b) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM s
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS output
  FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


#: CRC-32 bit by bit, whole prefixes as strings, and each node carried to all its ancestors.
OP13_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT *, left(sha256(CAST(length(role) AS VARCHAR) || ':' || role || ':' || text), 32) AS key, strlen(text) AS bytes FROM t
), p AS (
  SELECT conv_id, key, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS place FROM k
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)),
      CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS own, p.place, p.key, p.bytes FROM c JOIN p ON p.conv_id = c.base AND p.place <= c.h
  UNION ALL SELECT c.conv_id, 1, p.place, p.key, p.bytes FROM c JOIN p ON p.conv_id = c.conv_id AND p.place > c.h
), d AS (
  SELECT conv_id, bytes, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), m AS (
  SELECT conv_id, bytes, depth, min(conv_id) OVER g AS node, count(*) OVER g AS n_convs, max(depth) OVER (PARTITION BY conv_id) AS len
  FROM d WINDOW g AS (PARTITION BY depth, path)
), n AS (
  SELECT node, depth, max(n_convs) AS n_convs, max(bytes) * (max(n_convs) - 1) AS own_saved, max(len) = depth AS leaf,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256
  FROM m GROUP BY node, depth
), up AS (
  SELECT a.node, a.depth, CAST(sum(n.own_saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n.leaf) AS n_leaves, count(*) FILTER (WHERE n.depth = a.depth + 1) AS n_children
  FROM n JOIN m a ON a.conv_id = n.node AND a.depth <= n.depth GROUP BY a.node, a.depth
)
SELECT n.node AS conv_id, CAST(n.depth AS BIGINT) AS depth, q.node AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM n JOIN up ON up.node = n.node AND up.depth = n.depth LEFT JOIN m q ON q.conv_id = n.node AND q.depth = n.depth - 1
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_chat_format": op4_chat_format,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_language_id": op7_language_id,
    "op8_syncmers": op8_syncmers,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_warc": op10_warc,
    "op11_license_scan": op11_license_scan,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op5_decontamination": OP5_SQL, "op10_warc": OP10_SQL, "op12_fill_in_middle": OP12_SQL, "op13_prefix_trie": OP13_SQL}
