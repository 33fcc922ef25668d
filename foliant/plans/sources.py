"""Queries of the readers, over whole pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.text import decode_entities, strip_tags
from foliant.plans.common import table
from foliant.sources import html_tree, markup


def r09_slugs(spark, sf):
    blocks = markup.html_blocks(table(spark, sf, "pages")).where("level > 0")
    return markup.slugs(blocks, "page_id", "pos", "text").select("page_id", "pos", "slug")


def r10_blocks(spark, sf):
    return markup.html_blocks(table(spark, sf, "pages")).select("page_id", "pos", "level", F.sha2("text", 256).alias("sha"))


def r11_links(spark, sf):
    return markup.links(table(spark, sf, "pages"))


def r12_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.title_of(F.col("html")).alias("title"), F.length(decode_entities(strip_tags(F.col("html")))).cast("long").alias("n"))


def r28_urls(spark, sf):
    parts = table(spark, sf, "pages").select("page_id", markup.url_parts(F.col("url")).alias("u"))
    return parts.select("page_id", "u.host", "u.path", "u.query", "u.owner", "u.repo")


def r11_typed(spark, sf):
    """Pages by their elements; none of theirs leaves a mark, so the texts are those of the plain blocks."""
    rows = html_tree.typed_blocks(table(spark, sf, "pages"))
    return rows.select("page_id", "pos", "kind", F.col("level"), F.sha2("text", 256).alias("sha"))


def r11_lifted(spark, sf):
    """Orders as pages with a title, links, emphasis, a formula, a table with one in its cells, a listing, a list and a picture."""
    cell = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("</td><td><b>"), F.col("l_returnflag"), F.lit("</b> | <i>"), F.col("l_linestatus"), F.lit("</i><table><tr><td>in</td></tr></table></td></tr>"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", cell.alias("c")))), lambda x: x["c"]), "").alias("cells"))
    key, said = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    html = F.concat(
        *map(F.lit, ["<body><nav><p>menu</p></nav><h2 id=o"]), key, F.lit("><em>Order</em> "), key,
        F.lit("</h2><p><a name=x></a>Of <a href='https://example.org/"), key, F.lit("?a&amp;b'>the <b>"), said, F.lit("</b></a> &amp; <b>more <u>yet "), said,
        F.lit(" </u></b>, <code>x&lt;"), key, F.lit("</code><math display=block alttext='x_"), key, F.lit("'><mi>x</mi></math></p><table><tr><th colspan=2>All lines</th></tr><tr><th>no<th>flag</tr>"), F.col("cells"),
        F.lit("</table><pre><code class=language-SQL>\nSELECT "), key, F.lit("\n  AS k</code></pre><ul><li>in state <i>"), F.col("o_orderstatus"), F.lit("</i></li></ul><img alt='"), said, F.lit("' src='https://example.org/"), key, F.lit(".png'></body>"),
    )
    rows = html_tree.typed_blocks(table(spark, sf, "orders").join(lines, "o_orderkey").select("o_orderkey", html.alias("html")), "o_orderkey")
    links = F.array_join(F.transform("links", lambda x: F.concat(x["words"], F.lit(">"), x["href"])), " ")
    return rows.select("o_orderkey", "pos", "kind", "level", "text", "lang", "src", F.array_join("anchors", " ").alias("anchors"), links.alias("links"))


QUERIES = {f.__name__: f for f in (r09_slugs, r10_blocks, r11_links, r11_typed, r11_lifted, r12_titles, r28_urls)}

_ENT = {"lt": "<", "gt": ">", "quot": '"', "apos": "''", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’", "amp": "&"}


def _decode(x: str) -> str:
    for name, sign in _ENT.items():
        x = f"replace({x}, '&{name};', '{sign}')"
    return x


def _content() -> str:
    x = "regexp_replace(CASE WHEN regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) <> '' THEN regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) ELSE html END, '(?s)<!--.*?-->', '', 'g')"
    x = f"(SELECT CASE WHEN regexp_extract(b, '(?is)<article[^>]*>(.*)</article>', 1) <> '' THEN regexp_extract(b, '(?is)<article[^>]*>(.*)</article>', 1) ELSE b END FROM (SELECT {x} AS b))"
    for tag in markup.FURNITURE:
        x = f"regexp_replace({x}, '(?is)<{tag}([\\s/][^>]*)?>.*?</{tag}>', '', 'g')"
    return f"regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g')"


_BLOCKS = rf"""m AS (SELECT page_id, string_split(regexp_replace({_content()}, '(?i)</({markup.BLOCK_END})\s*>', chr(2) || '\1' || chr(1), 'g'), chr(1)) AS ps FROM pages),
p AS (SELECT page_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS pos FROM m),
t AS (SELECT page_id, pos, lower(CASE WHEN contains(piece, chr(2)) THEN split_part(piece, chr(2), 2) ELSE '' END) AS tag, split_part(piece, chr(2), 1) AS body FROM p),
c AS (SELECT page_id, pos, tag, regexp_replace(regexp_replace(trim(regexp_replace({_decode("regexp_replace(body, '<[^>]*>', '', 'g')")}, '[ \t\r\f\x0B]+', ' ', 'g')), '^[ \n]+', ''), '[ \n]+$', '') AS t FROM t),
blocks AS (SELECT page_id, pos, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN CAST(tag[2] AS INTEGER) ELSE 0 END AS level, CASE WHEN tag = 'li' THEN '• ' || t ELSE t END AS text FROM c WHERE t <> '')"""
ORACLE_SQL = {
    "r09_slugs": rf"""WITH {_BLOCKS}, s AS (SELECT page_id, pos, replace(regexp_replace(lower(trim(text)), '[^\p{{L}}\p{{N}} _-]', '', 'g'), ' ', '-') AS s FROM blocks WHERE level > 0),
      n AS (SELECT *, row_number() OVER (PARTITION BY page_id, s ORDER BY pos) - 1 AS n FROM s) SELECT page_id, pos, CASE WHEN n > 0 THEN s || '-' || n ELSE s END AS slug FROM n""",
    "r10_blocks": f"WITH {_BLOCKS} SELECT page_id, pos, level, sha256(text) AS sha FROM blocks",
    "r11_typed": f"""WITH {_BLOCKS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, CASE WHEN level > 0 THEN 'heading' WHEN starts_with(text, '• ') THEN 'item' ELSE 'text' END AS kind, level, sha256(text) AS sha FROM blocks""",
    "r11_lifted": r"""WITH l AS (
        SELECT l_orderkey, string_agg(chr(10) || '| ' || l_linenumber || ' | **' || l_returnflag || '** \| *' || l_linestatus || '* in |', '' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS cells FROM lineitem GROUP BY l_orderkey
      ), o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority AS p, o_orderstatus AS s, cells FROM orders JOIN l ON l_orderkey = o_orderkey)
      SELECT o_orderkey, CAST(0 AS BIGINT) AS pos, 'heading' AS kind, 2 AS level, 'Order ' || k AS text, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS src, 'o' || k AS anchors, '' AS links FROM o
      UNION ALL SELECT o_orderkey, 1, 'text', 0, 'Of the **' || p || '** & **more ++yet ' || p || '++** , `x<' || k || '`', NULL, NULL, 'x', 'the **' || p || '**>https://example.org/' || k || '?a&b' FROM o
      UNION ALL SELECT o_orderkey, 2, 'math', 0, 'x_' || k, NULL, NULL, '', '' FROM o
      UNION ALL SELECT o_orderkey, 3, 'text', 0, 'All lines', NULL, NULL, '', '' FROM o
      UNION ALL SELECT o_orderkey, 4, 'table', 0, '| no | flag |' || chr(10) || '| --- | --- |' || cells, NULL, NULL, '', '' FROM o
      UNION ALL SELECT o_orderkey, 5, 'code', 0, 'SELECT ' || k || chr(10) || '  AS k', 'sql', NULL, '', '' FROM o
      UNION ALL SELECT o_orderkey, 6, 'item', 0, '• in state *' || s || '*', NULL, NULL, '', '' FROM o
      UNION ALL SELECT o_orderkey, 7, 'image', 0, p, NULL, 'https://example.org/' || k || '.png', '', '' FROM o""",
    "r11_links": r"""SELECT page_id, generate_subscripts(hs, 1) - 1 AS pos, unnest(hs) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1) AS hs FROM pages)""",
    "r12_titles": f"SELECT page_id, trim({_decode(chr(39).join(['regexp_replace(regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1), ', '<[^>]*>', ', ', '', ', ', 'g', ')']))}) AS title, length({_decode(chr(39).join(['regexp_replace(html, ', '<[^>]*>', ', ', '', ', ', 'g', ')']))}) AS n FROM pages",
    "r28_urls": r"""SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, path, regexp_extract(url, '\?([^#]*)', 1) AS query, nullif(split_part(path, '/', 2), '') AS owner, regexp_replace(nullif(split_part(path, '/', 3), ''), '\.git$|\.html$', '') AS repo
      FROM (SELECT page_id, url, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)""",
}
