"""Operator 1: URL filters by association rules.

Labelled URLs become sets of tokens; Spark's FP-growth mines the combinations that are frequent among them, and those
that lead to a bad label with enough confidence become rules. A rule is dropped if the rule without one of its tokens is
as sure. Rules are kept in an inverted index: each under the rarest of its tokens, so that a URL meets only the rules
filed under a token of its own. Written-down host and path rules come first.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import written

#: Share of the labelled URLs that a bad combination must be in, and the share of its URLs that must be bad.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.5
#: So many URLs of the labelled ones' bad share are added to a combination's own: few URLs alone make none sure.
PRIOR_URLS = 4
BAD = "=bad"
ALLOW, BLOCK = "allow", "block"
#: (action, host and path): a written-down list.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, host suffixes, host labels, path words, file ending and query keys.

    Digits in path words and host labels count as one sign, so that numbered pages share a token.
    """
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    query = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("site:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = [
        F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"(?s)\A(.*?)://", 1)))),
        suffixes,
        F.transform(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("host:"), shape(x))),
        F.transform(F.filter(F.split(F.lower(path), r"[/._-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), shape(x))),
        F.transform(F.filter(F.transform(F.split(F.lower(query), "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1))), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), shape(x))),
    ]
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.array_distinct(F.concat(*parts))).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, prior_urls: float = PRIOR_URLS) -> DataFrame:
    """(rule, tokens, confidence, support, key, equal): from rows (url, bad); rows without a url or a label teach nothing.

    confidence is the share of the combination's URLs that are bad, with prior_urls more of the overall bad share.
    Only tokens that are themselves frequent in bad URLs can be in such a combination; the others are left out before
    the search. Of tokens that lie in exactly the same URLs one stands for all in the search, the widest site or else the
    shortest: one URL that fills a third of the rows doesn't multiply combinations. equal has, for each token of the
    rule, all that it stands for, itself first; with any one of each the combination has the same confidence and support.
    key is the rule's rarest token. Repeated rows count as often as they are there; without rows, or bad ones, there are
    no rules.
    """
    rows = labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull()).select(url_tokens(F.col("url")).alias("tokens"), F.col("bad").cast("boolean").alias("bad"))
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "labelled-urls")
    n, n_bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0))).first()
    marks = [F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(38,0)")).alias(f"mark{k}") for k in (1, 2)]
    tokens = rows.select("id", "bad", F.explode("tokens").alias("t")).groupBy("t").agg((F.count(F.lit(1)) / max(n, 1)).alias("share"), (F.sum(F.col("bad").cast("int")) / max(n, 1)).alias("bad_share"), *marks)
    tokens = written(tokens, "url-tokens")
    useful = tokens.where((F.col("bad_share") >= min_support) & (F.col("bad_share") > 0)).groupBy("share", "mark1", "mark2").agg(F.array_sort(F.collect_list(F.struct((~F.startswith("t", F.lit("site:"))).alias("inner"), F.length("t").alias("n"), "t"))).alias("x"))
    useful = written(useful.select(F.col("x.t")[0].alias("t"), F.col("x.t").alias("same")), "url-token-classes")
    kept = rows.select("id", "bad", F.explode("tokens").alias("t")).join(useful.select("t"), "t").groupBy("id", "bad").agg(F.collect_list("t").alias("items"))
    items = kept.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(written(items, "url-token-sets"))
    sets = written(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-frequent-sets")
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("n_bad"))
    sure = (F.col("n_bad") + prior_urls * n_bad / max(n, 1)) / (F.col("freq") + prior_urls)
    bad = written(bad.join(sets.withColumnRenamed("items", "tokens"), "tokens").select("tokens", sure.alias("confidence"), (F.col("n_bad") / max(n, 1)).alias("support")), "url-bad-sets")
    rules = bad.where(F.col("confidence") >= min_confidence).withColumn("rule", F.xxhash64("tokens"))
    parts = rules.where(F.size("tokens") > 1).select("rule", "confidence", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part"))
    as_sure = parts.join(bad.select(F.col("tokens").alias("part"), F.col("confidence").alias("of_part")), "part").where("of_part >= confidence")
    rules = written(rules.join(as_sure.select("rule").distinct(), "rule", "left_anti"), "url-rules")
    keys = rules.select("rule", F.explode("tokens").alias("t")).join(tokens, "t").groupBy("rule").agg(F.min(F.struct("share", "t")).alias("k"))
    equal = rules.select("rule", F.posexplode("tokens").alias("i", "t")).join(useful, "t").groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("i", "same"))).alias("e"))
    rules = rules.join(keys, "rule").join(equal, "rule")
    return written(rules.select("rule", "tokens", "confidence", "support", F.col("k.t").alias("key"), F.col("e.same").alias("equal")), "url-rule-index")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence, tokens) of each distinct url that a rule matches: the surest rule, then the last by its tokens.

    A url matches by any of the equal tokens for each of the rule's; tokens are the first of them that the url has. A rule
    is filed under every token equal to its key.
    """
    filed = rules.select(F.explode(F.flatten(F.filter("equal", lambda e: e[0] == F.col("key")))).alias("key"), "equal", "confidence")
    found = urls.select("url").distinct().withColumn("own", url_tokens(F.col("url"))).withColumn("key", F.explode("own"))
    found = found.join(filed, "key").where(F.forall("equal", lambda e: F.arrays_overlap(e, "own")))
    found = found.withColumn("tokens", F.transform("equal", lambda e: F.array_intersect(e, F.col("own"))[0]))
    best = found.groupBy("url").agg(F.max(F.struct("confidence", "tokens")).alias("x"))
    return best.select("url", "x.confidence", "x.tokens")


def listed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest written-down rule that fits: its host or a subdomain of it, and a path that starts with the rule's.

    For lists as people write them; a long list is better joined on the host's suffixes.
    """
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = F.endswith(F.concat(F.lit("."), host), F.lit("." + name)) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, prior_urls: float = PRIOR_URLS, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, confidence and tokens (of the mined rule), in place of columns of such names.

    labelled has (url, bad). verdict is that of the written-down rule or else block where a mined rule matches, allow
    where none does. A null url, or one without ://, has an empty host and path and matches no mined rule. Every row of
    pages is kept, repeated ones too; each distinct url is matched once.
    """
    mined = mine_rules(labelled, min_support, min_confidence, prior_urls)
    own = ["host", "path", "rule", "verdict", "confidence", "tokens"]
    base = pages.drop(*own)
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    base = base.withColumns({"host": host, "path": path}).withColumn("rule", listed_rule(F.col("host"), F.col("path"), rules))
    open_urls = base.where(F.col("rule").isNull() & F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"))
    hits = written(matched(open_urls, mined), "matched-urls")
    out = base.join(hits, base[url_col] == hits["url"], "left").select(*(base[c] for c in base.columns), hits["confidence"], hits["tokens"])
    actions = F.lit(None).cast("string")
    for action, rule in rules:
        actions = F.when(F.col("rule") == rule, action).otherwise(actions)
    verdict = F.when(F.col("rule").isNotNull(), actions).when(F.col("tokens").isNotNull(), BLOCK).otherwise(ALLOW)
    return out.withColumn("verdict", verdict).select(*base.columns, "verdict", "confidence", "tokens")
