"""Operator 5: benchmark decontamination by SimHash windows and multi-index Hamming blocks, with built-in functions only.

Windows have an item's size and are compared with the items of that size. A window that starts with a shingle foreign to
these loses nothing when it slides on to the next shared one or to the text's end, so windows are laid at every shared
shingle, and at the end, from where enough shared shingles lie in reach; all others are passed by without loss. Equal
windows are judged once. A window's SimHash is looked up in an index over the items' SimHashes: these are cut into blocks
with thresholds that add up to radius - blocks + 1, so two fingerprints within the radius differ in at most a block's
threshold of its bits for some block, and an index with all values that near for each block misses none. Candidates are
verified by the exact weighted similarity of their shingles.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import unused, written

WORDS, SIMILARITY = 5, 0.8
#: At similarity 0.8 two SimHashes of 64 bits differ in 9.7 bits on average, with a deviation of 2.9.
RADIUS, BLOCKS = 18, 6
#: Rows made from the benchmark alone that are sent to every task; where there are more, the join shuffles.
BROADCAST_ROWS = 2_000_000
WHITE = " \t\n\x0b\x0c\r"
LEAST = -(2**63)


def words_of(text: Column) -> Column:
    """Lower-cased runs of other than [\\x20\\x09-\\x0D]; an empty array for a null or blank text."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def shingle_hashes(words: Column, k: int) -> Column:
    """The 64-bit hash of each k words in a row; none where there are fewer."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))


def simhash_of(hashes: str) -> Column:
    """Bit b is 1 if it is 1 in over half of the hashes."""
    ones = f"aggregate({hashes}, 0, (a, h) -> a + CAST(shiftright(h, b) & 1 AS INT))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | IF(2 * {ones} > size({hashes}), shiftleft(1L, b), 0L))")


def _blocks(m: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    sizes = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def _block_value(fp: str, first: int, n: int) -> Column:
    return F.expr(f"shiftrightunsigned({fp}, {first}) & {2**n - 1}L")


def _masks(radius: int, m: int) -> list[list[int]]:
    """For each block the bits to flip for every value within its threshold; the widest blocks have the largest thresholds."""
    total = radius - m + 1
    thresholds = [total // m + (i < total % m) for i in range(m)]
    return [[sum(1 << b for b in c) for r in range(t + 1) for c in combinations(range(n), r)] for t, (_, n) in zip(thresholds, _blocks(m))]


def _index(items: DataFrame, radius: int, m: int) -> DataFrame:
    """(item, k, n, ifp, block, value): every value within the block's threshold of the item's; a block without masks is not looked up."""
    near = []
    for i, ((first, n), masks) in enumerate(zip(_blocks(m), _masks(radius, m))):
        flips = F.array(*map(F.lit, masks)).cast("array<bigint>")
        near.append(F.struct(F.lit(i).alias("block"), _block_value("ifp", first, n).alias("own"), flips.alias("flips")))
    rows = items.select("item", "k", "n", "ifp", F.explode(F.array(*near)).alias("b"))
    return rows.select("item", "k", "n", "ifp", "b.block", "b.own", F.explode("b.flips").alias("flip")).withColumn("value", F.col("own").bitwiseXOR(F.col("flip"))).drop("own", "flip")


def _counted(hashes: Column) -> Column:
    """The hashes as a set, later ones of equal hashes told apart by their number: what two of them share is counted by occurrence."""
    told = F.transform(F.array(F.array_sort(hashes)), lambda s: F.transform(s, lambda x, i: F.when(F.get(s, i - 1) == x, F.xxhash64(x, i - F.array_position(s, x))).otherwise(x)))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(F.get(told, 0))


def _starts(similarity: float) -> Column:
    """The places from which a window can reach the similarity, of rows (k, n, len, ps): ps are the places of shared shingles in order.

    A window starts at a shared shingle or is the text's last. Of its shingles and the item's, s(a + b) / (1 + s) at least
    are shared where the similarity is s.
    """
    most = Fraction(similarity).limit_denominator(10**6)
    share = most / (1 + most)
    own = F.least("n", "len") - F.col("k") + 1
    need = F.expr(f"CAST((({share.numerator}L * (least(n, len) + n - 2 * k + 2)) + {share.denominator - 1}L) div {share.denominator}L AS INT)")
    last = F.greatest(F.lit(0), F.col("len") - F.col("n"))
    inner = F.filter("ps", lambda p, i: (p <= last) & (F.get("ps", i + need - 1) < p + own))
    end = F.when(F.get("ps", F.size("ps") - need) >= last, F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.array_union(inner, end)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col), F.lit(LEAST)).cast("long").alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc, row, item, start, similarity): of each document and item the best window that reaches the similarity.

    row is xxhash64 of the text and tells apart rows that share an id; a null id is the least long here. start counts
    words from 0; of equally similar windows that are laid it is the first. A window has as many words as the item, or
    all where the document has fewer. The similarity of window and item is the sum over shingles of the smaller of their counts by that of the
    larger. Items of fewer words than a shingle are one shingle; items and texts that are null or blank match nothing.
    Items that share an id are taken one by one, and the best counts.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("w")).where(F.size("w") > 0)
    items = items.withColumns({"n": F.size("w"), "k": F.least(F.size("w"), F.lit(words))})
    sized = items.groupBy("k").agg(F.sum(F.col("n") - F.col("k") + 1).alias("shingles"), F.count(F.lit(1)).alias("items")).collect()  # `words` rows at most
    ks, n_shingles = sorted(r.k for r in sized), sum(r.shingles for r in sized)
    if not ks:
        ks = [words]
    hashes = F.coalesce(*(F.when(F.col("k") == k, shingle_hashes(F.col("w"), k)) for k in ks))
    items = items.select("item_id", "n", "k", hashes.alias("hs"), F.xxhash64("item_id", "w").alias("item"))
    items = written(items.withColumn("ifp", simhash_of("hs")), "benchmark-items")
    n_items = sum(r.items for r in sized)

    keyed = _keyed(docs, id_col, text_col).withColumn("w", words_of(F.col("text")))
    sizes = items.select("k", "n", F.explode("hs").alias("h")).distinct()
    found = None
    for k in ks:
        own = keyed.select("doc", "row", F.size("w").alias("len"), F.posexplode(shingle_hashes(F.col("w"), k)).alias("p", "h"))
        hit = own.join(_small(sizes.where(F.col("k") == k), n_shingles), "h").select("doc", "row", "k", "n", "len", "p")
        found = hit if found is None else found.union(hit)
    per_size = found.groupBy("doc", "row", "k", "n", "len").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    of_size = F.transform(_starts(similarity), lambda x: F.struct("k", "n", x.alias("start")))
    per_doc = per_size.select("doc", "row", of_size.alias("laid")).where(F.size("laid") > 0).groupBy("doc", "row").agg(F.flatten(F.collect_list("laid")).alias("laid"))
    laid = _keyed(docs, id_col, text_col).join(written(per_doc, "laid-windows"), ["doc", "row"])
    laid = laid.withColumn("w", words_of(F.col("text"))).select("doc", "row", "laid", *(shingle_hashes(F.col("w"), k).alias(f"hs{k}") for k in ks))
    slices = F.coalesce(*(F.when(F.col("x.k") == k, F.expr(f"slice(hs{k}, x.start + 1, x.n - x.k + 1)")) for k in ks))
    laid = laid.select("doc", "row", *(f"hs{k}" for k in ks), F.explode("laid").alias("x")).select("doc", "row", "x.k", "x.n", "x.start", slices.alias("ws"))
    laid = laid.withColumns({"a": F.xxhash64("ws"), "b": F.xxhash64(F.lit("b"), "ws")}).distinct()
    laid = written(laid, "windows")

    content = written(laid.select("k", "n", "a", "b", "ws").dropDuplicates(["k", "n", "a", "b"]).withColumn("fp", simhash_of("ws")), "window-contents")
    parts = F.array(*(F.struct(F.lit(i).alias("block"), _block_value("fp", *x).alias("value")) for i, x in enumerate(_blocks(blocks))))
    probes = content.select("k", "n", "a", "b", "fp", F.explode(parts).alias("p")).select("k", "n", "a", "b", "fp", "p.block", "p.value")
    index = _small(_index(items, radius, blocks), n_items * sum(map(len, _masks(radius, blocks))))
    pairs = probes.join(index, ["k", "n", "block", "value"]).where(F.expr(f"bit_count(fp ^ ifp) <= {radius}"))
    pairs = written(pairs.select("k", "n", "a", "b", "item").distinct(), "window-candidates")

    sets = items.select("item", _counted(F.col("hs")).alias("s_item")).dropDuplicates(["item"])
    same = pairs.join(content.select("k", "n", "a", "b", _counted(F.col("ws")).alias("s_own")), ["k", "n", "a", "b"]).join(_small(sets, n_shingles), "item")
    same = same.select("k", "n", "a", "b", "item", F.size("s_own").alias("n_own"), F.size("s_item").alias("n_item"), F.size(F.array_intersect("s_own", "s_item")).cast("long").alias("both"))
    same = same.withColumn("similarity", F.col("both") / (F.col("n_own") + F.col("n_item") - F.col("both"))).where(F.col("similarity") >= similarity)
    names = items.select("item", "item_id").distinct()
    same = written(same.select("k", "n", "a", "b", "item", "similarity"), "window-matches").join(_small(names, n_items), "item")
    hits = laid.select("doc", "row", "k", "n", "a", "b", "start").join(same, ["k", "n", "a", "b"])
    best = hits.groupBy("doc", "row", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("x"))
    return best.select("doc", "row", F.col("item_id").alias("item"), (-F.col("x.s")).cast("long").alias("start"), "x.similarity")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, item_id, start, similarity): of each id and item the best window, see contaminated(); repeated rows are one."""
    found = contaminated(docs, benchmark, id_col, text_col, **kw)
    best = found.groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("x"))
    return best.select(F.nullif("doc", F.lit(LEAST)).alias(id_col), F.col("item").alias("item_id"), (-F.col("x.s")).alias("start"), "x.similarity")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that hold no item; all their columns as they were."""
    doc, row = unused(docs, "doc_key", "row_key")
    gone = contaminated(docs, benchmark, id_col, text_col, **kw).select(F.col("doc").alias(doc), F.col("row").alias(row)).distinct()
    own = docs.withColumns({doc: F.coalesce(F.col(id_col), F.lit(LEAST)).cast("long"), row: F.xxhash64(text_col)})
    return own.join(gone, [doc, row], "left_anti").select(*[F.col(c) for c in docs.columns])
