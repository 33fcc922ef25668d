"""Operator 9: SimHash near-duplicates, linked by the generalised pigeonhole principle.

Documents become 64-bit fingerprints, equal ones are grouped first, and the distinct ones are linked at up to `radius`
differing bits. The bits are put into m partitions, correlated bits together; with thresholds t_i whose sum is
radius - m + 1, two linked fingerprints differ in at most t_i bits of some partition i (-1: a partition that is not
probed). A dynamic program picks the thresholds, and the best m, by the candidate pairs and probes that the measured
bit and value counts of all fingerprints predict. Each bucket (partition, value) is then searched where its rows meet,
and yields a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import connected_components, sliced, unused, written

SEED = 42
LEAST = -(2**63)
#: Fingerprints of one bucket that are compared in one task; a larger bucket is compared in blocks of so many.
BLOCK = 2048
#: Cost of a probe row against that of one comparison.
ROW_COST = 200.0


def shingle_hashes(text: bytes | None, words: int = 4) -> bytes:
    """The big-endian XXH64 of each shingle of so many words, repeats included; of the whole sequence if it is shorter."""
    w = (text or b"").lower().split()
    h, join = xxhash.xxh64_digest, b" ".join
    if len(w) < words:
        return h(join(w), SEED) if w else b""
    return b"".join([h(join(x), SEED) for x in zip(*(w[i:] for i in range(words)))])


def simhash(text: bytes | None, words: int = 4) -> int:
    """A bit is 1 if it is 1 in over half the shingles' hashes; 0 for a text without words."""
    hashes = np.frombuffer(shingle_hashes(text, words), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc, row, fp) of every row; row is a hash of the text, fp the unsigned fingerprint's bits as a signed long."""

    def run(batches):
        for batch in sliced(batches):
            fps = np.array([simhash(t, words) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc", "row", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("binary")).mapInArrow(run, "doc long, row long, fp long")


def _bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how many have bits i and j both set, for all i and j."""

    def run(batches):
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 1 << 14):
                x = np.unpackbits(fp[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += x.T @ x
                n += len(x)
        flat = np.append(both.ravel(), n)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(flat[at].astype("int64"))], ["k", "v"])

    rows = distinct.select("fp").mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()  # 4,097 at most
    flat = np.zeros(4097)
    for k, v in rows:
        flat[k] = v
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def bit_groups(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of 64 / m bits or one more: from the most lopsided free bit on, the bits most correlated with the group."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    free, groups = set(range(64)), []
    for i in range(m):
        group = [max(sorted(free), key=lambda b: abs(p[b] - 0.5))]
        free.discard(group[0])
        while len(group) < 64 // m + (i < 64 % m):
            group.append(max(sorted(free), key=lambda b: corr[b, group].mean()))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def _packed(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, packed."""
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _bucket_rows(distinct: DataFrame, buckets: list[tuple[int, list[int], list[int]]]) -> DataFrame:
    """(g, v, fp): for each (g, bits, masks) and fingerprint, its value of these bits with each mask's bits flipped."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for g, bits, masks in buckets:
                value = _packed(fp.view(np.uint64), bits)
                for mask in masks:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), g, np.int32)), pa.array(value ^ mask), pa.array(fp)], ["g", "v", "fp"])

    return distinct.select("fp").mapInArrow(run, "g int, v long, fp long")


def _same_value_pairs(distinct: DataFrame, groupings: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """Pairs of fingerprints that agree on all bits of a group, for each (m, group): counted over all of them."""
    keys = [(m * 64 + i, bits, [0]) for m, groups in groupings.items() for i, bits in enumerate(groups)]
    rows = _bucket_rows(distinct, keys).groupBy("g", "v").count()
    rows = rows.groupBy("g").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()
    return {divmod(g, 64): pairs for g, pairs in rows}


def _within(p: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """The chance that two random fingerprints differ in at most 0..most of the bits, taken as independent."""
    d = np.zeros(most + 2)
    d[0] = 1
    for q in (2 * p[b] * (1 - p[b]) for b in bits):
        d[1:] = d[1:] * (1 - q) + d[:-1] * q
        d[0] *= 1 - q
    return np.cumsum(d[: most + 1])


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of -1 and up that add to total, least in cost; costs[i][t + 1] is that of threshold t in partition i."""
    best = {0: (0.0, [])}
    for cost in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(cost, -1):
                if s + t not in now or c + x < now[s + t][0]:
                    now[s + t] = (c + x, [*ts, t])
        best = now
    return best[total]


def plan(distinct: DataFrame, radius: int) -> tuple[list[list[int]], list[int]]:
    """The partitions' bits and thresholds for these fingerprints."""
    n, both = _bit_counts(distinct)
    p = np.diag(both) / max(n, 1)
    groupings = {m: bit_groups(both, n, m) for m in range(2, radius + 3)}
    same = _same_value_pairs(distinct, groupings)
    found = []
    for m, groups in groupings.items():
        costs = []
        for i, bits in enumerate(groups):
            near = _within(p, bits, radius)
            pairs = [max(same.get((m, i), 0.0), 1.0) * x / max(near[0], 1e-300) for x in near]
            probes = np.cumsum([comb(len(bits), t) for t in range(radius + 1)])
            costs.append([0.0] + [min(pairs[t], n * n / 2) + ROW_COST * n * float(probes[t]) for t in range(radius + 1)])
        found.append((*allocate(costs, radius - m + 1), groups))
    _, thresholds, groups = min(found, key=lambda x: x[0])
    return groups, thresholds


def _probe_rows(distinct: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(g, v, fp): each fingerprint in its own bucket and in those of all values within the threshold."""
    flips = [[sum(1 << b for b in c) for r in range(t + 1) for c in combinations(range(len(bits)), r)] for bits, t in zip(groups, thresholds)]
    return _bucket_rows(distinct, [(i, bits, masks) for i, (bits, masks) in enumerate(zip(groups, flips)) if masks])


def _forest(radius: int):
    """Over rows sorted by bucket: (a, b) edges that join what is linked within a bucket, fewer than its rows."""

    def roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
        while True:
            x, y = root[a], root[b]
            off = x != y
            if not off.any():
                return root
            a, b, x, y = a[off], b[off], x[off], y[off]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]

    def linked(key: np.ndarray, fp: np.ndarray):
        """key: a bucket's number for each row, ascending."""
        n = len(fp)
        root, at, lag = np.arange(n), np.arange(n), 1
        while True:
            at = at[at + lag < n]
            at = at[key[at] == key[at + lag]]
            if not len(at):
                break
            near = at[(np.bitwise_count(fp[at] ^ fp[at + lag]) <= radius) & (root[at] != root[at + lag])]
            if len(near):
                root = roots(n, near, near + lag, root)
            lag += 1
        out = np.flatnonzero((root != np.arange(n)) & (fp != fp[root]))
        return fp[out], fp[root[out]]

    def run(batches):
        held: list[np.ndarray] = []

        def flush(cols):
            new = np.zeros(cols.shape[1], np.int64)
            new[1:] = (cols[:4, 1:] != cols[:4, :-1]).any(axis=0)
            a, b = linked(np.cumsum(new), cols[4].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                cols = np.ascontiguousarray(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]))
                cut = np.flatnonzero((cols[:4] != cols[:4, -1:]).any(axis=0))
                cut = int(cut[-1]) + 1 if len(cut) else 0  # the last bucket may go on in the next batch
                if cut:
                    yield flush(np.ascontiguousarray(np.concatenate([*held, cols[:, :cut]], axis=1)))
                    held = []
                held.append(cols[:, cut:])
        if held:
            yield flush(np.ascontiguousarray(np.concatenate(held, axis=1)))

    return run


def links(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b) edges between distinct fingerprints (column fp) whose components are those of all links within radius.

    Buckets of over `block` rows are dealt out: their rows go to numbered blocks by hash, and each pair of blocks meets
    in a group of its own, so no task gets more than two blocks of a bucket.
    """
    rows = _probe_rows(distinct, *plan(distinct, radius))
    large = rows.groupBy("g", "v").count().where(F.col("count") > block).select("g", "v", F.ceil(F.col("count") / block).cast("long").alias("c"))
    rows = rows.join(large, ["g", "v"], "left").withColumn("c", F.coalesce("c", F.lit(1)))
    rows = rows.withColumn("x", F.pmod(F.xxhash64("fp"), F.col("c")))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    rows = rows.select("g", "v", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "fp")
    keys = ["g", "v", "x", "y"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(_forest(radius), "a long, b long")


def _rooted(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """fingerprints() of docs, and (fp, least, root) of the distinct ones: least of its ids, and one fp that stands for its group."""
    fps = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc").alias("least")), "distinct-fingerprints")
    comps = written(connected_components(links(distinct, radius)), "fingerprint-roots")
    return fps, distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs, near-duplicates linked within radius bits.

    Words are runs of other than [\\x20\\x09-\\x0D] in the text with A-Z lower-cased, shingles overlap and repeats count.
    A null or wordless text has fingerprint zero and is linked like any other. component_id is the smallest id
    reachable; null only where no row of the component has an id. Repeated rows are kept.
    """
    fps, rooted = _rooted(docs, id_col, text_col, words, radius)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    out = fps.join(named, "fp")
    return out.select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row of each near-duplicate group, that of its smallest id, with the columns of docs.

    Of rows that share that id, and of a group's rows where none has an id, the one whose text has the least hash stays,
    and of repeated rows one.
    """
    fps, rooted = _rooted(docs, id_col, text_col, words, radius)
    least = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("x")
    found = fps.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(least)
    doc, row = unused(docs, "doc_key", "row_key")
    keep = written(found.select(F.coalesce("x.doc", F.lit(LEAST)).alias(doc), F.col("x.row").alias(row)), "kept-documents")
    own = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)), row: F.xxhash64(text_col)})
    return own.join(keep, [doc, row], "left_semi").dropDuplicates([doc, row]).select(*docs.columns)
