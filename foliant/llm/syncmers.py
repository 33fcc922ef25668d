"""Operator 8: document fingerprints of closed syncmers.

A k-mer of bytes is an anchor if the first smallest hash of its inner s-mers is that of its first or of its last one:
whether it is chosen depends on its own bytes alone, so an edit changes only the anchors it touches, and any K - S
k-mers in a row have an anchor among them, also where a text repeats itself. A fingerprint is the anchors' hashes in
text order, by the same K and S for every length. Two fingerprints are matched by position: equal hashes are paired
occurrence by occurrence, and of the pairs the longest run that rises in both texts counts.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import sliced

#: Bytes of a k-mer and of its inner s-mers; one position in (K - S + 1) / 2 is an anchor on average.
K, S = 12, 4
#: Bytes of an anchor's hash in the fingerprint.
HASH_BYTES = 3
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 20
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _smers(data: np.ndarray, s: int) -> np.ndarray:
    """A hash of each s bytes in a row, s at most 8."""
    x = data.astype(np.uint64)
    for size in (1, 2, 4):  # to each byte, the seven after it
        x = np.append(x, np.zeros(size, np.uint64))
        x = x[:-size] | x[size:] << np.uint64(8 * size)
    return _mixed((x[: len(data) - s + 1] << np.uint64(8 * (8 - s))) + np.uint64(s))


def _smallest(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n values in a row."""
    size = 1
    while 2 * size <= n:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (n - size)], x[n - size :])


def anchors(text: bytes, k: int = K, s: int = S) -> np.ndarray:
    """The hashes of the closed syncmers of the text in order; of the whole text where it is shorter than a k-mer."""
    data, found, w = np.frombuffer(text, np.uint8), [], k - s + 1
    for at in range(0, len(data) - k + 1, CHUNK):
        h = _smers(data[at : at + CHUNK + k - 1], s)
        inner, n = _smallest(h, w - 1), len(h) - w + 1
        chosen = np.flatnonzero((h[:n] <= inner[1:]) | (h[w - 1 :] < inner[:n]))
        x = np.zeros(len(chosen), np.uint64)
        for i in (*range(0, w - 1, s), w - 1):
            x = _mixed(x + h[chosen + i])
        found.append(x)
    found = np.concatenate(found) if found else np.empty(0, np.uint64)
    if len(found) or not text:
        return found
    return np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), "<u8")


def fingerprint(text: str, k: int = K, s: int = S) -> str:
    """The anchors' hashes, HASH_BYTES each, in base64; empty for an empty text."""
    found = anchors(text.encode(), k, s).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
    return base64.b64encode(found.tobytes()).decode()


def _hashes(fp: str) -> np.ndarray:
    data = np.frombuffer(base64.b64decode(fp), np.uint8).reshape(-1, HASH_BYTES)
    return sum(data[:, i].astype(np.uint32) << np.uint32(8 * i) for i in range(HASH_BYTES))


def likeness(a: str, b: str) -> float:
    """Share of the anchors of both that are matched by position, 0 to 1; 1 for equal fingerprints, also empty ones."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = _hashes(a), _hashes(b)
    total, n = len(x) + len(y), min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    same = int(differ[0]) if len(differ) else n  # a common start pairs with itself and is part of the longest run
    x, y = x[same:], y[same:]
    at = np.flatnonzero(np.isin(y, x))
    places = defaultdict(list)
    for j, h in zip(at[::-1].tolist(), y[at[::-1]].tolist()):
        places[h].append(j)
    tails: list[int] = []
    for h in x[np.isin(x, y)].tolist():
        if waiting := places[h]:
            j = waiting.pop()
            t = bisect_left(tails, j)
            tails[t : t + 1] = [j]
    return 2 * (same + len(tails)) / total


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as many first code points of the next one, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


LEAST = -(2**63)


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """(part, after, doc, h, text): docs dealt by ranges of doc and h, and the row that follows each part's last as its last.

    The ranges' ends are quantiles of doc; an id that fills several ranges, as null ids may, is dealt to them by ranges of
    its rows' hashes. The first row of a part goes to the part before, too, that of the first part to the last. Only a few
    numbers for each part go through the driver.
    """
    ends = np.array(sorted(docs.approxQuantile("doc", [i / parts for i in range(1, parts)], 0.1 / parts)) if parts > 1 else [])
    heavy = sorted({int(x) for x, y in zip(ends, ends[1:]) if x == y})
    h = F.when(F.col("doc").isin(heavy), F.xxhash64("text")).otherwise(F.lit(0)) if heavy else F.lit(0)
    docs = docs.withColumn("cut", h.cast("long"))

    @F.pandas_udf("int")
    def part_of(doc: pd.Series, cut: pd.Series) -> pd.Series:
        at = doc.to_numpy("float64")
        low, high = (np.searchsorted(ends, at, side=s) for s in ("left", "right"))
        share = cut.to_numpy("float64") / 2.0**64 + 0.5
        return pd.Series((low + np.minimum(np.floor(share * np.maximum(high - low, 1)), np.maximum(high - low - 1, 0))).astype("int32"))

    part = part_of("doc", "cut")
    firsts = sorted((r.part, *r.x) for r in docs.select("doc", "cut").groupBy(part.alias("part")).agg(F.min(F.struct("doc", "cut")).alias("x")).collect())
    before = {(doc, cut): firsts[i - 1][0] for i, (_, doc, cut) in enumerate(firsts)}

    @F.pandas_udf("int")
    def copied_to(doc: pd.Series, cut: pd.Series) -> pd.Series:
        return pd.Series([before.get(x) for x in zip(doc.tolist(), cut.tolist())], dtype="Int32")

    places = F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("after")), F.struct(F.col("copy").alias("part"), F.lit(True).alias("after")))
    rows = docs.withColumns({"own": part, "copy": copied_to("doc", "cut")}).withColumn("p", F.explode(F.filter(places, lambda x: x["part"].isNotNull())))
    rows = rows.select("p.part", "p.after", "doc", F.xxhash64("text").alias("h"), "text")
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "after", "doc", "h")


def _compared(k: int, s: int):
    names = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        held = None  # the row whose next is awaited
        for batch in sliced(batches):
            out = []
            for p, after, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "after", "doc", "text"))):
                if held is None and after:
                    continue  # another row of the id that follows
                text = (text or b"").decode("utf-8", "replace")
                fp = fingerprint(text, k, s)
                if held is not None:
                    own, own_text, own_fp = held
                    new = edited(own_text, text)
                    new_fp = own_fp if new == own_text else fingerprint(new, k, s)
                    out.append((own, len(own_text), hashlib.sha256(new.encode()).hexdigest(), own_fp, new_fp, likeness(own_fp, new_fp), likeness(own_fp, fp)))
                held = None if after else (doc, text, fp)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return run


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Rows stand in order of id, a null id first and rows of one id by a hash of the text; after the last comes the first.
    A null text is empty; an empty text has an empty fingerprint and is like an empty one only. A text of fewer than k
    bytes has one anchor, itself, and is like an equal one only. Repeated rows are kept, an empty table gives no rows,
    and other columns of docs are left out, whatever their names. Each text moves once.
    """
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(LEAST)).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = _dealt(rows, parts).mapInArrow(_compared(k, s), schema)
    return out.select(F.nullif("doc", F.lit(LEAST)).alias(id_col), *out.columns[1:])


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """docs with the column fingerprint, in place of one of that name; that of a null text is empty."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint((t or b"").decode("utf-8", "replace"), k, s) for t in texts], dtype=object)

    return docs.withColumn("fingerprint", of(F.col(text_col).cast("binary")))
