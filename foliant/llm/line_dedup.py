"""Operator 2: line de-duplication by range-partitioned hashes.

Lines' 128-bit hashes are dealt by range of (hash, document, position) and sorted so within each partition; one stream
over a partition sees the first document of every hash before the others. A run of equal hashes may cross partitions,
however long it is: the stream leaves its partition's first run open and reports the first document of its last run, and
these few rows (two hashes a partition at most) settle the open ones. What comes back is a compressed keep bitmap for
each document that loses lines, not text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import sliced, unused, written

SPACE = b" \t\n\x0b\x0c\r"
DROP, OPEN, TAIL = 0, 1, 2
LEAST = -(2**63)


def line_keys(text: bytes, min_chars: int) -> list[tuple[int, int, int, int]]:
    """(hash, hash, position, lines in all) of each line whose key has at least min_chars code points."""
    out, lines = [], text.lower().split(b"\n")
    for pos, line in enumerate(lines):
        key = line.strip(SPACE)
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
            continue
        x = xxhash.xxh3_128_intdigest(key)
        out.append(((x >> 64) - 2**63, (x & 0xFFFFFFFFFFFFFFFF) - 2**63, pos, len(lines)))
    return out


def _hashed(min_chars: int):
    names = ["h1", "h2", "doc", "row", "pos", "lines"]

    def run(batches):
        for batch in sliced(batches):
            cols = [[], [], [], [], [], []]
            docs, rows, texts = (batch.column(i).to_pylist() for i in range(3))
            for doc, row, text in zip(docs, rows, texts):
                if text:
                    for h1, h2, pos, n in line_keys(text, min_chars):
                        for c, x in zip(cols, (h1, h2, doc, row, pos, n)):
                            c.append(x)
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run


def _streamed(batches):
    """Over rows sorted by (hash, document, position): those to drop, those of the first run, the last run's first one."""
    head = last = None
    first = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, row, pos, lines = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        n = len(h1)
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is not None:
            new[0] = (h1[0], h2[0]) != last
        else:
            head = (h1[0], h2[0])
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        firsts = np.where(at >= 0, doc[np.maximum(at, 0)], first)
        opened = (h1 == head[0]) & (h2 == head[1])
        kind = np.where(opened, OPEN, np.where(doc != firsts, DROP, -1))
        last, first = (h1[-1], h2[-1]), firsts[-1]
        keep = kind >= 0
        yield pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (h1, h2, doc, row, pos, lines)), pa.array(kind[keep].astype("int32"))], ["h1", "h2", "doc", "row", "pos", "lines", "kind"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((last[0], last[1], first, 0, 0, 0, TAIL), [pa.int64()] * 4 + [pa.int32()] * 3)], ["h1", "h2", "doc", "row", "pos", "lines", "kind"])


@F.pandas_udf(T.BinaryType())
def _bitmap(positions, n_lines):
    def one(dropped, n):
        bits = np.ones(n, np.uint8)
        bits[dropped] = 0
        return zlib.compress(np.packbits(bits).tobytes())

    return pd.Series([one(np.asarray(p, dtype="int64"), int(n)) for p, n in zip(positions, n_lines)], dtype=object)


def kept_text(text: bytes, bitmap: bytes | None) -> bytes:
    """The lines whose bit is set, joined again; no bitmap keeps all."""
    if bitmap is None:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return b"\n".join(x for x, bit in zip(lines, bits.tolist()) if bit)


@F.pandas_udf(T.StringType())
def keep_text(text, bitmap):
    """Column form of kept_text, over text as binary."""
    return pd.Series([None if t is None else kept_text(t, b).decode("utf-8", "replace") for t, b in zip(text, bitmap)], dtype=object)


@F.pandas_udf(T.StringType())
def kept_sha256(text, bitmap):
    """SHA-256 of kept_text; a null text is an empty one."""
    return pd.Series([hashlib.sha256(kept_text(t or b"", b)).hexdigest() for t, b in zip(text, bitmap)], dtype=object)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, row and text; row (a hash of the text) tells apart rows that share an id."""
    return docs.select(F.coalesce(F.col(id_col), F.lit(LEAST)).cast("long").alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("binary").alias("text"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc, row, pos, lines) of every line to drop; lines is the number of the document's."""
    lines = _keyed(docs, id_col, text_col).mapInArrow(_hashed(min_chars), "h1 long, h2 long, doc long, row long, pos int, lines int")
    order = ["h1", "h2", "doc", "row", "pos"]
    marks = lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_streamed, "h1 long, h2 long, doc long, row long, pos int, lines int, kind int")
    marks = written(marks, "line-marks")
    firsts = marks.where(F.col("kind") != DROP).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    # two hashes a partition at most, whatever the data: small enough to send to every task
    opened = marks.where(F.col("kind") == OPEN).join(F.broadcast(firsts), ["h1", "h2"]).where("doc > first")
    return marks.where(F.col("kind") == DROP).select("doc", "row", "pos", "lines").union(opened.select("doc", "row", "pos", "lines"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc, row, n_dropped, keep_bitmap) of the documents that lose lines."""
    drops = dropped_lines(docs, id_col, text_col, min_chars).groupBy("doc", "row").agg(F.array_distinct(F.collect_list("pos")).alias("pos"), F.max("lines").alias("lines"))
    return drops.select("doc", "row", F.size("pos").cast("long").alias("n_dropped"), _bitmap("pos", "lines").alias("keep_bitmap"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with n_lines, n_dropped and keep_bitmap (zlib of one bit a line, most significant first; null: all stay).

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least min_chars code points
    that two or more documents hold lose all their lines but those in the smallest id. A null or empty text is one
    empty line. A null id sorts before all others; rows that share an id are one document when keys are counted. The
    result has a row for every row of docs and all its columns; n_lines, n_dropped and keep_bitmap replace columns of
    such names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out, _, _ = _with_bitmaps(docs.drop("n_lines", "n_dropped", "keep_bitmap"), id_col, text_col, min_chars)
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    return out.withColumn("n_lines", n_lines).withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)).cast("long"))


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> tuple[DataFrame, str, str]:
    """docs with n_dropped and keep_bitmap, null where nothing is dropped, and the names these have beside docs' own columns."""
    doc, row, n_dropped, bitmap = unused(docs, "doc_key", "row_key", "n_dropped", "keep_bitmap")
    keyed = docs.withColumns({doc: F.coalesce(F.col(id_col), F.lit(LEAST)).cast("long"), row: F.xxhash64(text_col)})
    drops = keep_bitmaps(docs, id_col, text_col, min_chars).withColumnsRenamed({"doc": doc, "row": row, "n_dropped": n_dropped, "keep_bitmap": bitmap})
    return keyed.join(drops, [doc, row], "left").drop(doc, row), n_dropped, bitmap


def without_dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with the dropped lines gone from their text; other columns as they were."""
    out, _, bitmap = _with_bitmaps(docs, id_col, text_col, min_chars)
    loses = F.col(bitmap).isNotNull()
    text = F.when(loses, keep_text(F.when(loses, F.col(text_col).cast("binary")), bitmap)).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).select(*[F.col(c) for c in docs.columns])
