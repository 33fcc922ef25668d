import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import line_dedup


def brute(rows):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    key = lambda s: lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", s))
    order = lambda d: (d is not None, d or 0)
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == order(d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    out = line_dedup.line_dedup(docs)
    out = out.select("doc_id", "n_lines", "n_dropped", line_dedup.kept_sha256(F.col("text").cast("binary"), "keep_bitmap"))
    return sorted([tuple(r) for r in out.collect()], key=str)


def test_edge_rows_match_brute_force(spark):
    rows = [
        (5, "Shared license line\nown words of five\nshared LICENSE line\t"), (2, "  shared license line\x0b"), (9, "short\nshort"), (1, "short"),
        (3, None), (4, ""), (None, "a line of no document at all\nx"), (6, "a line of no document at all"), (7, "\n\n\n"), (7, "\n\n\n"),
        (8, "éééééééééé\nÉÉÉÉÉÉÉÉÉÉ"), (10, "éééééééééé"), (11, "ééééééééé"), (12, "ééééééééé"), (13, "y\n" * 5000 + "Shared license line"), (5, "another text under the same id"),
    ]
    assert result(spark, rows) == brute(rows)


def test_runs_over_many_partitions(spark):
    rows = [(i, "the same line again\nand a second one of them\n" + f"only in {i // 2}, in two") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert result(spark, rows, 7) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_table_and_clashing_names(spark):
    assert result(spark, []) == []
    docs = spark.createDataFrame([(1, "line that is long", 7, "x"), (2, "line that is long", 8, "y")], "doc_id long, text string, n_lines int, doc string")
    out = line_dedup.line_dedup(docs)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.doc) for r in out.collect()} == {1: (1, 0, "x"), 2: (1, 1, "y")}
    again = line_dedup.without_dropped_lines(docs)
    assert again.columns == docs.columns and {r.doc_id: r.text for r in again.collect()} == {1: "line that is long", 2: ""}


def test_bitmap_is_one_bit_a_line(spark):
    docs = spark.createDataFrame([(1, "a long enough line"), (2, "keep\nA long enough line\nkeep too")], "doc_id long, text string")
    bitmap = line_dedup.line_dedup(docs).where("doc_id = 2").first().keep_bitmap
    assert np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=3).tolist() == [1, 0, 1]
