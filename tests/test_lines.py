"""Queries of lines whose ends hold white space of every kind, over small documents."""

import hashlib

import pytest

from foliant import plans


@pytest.fixture
def tables(spark, tmp_path):
    def made(*texts):
        df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
        df.write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return made


def test_candidates_are_measured_without_white_space(spark, tables):
    sf = tables("　Part \xa0\n \t﻿\n" + "x" * 60 + " \x0b\n" + "y" * 61, "\n".join(f"l{i}" for i in range(130)), "", None)
    got = sorted(map(tuple, plans.queries()["d16_candidates"](spark, sf).collect()))
    assert got == [(0, 0, 2, 0), (1, 0, 120, 0), (1, 1, 10, sum(len(f"l{i}") + 1 for i in range(120)))]


def test_blocks_are_trimmed_and_empty_ones_left_out(spark, tables):
    sf = tables("\n\u3000a b\x0b\n \xa0\n\n\ufeffc", "\n\n", "", None)
    got = sorted(map(tuple, plans.queries()["r05_plain_blocks"](spark, sf).collect()))
    assert got == [(0, i, hashlib.sha256(t.encode()).hexdigest()) for i, t in ((1, "a b"), (3, "c"))]
