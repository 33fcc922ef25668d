"""Pairs of words are those of whole texts, however long: texts that differ beyond their first 40,000 words."""

import pytest

from foliant import plans

N = 40_000


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Two texts with the same beginning and other ends, each about as long, and a lone word."""
    sf = str(tmp_path_factory.mktemp("long"))
    lead = [f"w{i}" for i in range(N)]
    texts = [" ".join(lead + [f"{name}{i}" for i in range(N)]) for name in "ab"] + ["lone"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    return sf


def test_likeness_of_long_texts(spark, long_texts):
    got = sorted(map(tuple, plans.queries()["l04_shingles"](spark, long_texts).collect()))
    both = N - 1
    assert got == [(1, 2 * N - 1, round(both / (2 * (2 * N - 1) - both), 9)), (2, 1, 0.0)]


def test_classes_of_long_texts(spark, long_texts):
    got = sorted(map(tuple, plans.queries()["l05_near_classes"](spark, long_texts).select("doc_id", "rep", "class_id").collect()))
    assert got == [(0, 0, 0), (1, 1, 1), (2, 2, 2)]


def test_links_of_long_texts(spark, tmp_path):
    lead = [f"w{i}" for i in range(N)]
    texts = [" ".join(lead + [f"{name}{i}" for i in range(N // 10)]) for name in "ab"] + [" ".join(lead[:2000])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, plans.queries()["l05_near_documents"](spark, str(tmp_path)).select("doc_id", "rep", "links").collect()))
    assert got == [(0, 0, 1), (1, 1, 1), (2, 2, 0)]
