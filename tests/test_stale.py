"""Units that go stale: names are sent to documents, and no text is dealt by its language."""

import os

import pytest

from foliant.plans import cast

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_texts_are_not_dealt_by_language(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cast.c25_stale(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [lang" in plan and "SortMergeJoin [lang" not in plan
