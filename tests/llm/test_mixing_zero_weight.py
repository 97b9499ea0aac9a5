"""Leaves that a weight of 0 shuts out hold nothing for their ancestors."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograde.llm import mixing


def test_share_of_shut_leaves_goes_to_other_branches(spark):
    leaves = spark.createDataFrame([("a", "en", 50), ("a", "xx", 1000), ("b", "en", 1000)], "d string, l string, tokens bigint")
    got = {(r.d, r.l): r.budget for r in mixing.budgets(leaves, ["d", "l"], [{}, {"en": 1.0}], F.lit(600.0)).collect()}
    assert got == {("a", "en"): 50, ("a", "xx"): 0, ("b", "en"): 550}
