"""Cells of large groups: found by halving, and without dealing rows out by group."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from heliograde.operators import ranking as R


def test_cells_by_halving(spark):
    rng = np.random.default_rng(2)
    bounds = np.sort(np.round(rng.normal(size=R.CELLS - 1), 2))  # some are equal
    values = np.concatenate([bounds, bounds + 0.001, [-99.0, 99.0]])
    df = spark.createDataFrame(pd.DataFrame({"v": values})).withColumn("__bounds", F.array(*[F.lit(float(b)) for b in bounds]))
    got = df.select("v", R._not_above(F.col("v")).alias("c")).toPandas()
    assert (got.c.to_numpy() == np.searchsorted(bounds, got.v.to_numpy(), side="right")).all()


def test_large_groups_stay_spread(spark, monkeypatch):
    monkeypatch.setattr(R, "SPLIT_ABOVE", 3000)
    monkeypatch.setattr(R, "SAMPLE_PER_GROUP", 2000)
    d = pd.DataFrame({"g": ["hot"] * 9000 + ["small"] * 50 + [None] * 5, "v": np.random.default_rng(1).permutation(9055) / 7})
    dist = spark.createDataFrame(d).withColumn("n", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes that planning would not broadcast by itself
    try:
        celled = R.with_cells(dist, ["g"], "v", None)
        plan = celled._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan  # by its group a hot one would go to a single task
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    per = celled.filter("g = 'hot'").groupBy("__cell").count().toPandas()
    assert len(per) > 200 and per["count"].max() < 400
    got = R.running_sums(dist, ["g"], "v", ["n"]).toPandas()
    hot = got[got.g == "hot"].sort_values("v")
    assert (hot.below_n.to_numpy() == np.arange(9000)).all() and (hot.total_n == 9000).all()
