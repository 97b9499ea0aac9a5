"""Queries that no prefix gives enough candidates."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograde.llm import forest


@pytest.mark.parametrize("n", [11, 30])
def test_small_tables_give_k_neighbours_exactly(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = forest.search(table, F.lit(True), piece=7).toPandas()
    for q in range(n):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(n), d)) if i != q][:10]
        assert list(got[got.query_id == q].sort_values("rank").vec_id) == want
