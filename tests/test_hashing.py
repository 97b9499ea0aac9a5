"""Draws: unrelated orders of two seeds, independent coordinates, resamples of the right spread; scratch folders."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograde import session
from heliograde.functions import hashing as H
from heliograde.operators import bootstrap as B
from heliograde.operators import candidates as C


def test_engines_agree(spark):
    keys = [0, 1, 2, 77, 2**31 - 1, 2**31, 12345678901234]
    con = duckdb.connect()
    for seed in (0, 11):
        want = [H.hash_value(k, seed) for k in keys]
        assert [r.h for r in spark.createDataFrame([(k,) for k in keys], "k bigint").select(H.hash_order("k", seed).alias("h")).collect()] == want
        assert [con.execute(f"SELECT {H.hash_order_sql(str(k), seed)}").fetchone()[0] for k in keys] == want
        assert [con.execute(H.hash_steps_sql(f"SELECT {k}::BIGINT AS h", "h", seed)).fetchone()[0] for k in keys] == want


def test_seeds_and_neighbours_are_unrelated(spark):
    d = spark.range(15_000).select("id", *[H.hash_order("id", s).alias(f"h{s}") for s in (0, 1, 11)]).toPandas().sort_values("id").astype("int64").reset_index(drop=True)
    for a, b in (("h0", "h1"), ("h0", "h11"), ("h1", "h11")):
        assert abs(d[a].corr(d[b])) < 0.03
    assert abs(np.corrcoef(d.h0.values[1:], d.h0.values[:-1])[0, 1]) < 0.03
    assert np.bincount(d.h0.values >> 27, minlength=16).std() < 0.1 * len(d) / 16


def test_points_cover_the_plane(spark):
    p = C.sphere_points(spark.range(20_000), "id", -90.0, 90.0).toPandas()
    u, v = (p.lon + 180) / 360, (np.sin(np.radians(p.lat)) + 1) / 2
    cells = np.histogram2d(u, v, bins=8)[0]
    assert abs(np.corrcoef(u, v)[0, 1]) < 0.03 and cells.min() > 0.7 * 20_000 / 64 and cells.max() < 1.3 * 20_000 / 64


def test_exact_draws_take_the_right_share_of_rows(spark):
    rows = spark.range(1000).select(F.lit("a").alias("g"), F.lit(1).alias("label"), F.col("id").alias("idx"))
    t = B.draw_multiplicities(rows, ["g"], "label", "idx", 40).toPandas()
    assert abs(t.groupby("rep").size().mean() / 1000 - 0.632) < 0.02 and (t.groupby("rep").times.sum() == 1000).all()


def test_standard_error_of_a_mean(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=1000)
    t = B.resampled(spark.range(1000).withColumnRenamed("id", "idx"), "idx", 400).toPandas()
    means = (t.times * x[t.idx.values]).groupby(t.rep).sum() / t.groupby("rep").times.sum()
    assert means.std() == pytest.approx(x.std() / np.sqrt(1000), rel=0.15)


def test_scratch_tables_go(spark):
    with session.scratch(spark):
        df = session.durable(spark.range(5))
        path = session._WRITTEN[-1]
        assert df.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_machine_local_scratch_is_refused_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        session.scratch_folder(Session())
