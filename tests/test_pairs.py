import numpy as np
import pandas as pd
import pytest

from heliograde.operators import mcda as M
from heliograde.operators import pairs as P


def area(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return ((pos[:, None] > neg[None, :]).sum() + (pos[:, None] == neg[None, :]).sum() / 2) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    n = 3000
    df = pd.DataFrame({"c": rng.choice(["x", "y"], n, p=[0.9, 0.1]), "label": rng.integers(0, 2, n), "a": rng.normal(0, 1e6, n), "b": rng.integers(-2, 3, n) / 2.0, "k": 7.0})
    df.loc[::9, "a"] = np.nan
    return df


def test_quantiles_and_areas_of_columns(spark, points):
    s = spark.createDataFrame(points).repartition(5)
    q = P.quantiles(s, ["c"], ["a", "b", "k"], {"lo": 0.02, "mid": 0.5, "hi": 0.98}).toPandas()
    r = P.column_areas(s, ["c"], ["a", "b", "k"]).toPandas()
    assert len(q) == len(r) == 6
    for c, part in points.groupby("c"):
        for v in ("a", "b", "k"):
            own = part[part[v].notna()]
            got = q[(q.c == c) & (q.criterion == v)].iloc[0]
            assert got.n == len(own)
            assert np.allclose([got.lo, got.mid, got.hi], np.quantile(own[v], [0.02, 0.5, 0.98]), rtol=1e-12)
            assert np.isclose(r[(r.c == c) & (r.criterion == v)].auc.iloc[0], area(own[v].to_numpy(), own.label.to_numpy()), rtol=1e-12)


def test_config_areas_follow_the_scores(spark):
    rng = np.random.default_rng(4)
    n = 1500
    df = pd.DataFrame({c: np.round(rng.uniform(0, 9, n), 1) for c in sorted(M.DIRECTION)})
    df["country"], df["label"], df["worldcover"], df["wdpa"] = rng.choice(["x", "y"], n), rng.integers(0, 2, n), rng.choice([10, 80, 30], n), 0.0
    s = spark.createDataFrame(df)
    got = M.config_areas(s, "country").toPandas().set_index(["country", "config", "aggregator", "land"])
    long = M.score_configs(s, "country", ["country", "label"]).toPandas()
    assert len(got) == 32
    for key, part in long.groupby(["country", "config", "aggregator", "land"]):
        assert abs(got.loc[key].roc - area(np.round(part.mcda.to_numpy(), 9), part.label.to_numpy())) < 1e-6
