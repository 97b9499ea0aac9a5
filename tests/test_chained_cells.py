"""Clusters past cells: every path of the search against brute force."""

import numpy as np
import pandas as pd
import pytest
from test_spatial import dist

from heliograde.operators import thinning as T


def clusters(D, s):
    lab = np.arange(len(D))
    while True:
        new = np.array([lab[D[i] <= s].min() for i in range(len(D))])
        if (new == lab).all():
            return lab
        lab = new


@pytest.fixture(scope="module")
def clumps():
    """Crowded clumps whose edges are close to 2 km apart, single sites, copies, a row without a position."""
    rng = np.random.default_rng(5)
    at = np.repeat(np.arange(9), 30)
    lon, lat = 10 + (at % 3) * 0.0337 + rng.random(270) * 0.01, 40 + (at // 3) * 0.0279 + rng.random(270) * 0.01
    P = pd.DataFrame({"id": rng.permutation(300), "lon": np.append(lon, 10 + rng.random(30) * 0.3), "lat": np.append(lat, 40 + rng.random(30) * 0.3)})
    P.loc[5:9, ["lon", "lat"]] = P.loc[4, ["lon", "lat"]].values
    return P.sort_values("id", ignore_index=True)


@pytest.mark.parametrize("direct", [0, 10_000_000])
def test_clusters_descend_on_both_sides(spark, clumps, direct, monkeypatch):
    monkeypatch.setattr(T, "DIRECT", direct)
    D = dist(clumps, clumps)
    df = spark.createDataFrame(clumps).union(spark.sql("SELECT 999L, CAST(NULL AS DOUBLE), 40.0D"))
    for s in (1900.0, 2000.0, float(D[(D > 1500) & (D < 2200)].min())):
        got = T.chain_clusters(df, "id", s).toPandas().set_index("id").sort_index()
        assert list(got.index) == list(clumps.id) and (got.cluster_id.values == clusters(D, s)).all()


def test_sweep_by_cells_equals_the_sweep_by_pairs(spark, clumps, monkeypatch):
    monkeypatch.setattr(T, "FEW_PAIRS", 0)
    D = dist(clumps, clumps)
    got = T.separation_sweep(spark.createDataFrame(clumps), "id", [20000.0, 500.0, 2000.0, 30000.0]).toPandas().set_index("separation")
    assert sorted(got.index) == [500.0, 2000.0, 20000.0, 30000.0]
    for s in got.index:
        n = np.bincount(clusters(D, s))
        assert (got.clusters[s], got.largest[s]) == ((n > 0).sum(), n.max())
