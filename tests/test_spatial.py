"""Distance joins, thinning, clusters and boxes against brute force, with crowded spots."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliograde.functions.hashing import hash_value
from heliograde.operators import spatial as G
from heliograde.operators import thinning as T


def xyz(lon, lat):
    lo, la = np.radians(lon), np.radians(lat)
    n = G.SEMI_MAJOR / np.sqrt(1 - G.ECC2 * np.sin(la) ** 2)
    return np.c_[n * np.cos(la) * np.cos(lo), n * np.cos(la) * np.sin(lo), n * (1 - G.ECC2) * np.sin(la)]


def dist(a, b):
    return np.sqrt(((xyz(a.lon.values, a.lat.values)[:, None] - xyz(b.lon.values, b.lat.values)[None]) ** 2).sum(-1)).round(3)


@pytest.fixture(scope="module")
def sides():
    rng = np.random.default_rng(0)
    L = pd.DataFrame({"id": np.arange(200), "lon": 10 + rng.random(200) * 2, "lat": 40 + rng.random(200) * 2})
    R = pd.DataFrame({"rid": np.arange(150), "lon": 10 + rng.random(150) * 2, "lat": 40 + rng.random(150) * 2})
    L.loc[:30, ["lon", "lat"]] = [10.5, 40.51]  # a third of the mass in copies or within metres
    R.loc[:40, ["lon", "lat"]] = [10.5, 40.5]
    R.loc[41:90, "lon"] = 10.7 + rng.random(50) * 1e-3
    R.loc[41:90, "lat"] = 40.7 + rng.random(50) * 1e-3
    return L, R


def test_nearest_within(spark, sides):
    L, R = sides
    D = dist(L, R)
    got = G.nearest_within(spark.createDataFrame(L), spark.createDataFrame(R), "rid", 5000.0).toPandas().set_index("id").sort_index()
    assert list(got.index) == list(np.where(D.min(1) <= 5000)[0])
    assert (got.near_id.values == D[got.index].argmin(1)).all()


def test_nearest_any_distance_across_the_date_line(spark):
    L = pd.DataFrame({"id": [0, 1, 2], "lon": [179.99, -179.99, 0.0], "lat": [0.0, 10.0, 80.0]})
    R = pd.DataFrame({"rid": [5, 6], "lon": [-179.99, 179.98], "lat": [0.0, 10.0]})
    got = G.nearest(spark.createDataFrame(L), spark.createDataFrame(R), "rid", "id").toPandas().set_index("id").sort_index()
    assert list(got.near_id) == [5, 6, 6]


def test_nearest_other_with_copies(spark, sides):
    L, _ = sides
    D = dist(L, L)
    np.fill_diagonal(D, np.inf)
    got = G.nearest_other(spark.createDataFrame(L), "id", 50000.0).toPandas().set_index("id").sort_index()
    assert (got.dist_m.values == D.min(1)[got.index]).all() and (got.near_id.values == D.argmin(1)[got.index]).all()


def test_spaced_points_equal_the_sequential_rule(spark, sides):
    L, R = sides
    h = [hash_value(int(i)) for i in L.id.values]
    E, seeds = xyz(L.lon.values, L.lat.values), xyz(R.lon.values[:5], R.lat.values[:5])
    acc = []
    for i in np.lexsort((L.id.values, h)):
        if all(np.linalg.norm(E[i] - s) >= 12000 for s in seeds) and all(np.linalg.norm(E[i] - E[j]) >= 12000 for j in acc):
            acc.append(i)
    got = T.spaced_points(spark.createDataFrame(L), "id", 12000.0, spark.createDataFrame(R[:5]), "rid").toPandas()
    assert set(got.id) == set(acc)


def test_chain_clusters(spark, sides):
    L, _ = sides
    D = dist(L, L) <= 6000
    lab = np.arange(len(L))
    while True:
        new = np.array([lab[D[i]].min() for i in range(len(L))])
        if (new == lab).all():
            break
        lab = new
    got = T.chain_clusters(spark.createDataFrame(L), "id", 6000.0).toPandas().set_index("id").sort_index()
    assert (got.cluster_id.values == lab).all()


def test_trim_densest(spark):
    rng = np.random.default_rng(2)
    P = pd.DataFrame({"id": np.arange(40), "g": np.arange(40) % 2, "lon": 10 + rng.random(40) * 0.5, "lat": 40 + rng.random(40) * 0.5})
    P.loc[[4, 6], ["lon", "lat"]] = [10.1, 40.1]
    want = []
    for g, keep in ((0, 14), (1, 16)):
        ix = np.where(P.g == g)[0]
        D = dist(P.iloc[ix], P.iloc[ix])
        np.fill_diagonal(D, np.inf)
        alive = np.ones(len(ix), bool)
        while alive.sum() > keep:
            X = D.copy()
            X[~alive], X[:, ~alive] = np.inf, np.inf
            v = int(X.min(1).argmin())
            alive[v] = False
            want.append(ix[v])
    keep = spark.createDataFrame(pd.DataFrame({"g": [0, 1], "keep": [14, 16]}))
    got = T.trim_densest(spark.createDataFrame(P), "id", "g", keep, (80000.0,)).toPandas()
    assert set(got.id) == set(want)


def test_box_pairs_of_very_different_sizes(spark):
    rng = np.random.default_rng(4)

    def boxes(n, name):
        w = 10 ** rng.uniform(-3, 1, n)
        x, y = rng.uniform(-5, 5, n), rng.uniform(-5, 5, n)
        return pd.DataFrame({name: np.arange(n), "minx": x, "miny": y, "maxx": x + w, "maxy": y + w / 2})

    a, b = boxes(120, "a"), boxes(90, "b")
    got = G.box_pairs(spark.createDataFrame(a), spark.createDataFrame(b)).select("a", "b").toPandas()
    want = {(i.a, j.b) for i in a.itertuples() for j in b.itertuples() if i.minx <= j.maxx and j.minx <= i.maxx and i.miny <= j.maxy and j.miny <= i.maxy}
    assert len(got) == len(want) and set(map(tuple, got.values)) == want


def test_nearest_other_at_any_distance(spark, sides):
    L, _ = sides
    far = pd.DataFrame({"id": [900, 901], "lon": [-100.0, 170.0], "lat": [-30.0, 60.0]})
    P = pd.concat([L, far], ignore_index=True).assign(g=0)
    P.loc[len(P)] = [950, 20.0, 20.0, 1]  # alone in its group
    P = P.astype({"id": "int64", "g": "int64"})
    D = dist(P[P.g == 0], P[P.g == 0])
    np.fill_diagonal(D, np.inf)
    found, rest = G.nearest_other_any(spark.createDataFrame(P), "id", ["g"])
    got = found.toPandas().set_index("id").sort_index()
    ids = P[P.g == 0].id.values
    assert list(got.index) == list(ids) and (got.dist_m.values == D.min(1)).all() and (got.near_id.values == ids[D.argmin(1)]).all()
    assert [r["id"] for r in rest.collect()] == [950]


def test_trim_that_cannot_meet_its_quota_is_an_error(spark):
    P = spark.createDataFrame(pd.DataFrame({"id": [0, 1, 2], "g": 0, "lon": [0.0, 90.0, -90.0], "lat": [0.0, 10.0, 20.0]}))
    keep = lambda n: spark.createDataFrame([(0, n)], "g int, keep int")
    assert T.trim_densest(P, "id", "g", keep(1)).count() == 2
    with pytest.raises(ValueError):
        T.trim_densest(P, "id", "g", keep(0))
    with pytest.raises(ValueError):
        T.trim_densest(P, "id", "g", keep(1), (5000.0,))


def test_separation_sweep_equals_single_runs(spark, sides):
    L, _ = sides
    D = dist(L, L)
    got = T.separation_sweep(spark.createDataFrame(L), "id", [2000.0, 6000.0, 15000.0]).toPandas().set_index("separation")
    for s in got.index:
        lab = np.arange(len(L))
        while True:
            new = np.array([lab[D[i] <= s].min() for i in range(len(L))])
            if (new == lab).all():
                break
            lab = new
        n = np.bincount(lab)
        assert (got.clusters[s], got.largest[s]) == ((n > 0).sum(), n.max())
