"""Trimming where positions hold many copies, against the loop."""

import numpy as np
import pandas as pd
from test_spatial import dist

from heliograde.operators import spatial as G
from heliograde.operators import thinning as T


def test_rounds_do_not_grow_with_copies(spark, monkeypatch):
    rng = np.random.default_rng(8)
    P = pd.DataFrame({"id": rng.permutation(60), "g": 0, "lon": 10 + rng.random(60) * 0.5, "lat": 40 + rng.random(60) * 0.5}).sort_values("id", ignore_index=True)
    P.loc[P.index % 3 > 0, ["lon", "lat"]] = [10.2, 40.2]  # 40 copies
    P.loc[[0, 9], ["lon", "lat"]] = [10.3, 40.3]
    D = dist(P, P)
    np.fill_diagonal(D, np.inf)
    alive, want = np.ones(60, bool), []
    while alive.sum() > 16:
        X = D.copy()
        X[~alive], X[:, ~alive] = np.inf, np.inf
        v = int(X.min(1).argmin())
        alive[v] = False
        want.append((int(P.id[v]), X[v].min()))
    rounds, search = [], G.nearest_other
    monkeypatch.setattr(G, "nearest_other", lambda *a, **k: rounds.append(1) or search(*a, **k))
    df = spark.createDataFrame(P).union(spark.sql("SELECT 77L, 0L, CAST(NULL AS DOUBLE), 1.0D"))
    got = T.trim_densest(df, "id", "g", spark.createDataFrame([(0, 17)], "g long, keep int")).orderBy("step").toPandas()
    assert list(zip(got.id, got.dist_m)) == sorted(want, key=lambda x: (x[1], x[0]))
    assert len(rounds) < 12
