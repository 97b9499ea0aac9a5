"""Candidate pools settled by cell, against brute force."""

import numpy as np
import pandas as pd
from test_spatial import dist

from heliograde.operators import candidates as C
from heliograde.operators import spatial as G


def test_only_cells_at_a_limit_are_searched_by_candidate(spark, monkeypatch):
    rng = np.random.default_rng(6)
    P = pd.DataFrame({"id": np.arange(3000), "lon": 10 + rng.random(3000) * 0.7, "lat": 40 + rng.random(3000) * 0.7})
    P.loc[:9, ["lon", "lat"]] = P.loc[10, ["lon", "lat"]].values
    S = pd.DataFrame({"sid": np.arange(4), "lon": [10.1, 10.1, 10.3, 10.35], "lat": [40.1, 40.1, 40.3, 40.25]})
    d = dist(P, S).min(1)
    edge = float(d[500])  # a candidate lies at the limit
    searched, search = [], G.nearest_within
    monkeypatch.setattr(G, "nearest_within", lambda left, *a: searched.append(left.count()) or search(left, *a))
    points = spark.createDataFrame(P).union(spark.sql("SELECT 9999L, CAST(NULL AS DOUBLE), 40.0D"))
    for clear, reach in ((5000.0, 20000.0), (edge, 30000.0), (2000.0, max(edge, 9000.0))):
        got = C.candidate_pool(points, "id", spark.createDataFrame(S), "sid", clear, reach).toPandas()
        assert sorted(got.id) == list(np.flatnonzero((d >= clear) & (d <= reach)))
    assert len(searched) == 3 and max(searched) < 1000
