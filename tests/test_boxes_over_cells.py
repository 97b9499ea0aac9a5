"""Points in boxes that lie over each other by the hundred, against brute force."""

import numpy as np
import pandas as pd

from heliograde.operators import spatial as G


def test_first_of_many_boxes(spark):
    rng = np.random.default_rng(12)
    w = 10 ** rng.uniform(-3, 0.5, 300)
    x, y = rng.uniform(-1, 1, 300), rng.uniform(-1, 1, 300)
    B = pd.DataFrame({"bid": rng.permutation(300), "minx": x, "miny": y, "maxx": x + w, "maxy": y + w / 2})
    B.loc[:99, ["minx", "miny", "maxx", "maxy"]] = [-0.64, 0.16, 0.0, 0.64]  # copies that end where cells end
    P = pd.DataFrame({"pid": np.arange(600), "lon": rng.uniform(-1.2, 2, 600), "lat": rng.uniform(-1.2, 1.5, 600)})
    P.loc[:299, "lon"] = rng.choice(np.append(B.minx, B.maxx), 300)
    P.loc[:199, "lat"] = rng.choice(np.append(B.miny, B.maxy), 200)
    P.loc[:50] = P.loc[51:101].assign(pid=np.arange(51)).values  # positions that repeat
    inside = np.array([[b.minx <= p.lon <= b.maxx and b.miny <= p.lat <= b.maxy for b in B.itertuples()] for p in P.itertuples()])
    want = [int(B.bid[r].min()) if r.any() else -1 for r in inside]
    points = spark.createDataFrame(P.astype({"pid": "int64"})).union(spark.sql("SELECT 600L, CAST(NULL AS DOUBLE), 0.0D"))
    got = G.first_containing(points, spark.createDataFrame(B), "bid").toPandas().set_index("pid").sort_index()
    assert list(got.bid.fillna(-1).astype(int)) == want + [-1]
    some = G.inside_any(points, spark.createDataFrame(B)).toPandas()
    assert sorted(some.pid) == [i for i, v in enumerate(want) if v >= 0]
    none = G.first_containing(points, spark.createDataFrame(B).limit(0), "bid")
    assert none.count() == 601 and none.filter("bid IS NOT NULL").isEmpty()
