"""Areas of exact draws without a row for each draw, against those of drawn rows."""

import numpy as np
import pandas as pd
import pytest

from heliograde.functions import hashing as H
from heliograde.operators import bootstrap as B


def test_exact_areas_equal_those_of_drawn_rows(spark):
    rng = np.random.default_rng(4)
    d = pd.DataFrame({"g": rng.choice(["a", "b"], 700, p=[0.9, 0.1]), "label": (rng.random(700) < 0.3).astype(int), "score": rng.integers(0, 40, 700) / 30})
    d.loc[::50, "score"] = np.nan
    d = pd.concat([d, pd.DataFrame({"g": ["c"], "label": [1], "score": [0.5]})])  # a group without a second class
    d["idx"] = d.groupby(["g", "label"]).cumcount()
    rows = spark.createDataFrame(d)
    want = B.drawn_auc(B.drawn_rows(rows, ["g"], "label", "idx", 23), ["g"], "score").toPandas()
    for sizes in ({}, {"block": 100, "held": 64}):  # several blocks and parts of a class
        got = B.exact_auc(rows, ["g"], "score", reps=23, **sizes).toPandas()
        both = got.merge(want, on=["g", "rep"], how="outer")
        assert len(both) == len(want) == 69 and both[both.g == "c"].auc_x.isna().all()
        assert both.auc_x.to_numpy() == pytest.approx(both.auc_y.to_numpy(), abs=1e-12, nan_ok=True)


def test_ranks_of_several_widths_in_one_class(spark):
    """Ranks of one, two and four bytes, replicates over a turn's end, and no group at all."""
    n = 70_000
    d = pd.DataFrame({"label": [0] * n + [1] * 50, "score": [*(np.arange(n) / n), *np.linspace(0, 1, 50)], "idx": [*range(n), *range(50)]})
    got = B.exact_auc(spark.createDataFrame(d), [], "score", reps=103, held=200).toPandas()
    assert sorted(got.rep) == list(range(103))
    for rep in (0, 102):
        pick = [H.hash_array(H.hash_array(np.arange(m) * 2 + k, 1) ^ H.hash_array(np.array([rep]), 2)) % m for k, m in ((0, n), (1, 50))]
        neg, pos = np.sort(d.score.to_numpy()[:n][pick[0]]), d.score.to_numpy()[n:][pick[1]]
        want = (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / (2 * n * 50)
        assert got.auc[got.rep == rep].tolist() == pytest.approx([want], abs=1e-12)


def test_every_replicate_is_drawn(spark, tmp_path):
    """The query and its SQL twin draw all replicates, and agree."""
    import duckdb

    from heliograde.plans import evaluation  # noqa: F401
    from heliograde.plans.registry import ORACLES, QUERIES

    orders = pd.DataFrame({"o_orderkey": range(1, 121), "o_custkey": [k * 7 % 31 for k in range(120)], "o_totalprice": [k * 37.5 + 900 for k in range(120)], "o_orderstatus": ["FOP"[k % 3] for k in range(120)]})
    orders.to_parquet(tmp_path / "orders.parquet")
    got = QUERIES["e9_bootstrap_ci_exact"](spark, str(tmp_path)).toPandas().sort_values("country")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet')")
    want = con.execute(ORACLES["e9_bootstrap_ci_exact"]).df().sort_values("country")
    assert got.reps.tolist() == want.reps.tolist() == [2000] * 5
    assert got[["lo", "hi", "se"]].to_numpy() == pytest.approx(want[["lo", "hi", "se"]].to_numpy(), abs=1e-12)
