"""Grouped ridge fits against a plain solve for each group."""

import numpy as np
import pandas as pd
import pytest

from heliograde.operators.models import forest_within_budget, grouped_ridge


def plain(train, test, inputs, alpha):
    mean, sd = train[inputs].mean(), train[inputs].std(ddof=0).replace(0, 1)
    x = ((train[inputs] - mean) / sd).to_numpy()
    y = train.y.to_numpy()
    w = np.linalg.solve(x.T @ x + alpha * np.eye(len(inputs)), x.T @ (y - y.mean()))
    guess = ((test[inputs] - mean) / sd).to_numpy() @ w + y.mean()
    return 1 - ((test.y - guess) ** 2).sum() / ((test.y - test.y.mean()) ** 2).sum()


def test_grouped_ridge_equals_a_solve_per_group(spark):
    rng = np.random.default_rng(4)
    n = 3000
    df = pd.DataFrame({"g": rng.choice(["a", "a", "a", "b", "c"], n), "x1": rng.normal(1e5, 3, n), "x2": rng.random(n), "x3": 1.0, "flag": (rng.random(n) < 0.1) * 1.0})
    df["y"] = 0.3 * (df.x1 - 1e5) + df.x2 ** 2 - 2 * df.flag + rng.normal(0, 0.5, n) + 7
    df["held"] = rng.random(n) < 0.3
    few = pd.DataFrame({"g": "few", "x1": [1.0] * 9, "x2": 1.0, "x3": 1.0, "flag": 0.0, "y": 1.0, "held": False})
    flat = df[df.g == "b"].assign(g="flat", y=3.0)
    inputs = ["x1", "x2", "x3", "flag"]
    rows = pd.concat([df, few, flat])
    spoilt = pd.DataFrame({"g": ["a", None, "a"], "x1": [None, 1.0, 2.0], "x2": [1.0, 1.0, float("inf")], "x3": 1.0, "flag": 0.0, "y": 1.0, "held": [True, True, False]})
    shape = "g string, x1 double, x2 double, x3 double, flag double, y double, held boolean"
    both = spark.createDataFrame(rows, shape).unionByName(spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in spoilt.itertuples(index=False)], shape))
    got = grouped_ridge(both, "g", inputs, "y", "held", alpha=2.0, minimum=100).toPandas().set_index("g")
    assert set(got.index) == {"a", "b", "c", "flat"}
    for g in "abc":
        train, test = (df[(df.g == g) & (df.held == h)] for h in (False, True))
        assert (got.n_train[g], got.n_test[g]) == (len(train), len(test))
        assert got.r2[g] == pytest.approx(plain(train, test, inputs, 2.0), abs=1e-9)
        assert got.novelty[g] == pytest.approx(1 - got.r2[g])
    assert np.isnan(got.r2["flat"])
    assert grouped_ridge(both.limit(0), "g", inputs, "y", "held").count() == 0


def test_budget_below_a_node_a_tree_is_an_error(spark):
    with pytest.raises(ValueError):
        forest_within_budget(None, 39, trees=1)
