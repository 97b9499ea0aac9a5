"""MCDA, moments, grids, logs, plans and the registry."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_queries import compare, connect
from heliograde.functions import scalars as X
from heliograde.operators import grids as GR
from heliograde.operators import mcda as M
from heliograde.operators import moments as MO
from heliograde.streaming import incremental as I

SF = "/root/testdata/sf0.001"


def test_topsis_and_weighted_sum(spark):
    rng = np.random.default_rng(0)
    n = 300
    df = pd.DataFrame({c: rng.random(n) for c in M.CHEN} | {"id": range(n), "country": "A", "label": rng.integers(0, 2, n), "worldcover": 20, "wdpa": 0.0})
    df.loc[5, "slope"] = np.nan
    df.loc[6, "worldcover"] = 80
    got = M.score_configs(spark.createDataFrame(df), "country", ["id"], {"chen": M.CHEN}, modes=("excl",)).toPandas()
    land = df[(df.label == 0)]
    N = {}
    for c in M.CHEN:
        lo, hi = np.nanpercentile(land[c], [2, 98])
        x = np.clip((df[c] - lo) / (hi - lo + 1e-12), 0, 1)
        N[c] = x if M.DIRECTION[c] == "b" else 1 - x
    w = {c: v / sum(M.CHEN.values()) for c, v in M.CHEN.items()}
    wlc = sum(w[c] * N[c] for c in w)
    dp, dn = np.sqrt(sum((w[c] * N[c] - w[c]) ** 2 for c in w)), np.sqrt(sum((w[c] * N[c]) ** 2 for c in w))
    want = {"wlc": wlc, "topsis": dn / (dp + dn + 1e-12)}
    for agg in want:
        g = got[got.aggregator == agg].set_index("id").mcda
        assert 5 not in g.index and g[6] == 0 and len(g) == n - 1
        keep = [i for i in g.index if i != 6]
        assert np.allclose(g[keep], want[agg][keep])


def test_moments_match_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 8)), rng.integers(0, 2, 200)
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "label": y, "emb": list(x)})).withColumn("label", F.col("label").cast("int"))
    m = MO.fit_moments(df, "label", "emb")
    for k in (0, 1):
        assert np.allclose(m[k]["mean"], x[y == k].mean(0)) and np.allclose(m[k]["cov"], np.cov(x[y == k].T, bias=True))
    s = MO.mahalanobis_scores(df, "emb", ["id"], m[1]["mean"], m[1]["cov"]).toPandas().set_index("id").score.sort_index()
    c = x - m[1]["mean"]
    inv = np.linalg.inv(m[1]["cov"] + 1e-3 * np.trace(m[1]["cov"]) / 8 * np.eye(8))
    assert np.allclose(s, -np.einsum("ij,jk,ik->i", c, inv, c))


def test_slope_matches_gradient(spark):
    rng = np.random.default_rng(2)
    e = rng.random((6, 7)) * 100
    g = pd.DataFrame([(r, c, e[r, c]) for r in range(6) for c in range(7)], columns=["ri", "ci", "e"])
    got = GR.slope_aspect(spark.createDataFrame(g), "e", 30.0).toPandas().pivot(index="ri", columns="ci", values="slope").values
    gy, gx = np.gradient(e, 30.0)
    assert np.allclose(got, np.degrees(np.arctan(np.hypot(gx, gy))))


def test_scalar_edge_cases(spark):
    df = spark.createDataFrame(pd.DataFrame({"t": ["2020-03-01T00:00", "unknown", None], "n": ["POS_IND_10859_2017_20.tif", "NEG_HUN_139_2022.tif", "junk"], "v": [-999.0, float("nan"), 3.0]}))
    r = df.select(X.date_year("t").alias("y"), X.parse_chip_name("n").alias("p"), X.without_nodata("v").alias("v")).collect()
    assert [x["y"] for x in r] == [2020, None, None]
    assert (r[0]["p"]["tile"], r[1]["p"]["tile"], r[1]["p"]["scene"], r[2]["p"]["kind"]) == (20, None, 139, None)
    assert [x["v"] for x in r] == [None, None, 3.0]


def test_results_log_and_resume(spark, tmp_path):
    p = str(tmp_path / "log")
    rows = spark.createDataFrame(pd.DataFrame({"experiment": ["a", "b"], "scope": ["x", "y"], "metric": "roc", "value": [0.1234567, 0.5]}))
    I.append_results(rows, p)
    I.append_results(rows.filter("experiment = 'a'"), p)
    log = spark.read.parquet(p)
    assert log.count() == 3 and log.filter("experiment = 'a'").first()["value"] == 0.12346
    assert set(log.columns) == set(I.RESULT_COLUMNS)
    work = spark.createDataFrame([("a",), ("c",)], "experiment string")
    assert [r[0] for r in I.remaining(work, log, ["experiment"]).collect()] == ["c"]
    I.append_stage(spark, str(tmp_path / "stages"), "train", "run", "ok", host="n1")
    assert spark.read.json(str(tmp_path / "stages")).first()["stage"] == "train"


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    p = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", "x", 0.1234567, "/w/m/1"), ("b", "y", None, "m/2"), (None, "z", 1.0, None)], "experiment string, scope string, value double, model_path string")
    rows = rows.withColumn("model_path", I.relative_path(F.col("model_path"), "/w"))
    for batch in ("one", "two", "two"):
        I.append_batch(rows, p, batch)
    got = I.read_results(spark, p)
    assert got.count() == 6 and {r[0] for r in got.select("batch").collect()} == {"one", "two"}
    assert {(r["experiment"], r["value"], r["model_path"]) for r in got.collect()} == {("a", 0.12346, "m/1"), ("b", None, "m/2"), (None, 1.0, None)}
    I.append_batch(rows.limit(0), p, "none")
    assert I.read_results(spark, p).count() == 6


def test_stored_rows_are_replaced_by_key(spark, tmp_path):
    p, shape = str(tmp_path / "t"), "experiment string, scope string, v long"
    table = lambda *rows: spark.createDataFrame(list(rows), shape)
    I.replace_stored(spark, p, table(("a", "x", 1), ("a", None, 2), ("b", "x", 3), (None, "x", 4)), ["experiment", "scope"], "experiment")
    new = table(("a", None, 20), ("a", "y", 21), (None, "x", 40))
    for _ in range(2):
        I.replace_stored(spark, p, new, ["experiment", "scope"], "experiment")
    got = {tuple(r) for r in spark.read.schema(shape).parquet(p).select("experiment", "scope", "v").collect()}
    assert got == {("a", "x", 1), ("a", None, 20), ("a", "y", 21), ("b", "x", 3), (None, "x", 40)}
    with pytest.raises(ValueError):
        I.replace_stored(spark, p, new, ["scope"], "experiment")


def test_pyramid_equals_block_sums(spark):
    rng = np.random.default_rng(3)
    cells = pd.DataFrame([(r, c) for r in range(23) for c in range(17)], columns=["ri", "ci"])
    x = rng.random((len(cells), 3))
    df = spark.createDataFrame(cells.assign(n=1, emb=list(x)))
    for f, level in GR.pyramid(df, [1, 3, 5, 10, 20], ["n"], "emb", 3).items():
        got = level.toPandas().set_index(["ri", "ci"]).sort_index()
        want = pd.DataFrame(x).groupby([cells.ri // f, cells.ci // f]).sum()
        assert len(got) == len(want) and got.n.sum() == len(cells) and np.allclose(np.stack(got.emb), want.values)


def test_latest_non_null_takes_columns_from_different_rows(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 1.0), (1, 2, None, 2.0)], "k int, t int, a double, b double")
    assert tuple(I.latest_non_null(df, "k", "t", ["a", "b"]).first()) == (1, 5.0, 2.0)


def test_filters_reach_the_scan(spark):
    q = entry.queries()["s3_pushed_predicate"](spark, SF)._jdf.queryExecution()
    plan = q.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "GreaterThanOrEqual(o_orderdate" in plan


def test_registry_is_complete(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 150 and set(o) <= set(q)
    assert len(o) > 125


@pytest.mark.parametrize("name", [
    "e6_forward_validation", "e17_gains_curve", "e10_paired_gap", "c5_config_matrix", "sm2_even_budget", "j9_nearest_within", "a18_covariance", "r4_resolution_ablation",
])
def test_against_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(entry.oracle_sql()[name]).df()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() == 10
