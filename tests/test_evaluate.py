"""Rank metrics against brute force: ties, empty classes, NULLs, forced cell splits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliograde.operators import bootstrap as B
from heliograde.operators import evaluate as E
from heliograde.operators import ranking as R
from heliograde.operators import summaries as A


def brute_auc(pos, neg):
    if len(pos) == 0 or len(neg) == 0:
        return None
    d = np.sign(np.asarray(pos)[:, None] - np.asarray(neg)[None, :])
    return float((d > 0).mean() + 0.5 * (d == 0).mean())


def brute_ap(pos, neg):
    s = np.r_[pos, neg]
    y = np.r_[np.ones(len(pos)), np.zeros(len(neg))]
    out, prev = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        m = s >= t
        tp = y[m].sum()
        out += (tp / len(pos) - prev) * tp / m.sum()
        prev = tp / len(pos)
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    rows = []
    for g, n in (("hot", 900), ("small", 40), ("tied", 30)):
        s = np.full(n, 0.5) if g == "tied" else np.round(rng.random(n), 2 if g == "small" else 3)
        rows.append(pd.DataFrame({"g": g, "score": s, "label": rng.integers(0, 2, n)}))
    rows.append(pd.DataFrame({"g": "one_class", "score": rng.random(10), "label": 1}))
    df = pd.concat(rows, ignore_index=True)
    df["id"] = np.arange(len(df))
    df.loc[df.id % 17 == 3, "score"] = np.nan
    df["w"] = rng.random(len(df)) * 5
    return df


@pytest.mark.parametrize("domain", [(0.0, 1.0), None])
def test_metrics_match_brute_force(spark, data, domain, monkeypatch):
    # Tiny limits force the hot group through the quantile cells.
    monkeypatch.setattr(R, "SPLIT_ABOVE", 50)
    monkeypatch.setattr(R, "SAMPLE_PER_GROUP", 40)
    got = E.country_report(spark.createDataFrame(data), ["g"], domain=domain).toPandas().set_index("g")
    for g, d in data.dropna(subset=["score"]).groupby("g"):
        pos, neg = d.score[d.label == 1].values, d.score[d.label == 0].values
        want = brute_auc(pos, neg)
        if want is None:
            assert pd.isna(got.loc[g, "roc"])
            continue
        assert got.loc[g, "roc"] == pytest.approx(want, abs=1e-6)
        assert got.loc[g, "pr"] == pytest.approx(brute_ap(pos, neg), abs=1e-6)
        pct = np.array([(neg < s).mean() for s in pos])
        assert got.loc[g, "median_site_pct"] == pytest.approx(100 * np.median(pct), abs=1e-5)
        assert got.loc[g, "top20"] == pytest.approx(100 * (pct >= 0.8).mean(), abs=1e-5)


def test_quantile_cells_split_the_hot_group(spark, data, monkeypatch):
    monkeypatch.setattr(R, "SPLIT_ABOVE", 50)
    monkeypatch.setattr(R, "SAMPLE_PER_GROUP", 100)
    d = R.value_counts(R.clean_scores(spark.createDataFrame(data), "score"), ["g"], "score", {"n": F.lit(1)})
    cells = R.with_cells(d, ["g"], "score", None).groupBy("g").agg(F.countDistinct(R.CELL).alias("c")).toPandas().set_index("g").c
    assert cells["hot"] > 10 and cells["tied"] == 1


def test_rank_invariance(spark, data):
    """A strictly rising rescale leaves the area alone."""
    df = spark.createDataFrame(data).withColumn("bent", F.exp(F.col("score") * 3))
    a = E.auc(df, ["g"]).toPandas().set_index("g").roc
    b = E.auc(df, ["g"], "bent", domain=None).toPandas().set_index("g").roc
    pd.testing.assert_series_equal(a.sort_index(), b.sort_index())


def test_weighted_auc(spark, data):
    got = E.weighted_auc(spark.createDataFrame(data), ["g"], F.col("w")).toPandas().set_index("g")
    d = data.dropna(subset=["score"]).query("g == 'hot'")
    p, neg = d[d.label == 1], d.score[d.label == 0].values
    frac = np.array([(neg < s).mean() + 0.5 * (neg == s).mean() for s in p.score])
    assert got.loc["hot", "roc_weighted"] == pytest.approx((p.w * frac).sum() / p.w.sum(), abs=1e-6)


@pytest.mark.parametrize("limit", [500_000, 20])
def test_quantiles_match_numpy(spark, data, monkeypatch, limit):
    monkeypatch.setattr(R, "SPLIT_ABOVE", limit)
    monkeypatch.setattr(R, "SAMPLE_PER_GROUP", 30)
    got = R.quantiles(spark.createDataFrame(data), ["g"], "score", {"a": 0.02, "m": 0.5, "z": 0.98}).toPandas().set_index("g")
    for g, d in data.dropna(subset=["score"]).groupby("g"):
        assert list(got.loc[g, ["a", "m", "z"]].astype(float)) == pytest.approx(list(np.percentile(d.score, [2, 50, 98])), abs=1e-12)


def test_average_rank_and_gini(spark, data):
    d = data.dropna(subset=["score"]).query("g == 'small'")
    ranks = R.with_rank(spark.createDataFrame(d), ["g"], "score", "r").toPandas().set_index("id").r.sort_index()
    assert list(ranks) == list(d.set_index("id").score.rank().sort_index())
    x = np.sort(d.w.values)
    n = len(x)
    want = (2 * np.arange(1, n + 1) - n - 1).dot(x) / (n * x.sum())
    assert A.gini(spark.createDataFrame(d), [], "w").first()[0] == pytest.approx(want, abs=1e-6)


def test_gini_of_nothing(spark):
    z = spark.createDataFrame(pd.DataFrame({"v": [0.0, 0.0]}))
    assert A.gini(z, [], "v").first()[0] is None
    assert A.gini(z, [], "v", empty=0.0).first()[0] == 0.0


def test_gains_curve(spark, data):
    d = data.dropna(subset=["score"]).query("g == 'hot'")
    got = E.gains_curve(spark.createDataFrame(d), [], F.col("w"), [0, 10, 50, 100]).toPandas().set_index("top_pct_land")
    pos, neg = d[d.label == 1], d.score[d.label == 0]
    for x in (10, 50, 100):
        t = np.percentile(neg, 100 - x)
        assert got.loc[x, "pct_weight"] == pytest.approx(100 * pos.w[pos.score >= t].sum() / pos.w.sum(), abs=1e-3)
    assert got.loc[0, "pct_weight"] == 0


def test_bootstrap_draws_are_n_of_n(spark, data):
    d = data.dropna(subset=["score"]).query("g == 'hot'")
    rows = R.hash_positions(spark.createDataFrame(d), ["g", "label"], F.col("id"), ["id"], 0, "p").withColumn("idx", F.col("p") - 1)
    times = B.draw_multiplicities(rows, ["g"], "label", "idx", 5).toPandas()
    per = times.groupby(["label", "rep"]).times.sum().unstack()
    for lab, n in d.label.value_counts().items():
        assert (per.loc[lab] == n).all()
    reps = B.drawn_auc(B.drawn_rows(rows, ["g"], "label", "idx", 5), ["g"], "score").toPandas()
    point = brute_auc(d.score[d.label == 1].values, d.score[d.label == 0].values)
    assert (abs(reps.auc - point) < 0.1).all() and reps.auc.nunique() == 5


def test_poisson_multiplicities(spark):
    t = spark.range(20000).select(B.poisson_times(F.col("id"), F.lit(3)).alias("t")).toPandas().t
    assert abs(t.mean() - 1) < 0.03 and abs(t.var() - 1) < 0.06


def test_replicate_accumulators_equal_resampled_rows(spark):
    """Sums of replicates give the areas of the rows drawn one by one; scores missing, equal, outside the range, groups of one class."""
    rng = np.random.default_rng(4)
    rows = [(int(k), f"g{k % 3}", float(np.round(rng.random() * 1.2 - 0.1, 2)) if k % 11 else None, float(rng.random()), int(rng.random() < 0.4) if k % 3 else 1) for k in range(900)]
    df = spark.createDataFrame(rows, "k long, g string, score double, score_b double, label int").repartition(5)
    got = B.replicate_auc(df, ["g"], ["score", "score_b"], "k", reps=20, seed=3, cells=7).toPandas()
    drawn = B.resampled(df, "k", 20, 3).toPandas()
    assert len(got) == 3 * 2 * 20
    for r in got.itertuples():
        d = drawn[(drawn.g == r.g) & (drawn.rep == r.rep)].dropna(subset=[r.which])
        pos, neg = d[d.label == 1], d[d.label == 0]
        won = sum(t * (neg.times[neg[r.which] < v].sum() + neg.times[neg[r.which] == v].sum() / 2) for v, t in zip(pos[r.which], pos.times, strict=True))
        want = won / (pos.times.sum() * neg.times.sum()) if len(pos) and len(neg) else None
        assert (want is None and np.isnan(r.auc)) or abs(r.auc - want) < 1e-12
    assert B.replicate_auc(df.limit(0), ["g"], ["score"], "k", reps=5).count() == 0


def test_hashes_in_batches_are_the_same(spark):
    from heliograde.functions import hashing as H

    df = spark.range(-50, 3000).withColumn("rep", F.col("id") % 7)
    both = df.select("id", H.draw_batches("id", "rep", 9).alias("d"), H.hash_order("id", 5).alias("h"), H.draw("id", "rep", 9).alias("d2")).toPandas()
    assert (both.d == both.d2).all() and (H.hash_array(both.id.to_numpy(), 5) == both.h).all()
