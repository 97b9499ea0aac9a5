"""Queries that fit models: no SQL twin except for their deterministic preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograde.functions.hashing import uniform
from heliograde.operators import evaluate as E
from heliograde.operators import models as ML
from heliograde.operators import moments as MO
from heliograde.operators import ranking as R
from heliograde.plans.registry import query
from heliograde.session import durable
from heliograde.sources import tables as T

KEEP = ["px_id", "label"]
COVARIATES = ["slope", "elevation", "grid", "ghi", "temp"]
CONTINUOUS = ["ghi", "pvout", "gti", "temp", "slope", "elevation", "grid"]  # road and popdens are missing on whole rows and countries
CLASSES = [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100]  # land cover, fixed values


def split(spark, sf):
    """Pixels split by chip, so that neighbours stay on one side."""
    p = T.pixels(spark, sf)
    u = uniform("chip", 11)
    return p.filter(u >= 0.3), p.filter(u < 0.3)


def judged(scores, method: str):
    """(method, n_sites, n_land, roc, pr) of a scored test table; any score scale."""
    rep = E.country_report(scores, [], domain=None)
    return rep.select(F.lit(method).alias("method"), "n_sites", "n_land", F.round("roc", 4).alias("roc"), F.round("pr", 4).alias("pr"))


def featured(df):
    return ML.with_features(df, "emb")


@query("m2_mahalanobis")
def mahalanobis(spark, sf):
    tr, te = split(spark, sf)
    m = MO.fit_moments(tr, "label", "emb")[1]
    return judged(MO.mahalanobis_scores(te, "emb", KEEP, m["mean"], m["cov"]), "mahalanobis")


@query("m3_kmeans_prototypes")
def kmeans(spark, sf):
    tr, te = split(spark, sf)
    out = None
    for k in (8, 16):
        row = judged(ML.multi_prototype(tr.filter("label = 1"), te, "emb", k, KEEP), f"kmeans_{k}")
        out = row if out is None else out.unionByName(row)
    return out


@query("m5_logistic_probe")
def logistic(spark, sf):
    tr, te = split(spark, sf)
    model = ML.logistic_probe(ML.with_balanced_weight(featured(tr)))
    return judged(ML.score_with(model, featured(te)).select(*KEEP, "score"), "logistic")


@query("m6_qda")
def qda(spark, sf):
    tr, te = split(spark, sf)
    return judged(MO.qda_scores(te, "emb", KEEP, MO.fit_moments(tr, "label", "emb")), "qda")


@query("m7_fourier_logistic")
def fourier(spark, sf):
    tr, te = split(spark, sf)
    f = lambda d: ML.with_features(ML.fourier_features(d, "emb", "rff", 512), "rff").drop("rff")
    model = ML.logistic_probe(ML.with_balanced_weight(f(tr)))
    return judged(ML.score_with(model, f(te)).select(*KEEP, "score"), "fourier")


@query("m8_l1_quadratic")
def l1(spark, sf):
    tr, te = split(spark, sf)
    f = lambda d: ML.with_features(ML.squares(d, "emb", "sq"), "sq").drop("sq")
    model = ML.l1_quadratic(ML.with_balanced_weight(f(tr)))
    return judged(ML.score_with(model, f(te)).select(*KEEP, "score"), "l1_quadratic")


@query("m9_forest_within_budget")
def forest(spark, sf):
    tr, te = split(spark, sf)
    model, leaf, size = ML.forest_within_budget(ML.with_balanced_weight(featured(tr)), 20_000, trees=10, depth=6)
    rep = judged(ML.score_with(model, featured(te)).select(*KEEP, "score"), "forest")
    return rep.withColumn("min_leaf", F.lit(leaf)).withColumn("size_bytes", F.lit(size))


@query("m10_boosted_and_perceptron")
def boosted(spark, sf):
    tr, te = split(spark, sf)
    train = durable(ML.with_balanced_weight(featured(tr)))
    a = judged(ML.score_with(ML.boosted(train, iters=10), featured(te)).select(*KEEP, "score"), "boosted")
    b = judged(ML.score_with(ML.perceptron(train, 64), featured(te)).select(*KEEP, "score"), "perceptron")
    return a.unionByName(b)


@query("m13_config_sweep")
def sweep(spark, sf):
    """Configurations over one materialised pool, 15 % held out, feasible if within the size budget."""
    p = durable(featured(T.pixels(spark, sf)).withColumn("u", uniform("px_id", 21)))
    train, hold = durable(ML.with_balanced_weight(p.filter("u >= 0.15"))), p.filter("u < 0.15")
    out = None
    for trees, depth in ((5, 4), (10, 4), (10, 6)):
        m = ML.forest(train, trees=trees, depth=depth)
        size = ML.forest_size(m)
        row = judged(ML.score_with(m, hold).select(*KEEP, "score"), f"ne{trees}_d{depth}").select(
            F.col("method").alias("tag"), F.lit(trees).alias("n_estimators"), F.lit(depth).alias("max_depth"), F.lit(size).alias("size_bytes"),
            F.lit(size <= 20_000).alias("feasible"), F.col("roc").alias("val_roc"), F.col("pr").alias("val_pr"))
        out = row if out is None else out.unionByName(row)
    return out


def _regression_split(spark, sf):
    c = T.criteria(spark, sf).withColumn("key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return ML.hash_split(c, "key", 5)


@query("m14_covariate_novelty")
def novelty(spark, sf):
    """How much of the score the covariates explain: ridge and forest R2, novelty = 1 - R2."""
    tr, te = _regression_split(spark, sf)
    tr = durable(tr)
    rows = []
    for kind in ("ridge", "forest"):
        r2, _ = ML.regression_r2(tr, te, COVARIATES, "score", kind)
        rows.append(F.struct(F.lit(kind).alias("model"), F.lit(round(r2, 4)).alias("r2"), F.lit(round(1 - r2, 4)).alias("novelty")))
    return te.agg(F.count(F.lit(1)).alias("n_test")).select("n_test", F.inline(F.array(*rows)))


@query("m14_country_novelty")
def country_novelty(spark, sf):
    """As m14 for each country: random land alone, land-cover flags and protection among the inputs, ridge."""
    c = T.criteria(spark, sf).filter("label = 0 AND worldcover IS NOT NULL").drop("aspect")
    flagged, flags = ML.one_hot_land(c, "worldcover", CLASSES)
    held = flagged.withColumn("held", uniform(F.col("l_orderkey") * 8 + F.col("l_linenumber"), 5) < 0.3)
    r = ML.grouped_ridge(held, "country", [*CONTINUOUS, *flags, "wdpa"], "score", "held")
    return r.select("country", "n_train", "n_test", F.round("r2", 6).alias("r2"), F.round("novelty", 6).alias("novelty"))


@query("m15_permutation_importance")
def permutation(spark, sf):
    """Drop in R2 when one covariate is shuffled, mean over repeats."""
    target = F.col("ghi") / 100000 + F.col("slope") / 100
    tr, te = (d.withColumn("target", target) for d in _regression_split(spark, sf))
    _, model = ML.regression_r2(tr, te, COVARIATES, "target", "ridge")
    base = model.transform(te).select(F.lit("").alias("feature"), F.lit(0).alias("rep"), "target", "prediction")
    perm = ML.permuted_scores(model, te, COVARIATES, "key", ["target"], 2)
    y, e = F.col("target"), F.col("target") - F.col("prediction")
    r2 = base.unionByName(perm).groupBy("feature", "rep").agg((1 - F.sum(e * e) / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2"))
    r2 = durable(r2)
    full = r2.filter("feature = ''").select(F.col("r2").alias("full"))
    return r2.filter("feature <> ''").transform(R.attach_row, full).groupBy("feature").agg(F.round(F.avg(F.col("full") - F.col("r2")), 4).alias("importance"))


@query("m16_one_hot_land", "SELECT country, " + ", ".join(f"round(avg(coalesce((worldcover = {c})::INTEGER, 0)), 6) AS wc_{c}" for c in CLASSES) + " FROM criteria GROUP BY country", ("criteria",))
def one_hot(spark, sf):
    df, names = ML.one_hot_land(T.criteria(spark, sf), "worldcover", CLASSES)
    return df.groupBy("country").agg(*[F.round(F.avg(n), 6).alias(n) for n in names])


@query("m17_feature_set_comparison")
def feature_sets(spark, sf):
    """Same split, with and without the aspect term."""
    tr, te = _regression_split(spark, sf)
    tr = durable(tr)
    a, _ = ML.regression_r2(tr, te, COVARIATES, "score")
    b, _ = ML.regression_r2(tr, te, [*COVARIATES, "aspect"], "score")
    return te.agg(F.count(F.lit(1)).alias("n_test")).select(
        "n_test", F.lit(round(a, 4)).alias("r2_base"), F.lit(round(b, 4)).alias("r2_with"), F.lit(round(b - a, 4)).alias("delta"))


@query("m19_validation_ladder")
def ladder(spark, sf):
    """Rungs per model: held-out pixels, per-country weighted and macro mean, lead times."""
    tr, te = split(spark, sf)
    train, out = durable(ML.with_balanced_weight(featured(tr))), None
    for trees in (5, 10):
        m = ML.forest(train, trees=trees, depth=5)
        scored = durable(ML.score_with(m, featured(te)).select(*KEEP, "iso3", "year", "score"))
        per = E.auc(scored, ["iso3"]).agg((F.sum(F.col("roc") * F.col("n_pos")) / F.sum("n_pos")).alias("v"), F.avg("roc").alias("m"))
        country = per.select(F.inline(F.array(
            F.struct(F.lit("country_weighted").alias("rung"), F.col("v").alias("value")), F.struct(F.lit("country_macro").alias("rung"), F.col("m").alias("value")))))
        pixel = E.auc(scored, []).select(F.lit("pixel").alias("rung"), F.col("roc").alias("value"))
        lead = E.auc(scored, ["year"]).select(F.concat(F.lit("L"), (F.col("year") - 2015).cast("string")).alias("rung"), F.col("roc").alias("value"))
        rows = pixel.unionByName(country).unionByName(lead).select(F.lit(f"ne{trees}").alias("model"), "rung", F.round("value", 4).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("m20_batch_scoring")
def batch(spark, sf):
    p = featured(T.pixels(spark, sf))
    m = ML.forest(ML.with_balanced_weight(p), trees=5, depth=5)
    return ML.score_with(m, p).select("px_id", F.round("score", 6).alias("score"))


@query("e22_leave_one_country_out")
def loco(spark, sf):
    """Reference model against models that never saw the country; each is a filter on one pool."""
    p = durable(ML.with_balanced_weight(featured(T.pixels(spark, sf))))
    ref = ML.forest(p, trees=5, depth=4)
    base = E.auc(ML.score_with(ref, p).select(*KEEP, "iso3", "score"), ["iso3"]).select("iso3", F.col("roc").alias("reference_roc"))
    out = None
    for row in p.select("iso3").distinct().orderBy("iso3").collect():  # one fit per country
        c = row["iso3"]
        m = ML.forest(p.filter(F.col("iso3") != c), trees=5, depth=4)
        held = ML.score_with(m, p.filter(F.col("iso3") == c)).select(*KEEP, "iso3", "score")
        out = held if out is None else out.unionByName(held)
    r = E.auc(out, ["iso3"]).select("iso3", F.col("roc").alias("loco_roc"))
    return base.join(r, "iso3").withColumn("gap", F.round(F.col("reference_roc") - F.col("loco_roc"), 6))
