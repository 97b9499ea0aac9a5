"""Comparing models, pools and groups by metrics already computed per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograde.functions.hashing import draw
from heliograde.operators import evaluate as E
from heliograde.operators import pairs as P
from heliograde.operators import ranking as R


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """Distinct keys numbered from 0 in key order, through running sums."""
    dist = df.groupBy(key).agg(F.lit(1).alias("one"))
    return R.running_sums(dist, [], key, ["one"]).select(key, F.col("below_one").alias(out), F.col("total_one").alias("k"))


def _best(score, config: str):
    """Config with the highest score, the smallest config on ties (nine places)."""
    return F.max_by(F.col(config), F.struct(F.round(score, 9), -F.col(config)))


def bootstrap_over_groups(metrics: DataFrame, group: str, config: str, value: str, weight: str, reps: int) -> DataFrame:
    """Share of resamples of the groups in which each config wins, plain and weighted."""
    ids = numbered(metrics, group, "ci")
    draws = ids.select("ci", "k", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    picks = draws.select("rep", F.pmod(draw("ci", "rep"), F.col("k")).alias("ci")).groupBy("rep", "ci").agg(F.count(F.lit(1)).alias("t"))
    rows = picks.join(ids.select(group, "ci"), "ci").join(metrics, group)
    means = rows.groupBy("rep", config).agg(
        (F.sum(F.col("t") * F.col(value)) / F.sum("t")).alias("macro"),
        (F.sum(F.col("t") * F.col(value) * F.col(weight)) / F.sum(F.col("t") * F.col(weight))).alias("weighted"),
    )
    best = means.groupBy("rep").agg(_best(F.col("macro"), config).alias("bm"), _best(F.col("weighted"), config).alias("bw"))
    won = best.select(F.inline(F.array(
        F.struct(F.col("bm").alias(config), F.lit(1).alias("m"), F.lit(0).alias("w")), F.struct(F.col("bw").alias(config), F.lit(0).alias("m"), F.lit(1).alias("w")),
    ))).groupBy(config).agg(F.sum("m").alias("m"), F.sum("w").alias("w"))
    return metrics.select(config).distinct().join(won, config, "left").select(
        config, F.round(F.coalesce("m", F.lit(0)) / float(reps), 6).alias("p_best_macro"), F.round(F.coalesce("w", F.lit(0)) / float(reps), 6).alias("p_best_weighted")
    )


def leave_one_group_out(metrics: DataFrame, group: str, config: str, value: str) -> DataFrame:
    """Best config with each group left out: totals minus the group's own row, no pairing of groups. Values count in whole millionths, so
    that sums are the same in any order of rows.

    A group without some config drops nothing from its total; the best of those configs is one of the whole table's best, so configs
    are ranked once and each group looks only at its own rows and at the first config that it does not have.
    """
    own = metrics.select(F.col(group).alias("dropped"), F.col(config).alias("config"), F.round(F.col(value) * 1e6).cast("bigint").alias("__v"))
    total = own.groupBy("config").agg(F.sum("__v").alias("__s"), F.count("__v").alias("__n"))
    mean = lambda s, n: s.cast("double") / F.nullif(n, F.lit(0)) / 1e6
    order = Window.orderBy(F.desc(F.round("__m", 9)), "config")  # one row for each config
    ranked = total.withColumn("__m", mean(F.col("__s"), F.col("__n"))).withColumn("__rank", F.row_number().over(order))
    both = own.join(ranked, "config")
    less = both.select("dropped", "config", mean(F.col("__s") - F.coalesce("__v", F.lit(0)), F.col("__n") - F.col("__v").isNotNull().cast("int")).alias("macro"))
    placed = both.withColumn("__at", F.row_number().over(Window.partitionBy("dropped").orderBy("__rank")))
    gap = placed.groupBy("dropped").agg(F.coalesce(F.min(F.when(F.col("__at") < F.col("__rank"), F.col("__at"))), F.count(F.lit(1)).cast("int") + 1).alias("__rank"))
    lacking = gap.join(ranked, "__rank").select("dropped", "config", F.col("__m").alias("macro"))
    left = less.unionByName(lacking)
    return left.groupBy("dropped").agg(_best(F.col("macro"), "config").alias("best_config"), F.round(F.max("macro"), 6).alias("best_macro"))


def mean_rank(metrics: DataFrame, group: str, config: str, value: str) -> DataFrame:
    """Average over groups of a config's rank inside the group (1 = best, ties share)."""
    ranked = R.with_rank(metrics, [group], value, "__rk", descending=True)
    return ranked.groupBy(config).agg(F.round(F.avg("__rk"), 6).alias("mean_rank"))


def winner_and_gap(metrics: DataFrame, group: str, config: str, value: str, reference) -> DataFrame:
    """Winning config per group, how far the reference config is behind, and the winner's total wins."""
    best = metrics.groupBy(group).agg(
        F.max_by(F.col(config), F.struct(F.col(value), -F.col(config))).alias("winner"), F.max(value).alias("__best"),
        F.max(F.when(F.col(config) == reference, F.col(value))).alias("__ref"),
    )
    wins = best.groupBy("winner").agg(F.count(F.lit(1)).alias("wins_of_winner"))
    return best.join(wins, "winner").select(group, "winner", F.round(F.col("__ref") - F.col("__best"), 6).alias("gap"), "wins_of_winner")


def ordinal_rank(df: DataFrame, group: list[str], value: str, key: str, out: str, domain=None) -> DataFrame:
    """1-based rank with ties in key order: rank of the value plus position inside the tie."""
    dist = R.value_counts(R.clean_scores(df, value), group, value, {"n": F.lit(1)})
    first = R.running_sums(dist, group, value, ["n"], domain).select(*group, value, "below_n")
    # A value shared by very many rows is itself a group to be cut into cells.
    tie = R.running_sums(df.select(*group, value, key).withColumn("one", F.lit(1)), [*group, value], key, ["one"])
    place = tie.select(*group, value, key, (F.col("below_one") + 1).alias("__in"))
    return df.join(first, [*group, value]).join(place, [*group, value, key]).withColumn(out, F.col("below_n") + F.col("__in")).drop("below_n", "__in")


def auc_by_bin(df: DataFrame, value: str, bins: list[tuple[str, float, float]], out: str, score: str = "score", label: str = "label") -> DataFrame:
    """ROC of the positives in each [lo, hi) bin against all land."""
    b = None
    for name, lo, hi in bins:
        inside = (F.col(value) >= lo) & (F.col(value) < hi)
        b = F.when(inside, F.lit(name)) if b is None else b.when(inside, F.lit(name))
    return auc_by_key_shared_land(df.withColumn(out, b), out, 1, score, label)


def auc_by_key_shared_land(df: DataFrame, key: str, minimum: int, score: str = "score", label: str = "label") -> DataFrame:
    """ROC of positives by ``key`` (at least ``minimum`` of them) against the same land each.

    Land is ranked once; every positive score reads off the land below it, so nothing is
    repeated per key.
    """
    clean = R.clean_scores(df, score)
    is_land = F.col(label) == 0
    land = R.value_counts(clean, [], score, {"neg": F.when(is_land, 1).otherwise(0)})
    ranked = R.running_sums(land, [], score, ["neg"], E.UNIT)
    pos = clean.filter(~is_land & F.col(key).isNotNull()).groupBy(key, score).agg(F.count(F.lit(1)).alias("pos"))
    d = lambda c: F.col(c).cast("double")
    won = F.sum(d("pos") * (d("below_neg") + d("neg") / 2))
    per = pos.join(ranked, score).groupBy(key).agg(
        F.sum("pos").alias("n_pos"), F.max("total_neg").alias("n_neg"), F.round(won / F.nullif(F.sum(d("pos")) * F.max(d("total_neg")), F.lit(0.0)), 6).alias("roc")
    )
    return per.filter(F.col("n_pos") >= minimum)


def metric_gap(a: DataFrame, b: DataFrame, keys: list[str], name_a: str, name_b: str, value: str = "roc") -> DataFrame:
    """Two runs of one metric side by side and their difference."""
    return a.select(*keys, F.col(value).alias(name_a)).join(b.select(*keys, F.col(value).alias(name_b)), keys).withColumn(
        "gap", F.round(F.col(name_a) - F.col(name_b), 6)
    )


def stack_criteria(df: DataFrame, keep: list[str], criteria: list[str]) -> DataFrame:
    """(keep..., criterion, value) without missing values."""
    long = df.select(*keep, F.inline(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("value")) for c in criteria])))
    return R.clean_scores(long, "value")


def covariate_discrimination(df: DataFrame, group: list[str], criteria: list[str]) -> DataFrame:
    """How well each raw criterion alone separates sites from land, with both medians."""
    side = df.filter(F.col("label").isin(0, 1)).withColumn("__side", F.col("label"))
    med = P.quantiles(side, [*group, "__side"], criteria, {"__m": 0.5})
    at = lambda v: F.max(F.when(F.col("__side") == v, F.col("__m")))
    med = med.groupBy(*group, "criterion").agg(at(1).alias("median_sites"), at(0).alias("median_land"))
    d = P.column_areas(df, group, criteria).withColumnRenamed("auc", "__auc").join(med, [*group, "criterion"])
    return d.select(
        *group, "criterion", F.round("__auc", 6).alias("auc"), F.round(F.abs(2 * F.col("__auc") - 1), 6).alias("discrimination"),
        F.round("median_sites", 6).alias("median_sites"), F.round("median_land", 6).alias("median_land"),
    )


def expert_vs_empirical(df: DataFrame, group: list[str], criteria: list[str], weights: dict[str, float]) -> DataFrame:
    """Published weight share next to the share of mean discrimination, over common criteria."""
    d = P.column_areas(df, group, criteria).groupBy("criterion").agg(F.avg(F.abs(2 * F.col("auc") - 1)).alias("__d"))
    w = None
    for c, v in weights.items():
        w = F.when(F.col("criterion") == c, F.lit(v)) if w is None else w.when(F.col("criterion") == c, F.lit(v))
    both = d.withColumn("__w", w).filter(F.col("__w").isNotNull())
    total = both.agg(F.sum("__w").alias("__tw"), F.sum("__d").alias("__td"))
    return both.transform(R.attach_row, total).select(
        "criterion", F.round(F.col("__w") / F.col("__tw"), 6).alias("expert_share"), F.round(F.col("__d") / F.col("__td"), 6).alias("empirical_share")
    )


def top_share_auc(df: DataFrame, group: str, score: str, covariate: str, q: float) -> DataFrame:
    """Rank AUC of a covariate for belonging to the top of the score (inclusive threshold)."""
    thr = R.quantiles(df, [group], score, {"__thr": q}, E.UNIT)
    tagged = df.join(thr, group).select(group, covariate, (F.col(score) >= F.col("__thr")).cast("int").alias("label"))
    return E.auc(tagged, [group], covariate, domain=None).select(group, F.col("n_pos").alias("n_top"), "roc")


def binned_medians(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Median of ``y`` in equal-count bins of ``x``; tied x values stay in one bin."""
    ranked = R.with_rank(df, [], x, "__rk")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    b = F.least(F.floor((F.col("__rk") - 0.5) / F.col("__n") * bins), F.lit(bins - 1)).cast("bigint")
    binned = ranked.transform(R.attach_row, n).withColumn("decile", b)
    med = R.quantiles(binned, ["decile"], y, {"median_score": 0.5}, E.UNIT).withColumn("median_score", F.round("median_score", 6))
    rest = binned.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean_x"))
    return rest.join(med, "decile")


def suitable_share(df: DataFrame, q: float, score: str = "score", label: str = "label") -> DataFrame:
    """Threshold = q quantile of site scores; share of land at or above it."""
    thr = R.quantiles(df.filter(F.col(label) == 1), [], score, {"threshold": q}, E.UNIT)
    land = R.clean_scores(df, score).filter(F.col(label) == 0)
    return land.transform(R.attach_row, thr).agg(
        F.round(F.max("threshold"), 6).alias("threshold"), F.round(F.avg((F.col(score) >= F.col("threshold")).cast("double")), 6).alias("suitable_fraction")
    )


def weakest_first(per: DataFrame, group: str, metric: str, volume: str) -> DataFrame:
    """Groups from the weakest metric up, with the rank correlation of metric and volume."""
    rho = E.spearman(per, [], metric, volume).select("rho")
    ranked = ordinal_rank(per, [], metric, group, "weakness_rank")
    return ranked.transform(R.attach_row, rho).select(group, metric, volume, "weakness_rank", "rho")


def lag_matrix(df: DataFrame, models: dict[str, str], land_lag: str, label: str = "label") -> DataFrame:
    """ROC for every (training lag, land lag), pivoted, with the gap of the matched diagonal."""
    long = df.select(label, land_lag, F.inline(F.array(*[F.struct(F.lit(k).alias("train_lag"), F.col(c).alias("v")) for k, c in models.items()])))
    a = E.auc(long, ["train_lag", land_lag], "v")
    lags = list(models)
    wide = a.groupBy("train_lag").agg(*[F.max(F.when(F.col(land_lag) == g, F.col("roc"))).alias(f"land_{g}") for g in lags])
    both = [F.max(F.when((F.col("train_lag") == g) & (F.col(land_lag) == g), F.col("roc"))) for g in lags]
    gap = a.agg(F.round(both[0] - both[1], 6).alias("matched_gap"))
    return wide.transform(R.attach_row, gap)
