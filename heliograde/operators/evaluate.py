"""Rank metrics of scores: does the score put sites above random land?

Everything is read off one table, ``score_profile``: one row per (group, distinct score)
with the positive and negative mass at and below that score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograde.operators import ranking as R

UNIT = (0.0, 1.0)


def score_profile(
    df: DataFrame,
    group: list[str],
    score: str = "score",
    label: str = "label",
    weight: Column | None = None,
    domain: tuple[float, float] | None = UNIT,
) -> DataFrame:
    """Positive and negative mass per distinct score with its running sums.

    Columns: ``pos, neg`` (counts), ``wpos`` (positive weight), and ``below_*``/``total_*``.
    """
    is_pos = F.col(label) == 1
    sums = {"pos": F.when(is_pos, 1).otherwise(0), "neg": F.when(~is_pos, 1).otherwise(0)}
    if weight is not None:
        sums["wpos"] = F.when(is_pos, weight).otherwise(0.0)
    dist = R.value_counts(R.clean_scores(df, score), group, score, sums)
    return R.running_sums(dist, group, score, list(sums), domain)


def count_profile(df: DataFrame, group: list[str], score: str = "score", pos: str = "pos", neg: str = "neg",
                  domain: tuple[float, float] | None = UNIT) -> DataFrame:
    """``score_profile`` of rows that stand for ``pos`` sites and ``neg`` land points with one score."""
    dist = R.value_counts(R.clean_scores(df, score), group, score, {"pos": F.col(pos), "neg": F.col(neg)})
    return R.running_sums(dist, group, score, ["pos", "neg"], domain)


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def auc_expr(pos: str = "pos", neg: str = "neg") -> Column:
    """P(pos > neg) + P(pos = neg) / 2; NULL when a class is empty."""
    won = F.sum(_d(pos) * (_d(f"below_{neg}") + _d(neg) / 2))
    pairs = F.max(_d(f"total_{pos}")) * F.max(_d(f"total_{neg}"))
    return won / F.nullif(pairs, F.lit(0.0))


def average_precision_expr() -> Column:
    """Sum of recall steps times precision, thresholds taken from the top score down."""
    tp = _d("total_pos") - _d("below_pos")
    fp = _d("total_neg") - _d("below_neg")
    return F.sum(_d("pos") * tp / (tp + fp)) / F.nullif(F.max(_d("total_pos")), F.lit(0.0))


def land_percentile(ties: str = "strict") -> Column:
    """Share of negatives below a score: strictly, or with half of the ties."""
    num = _d("below_neg") + (_d("neg") / 2 if ties == "mid" else F.lit(0.0))
    return num / F.nullif(_d("total_neg"), F.lit(0.0))


def top_share_expr(pct: float, ties: str = "strict") -> Column:
    """Share of positives at or above a land percentile."""
    inside = F.sum(F.when(land_percentile(ties) >= pct, _d("pos")).otherwise(0.0))
    return inside / F.nullif(F.max(_d("total_pos")), F.lit(0.0))


def weighted_median_percentile(ties: str = "strict") -> Column:
    """Median land percentile of the positives (percentile rises with score, so positions carry over)."""
    first, size, total = _d("below_pos"), _d("pos"), _d("total_pos")
    pos = (total - 1) / 2
    at = lambda k: F.max(F.when((first <= k) & (k < first + size), land_percentile(ties)))
    return (at(F.floor(pos)) + at(F.ceil(pos))) / 2


def _by(profile: DataFrame, group: list[str], exprs: list[Column]) -> DataFrame:
    return profile.groupBy(*group).agg(*exprs) if group else profile.agg(*exprs)


def country_report(df: DataFrame, group: list[str], score: str = "score", label: str = "label", ties: str = "strict",
                   domain=UNIT) -> DataFrame:
    """The headline table: ROC, PR and its chance level, site percentiles, top 20/10/5 % shares."""
    return report(score_profile(df, group, score, label, domain=domain), group, ties)


def report(p: DataFrame, group: list[str], ties: str = "strict") -> DataFrame:
    """The headline table of a profile."""
    n_pos, n_neg = F.max("total_pos"), F.max("total_neg")
    return _by(p, group, [
        n_pos.alias("n_sites"),
        n_neg.alias("n_land"),
        F.round(auc_expr(), 6).alias("roc"),
        F.round(average_precision_expr(), 6).alias("pr"),
        F.round(n_pos / (n_pos + n_neg), 6).alias("pr_chance"),
        F.round(weighted_median_percentile(ties) * 100, 6).alias("median_site_pct"),
        F.round(top_share_expr(0.80, ties) * 100, 6).alias("top20"),
        F.round(top_share_expr(0.90, ties) * 100, 6).alias("top10"),
        F.round(top_share_expr(0.95, ties) * 100, 6).alias("top5"),
    ])


def auc(df: DataFrame, group: list[str], score: str = "score", label: str = "label", domain=UNIT, digits: int = 6) -> DataFrame:
    """ROC area per group with class sizes."""
    p = score_profile(df, group, score, label, domain=domain)
    return _by(p, group, [
        F.max("total_pos").alias("n_pos"), F.max("total_neg").alias("n_neg"), F.round(auc_expr(), digits).alias("roc"),
    ])


def weighted_auc(df: DataFrame, group: list[str], weight: Column, score: str = "score", label: str = "label", domain=UNIT) -> DataFrame:
    """ROC area with positives weighted (capacity, generation) next to the plain one."""
    p = score_profile(df, group, score, label, weight, domain)
    wa = F.sum(F.col("wpos") * (_d("below_neg") + _d("neg") / 2)) / F.nullif(
        F.max(F.col("total_wpos")) * F.max(_d("total_neg")), F.lit(0.0)
    )
    return _by(p, group, [
        F.max("total_pos").alias("n"),
        F.round(auc_expr(), 6).alias("roc_unweighted"),
        F.round(wa, 6).alias("roc_weighted"),
        F.round(wa - auc_expr(), 6).alias("delta"),
    ])


def roc_curve(df: DataFrame, group: list[str], score: str = "score", label: str = "label", domain=UNIT) -> DataFrame:
    """One point per distinct threshold: sites and land at or above it."""
    p = score_profile(df, group, score, label, domain=domain)
    return p.select(
        *group,
        F.col(score).alias("threshold"),
        (F.col("total_pos") - F.col("below_pos")).alias("tp"),
        (F.col("total_neg") - F.col("below_neg")).alias("fp"),
        F.round((F.col("total_pos") - F.col("below_pos")) / F.nullif(F.col("total_pos"), F.lit(0)), 6).alias("tpr"),
        F.round((F.col("total_neg") - F.col("below_neg")) / F.nullif(F.col("total_neg"), F.lit(0)), 6).alias("fpr"),
    )


def site_percentiles(df: DataFrame, group: list[str], keys: list[str], score: str = "score", label: str = "label",
                     ties: str = "strict", domain=UNIT) -> DataFrame:
    """Each site with the share of its group's land below it."""
    p = score_profile(df, group, score, label, domain=domain).filter(F.col("pos") > 0)
    sites = R.clean_scores(df, score).filter(F.col(label) == 1)
    pct = p.select(*group, score, F.round(land_percentile(ties), 6).alias("land_pct"))
    return sites.select(*group, *keys, score).join(pct, [*group, score])


def gains_curve(df: DataFrame, group: list[str], weight: Column, tops: list[int], score: str = "score",
                label: str = "label", domain=UNIT) -> DataFrame:
    """Share of sites and of their weight inside the best x % of land, x in ``tops``.

    The threshold for x is the (100 - x) % quantile of land scores and counts inclusively;
    x = 0 captures nothing. Thresholds fall as x grows, so each score has a smallest x that
    captures it: sites shrink to one row per such x before the curve is laid out.
    """
    p = score_profile(df, group, score, label, weight, domain)
    wanted = F.array(*[F.lit(x) for x in tops if x > 0])
    first, size, total = F.col("below_neg"), F.col("neg"), F.col("total_neg")
    at = lambda x: (total - 1) * ((100 - x) / F.lit(100.0))
    covers = lambda k: (first <= k) & (k < first + size)
    touched = F.filter(wanted, lambda x: covers(F.floor(at(x))) | covers(F.ceil(at(x))))
    hits = p.filter(F.col("neg") > 0).select("*", F.explode(touched).alias("x"))
    pos = at(F.col("x"))
    low, high = (F.max(F.when(covers(k), F.col(score))) for k in (F.floor(pos), F.ceil(pos)))
    thresholds = hits.groupBy(*group, "x").agg((low + (high - low) * F.max(pos - F.floor(pos))).alias("t"))
    ladder = thresholds.groupBy(*group).agg(F.collect_list(F.struct("x", "t")).alias("__ladder"))  # one entry per x
    sites = p.filter(F.col("pos") > 0)
    joined = sites.join(ladder, group) if group else R.attach_row(sites, ladder)
    enough = F.array_min(F.transform(F.filter("__ladder", lambda e: e["t"] <= F.col(score)), lambda e: e["x"]))
    per = joined.groupBy(*group, enough.alias("__x0")).agg(
        F.sum("wpos").alias("w"), F.sum(_d("pos")).alias("n"), F.max("total_wpos").alias("tw"), F.max(_d("total_pos")).alias("tn")
    )
    laid = per.select("*", F.explode(F.array(*[F.lit(x) for x in tops])).alias("top_pct_land"))
    inside = F.coalesce(F.col("top_pct_land") >= F.col("__x0"), F.lit(False))
    return laid.groupBy(*group, "top_pct_land").agg(
        F.round(100 * F.sum(F.when(inside, F.col("w")).otherwise(0.0)) / F.max("tw"), 4).alias("pct_weight"),
        F.round(100 * F.sum(F.when(inside, F.col("n")).otherwise(0.0)) / F.max("tn"), 4).alias("pct_sites"),
    )


def spearman(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks, over rows where both values are present."""
    both = R.clean_scores(R.clean_scores(df, a), b)
    ranked = R.with_rank(R.with_rank(both, group, a, "__ra"), group, b, "__rb")
    exprs = [F.count(F.lit(1)).alias("n"), F.round(F.corr("__ra", "__rb"), 6).alias("rho")]
    return _by(ranked, group, exprs)


def in_subsets(df: DataFrame, source: str = "source") -> DataFrame:
    """Tag rows with every evaluation set they belong to; land belongs to all three.

    inventory leaves out the external detector's sites, tzsam leaves out the inventory's.
    """
    sets = F.filter(
        F.array(
            F.when(F.col(source) != "tz", F.lit("inventory")),
            F.when(F.col(source) != "pvfac", F.lit("tzsam")),
            F.lit("combined"),
        ),
        lambda s: s.isNotNull(),
    )
    return df.withColumn("set", F.explode(sets))
