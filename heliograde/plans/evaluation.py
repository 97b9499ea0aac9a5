"""Queries: does the score rank sites above random land? (metrics, percentiles, gains, correlations)"""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograde.functions.hashing import draw_sql, hash_order_sql as H, hash_steps_sql, poisson_limits
from heliograde.operators import bootstrap as B
from heliograde.operators import evaluate as E
from heliograde.operators import ranking as R
from heliograde.plans.registry import query
from heliograde.sources import tables as T

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def profile_sql(src: str, by: str, score: str = "score", extra: str = "") -> str:
    """CTE body: positives and negatives per distinct score with exclusive running sums and totals."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT *, coalesce(sum(neg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS lo,
        coalesce(sum(pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS plo,
        (sum(neg) OVER ({part}))::DOUBLE AS tn, (sum(pos) OVER ({part}))::DOUBLE AS tp
        FROM (SELECT {lead}{score} AS sc, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg{extra}
              FROM {src} WHERE {score} IS NOT NULL GROUP BY ALL) WINDOW w AS ({part} ORDER BY sc)"""


AUC = "sum(pos * (lo + neg / 2)) / nullif(max(tp) * max(tn), 0)"
AP = "sum(pos * (tp - plo) / ((tp - plo) + (tn - lo))) / nullif(max(tp), 0)"


def auc_sql(src: str, by: str, score: str = "score", tail: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}max(tp)::BIGINT AS n_pos, max(tn)::BIGINT AS n_neg, round({AUC}, 6) AS roc
        FROM ({profile_sql(src, by, score)}) {"GROUP BY " + by if by else ""} {tail}"""


REPORT = f"""max(tp)::BIGINT AS n_sites, max(tn)::BIGINT AS n_land, round({AUC}, 6) AS roc, round({AP}, 6) AS pr,
    round(max(tp) / (max(tp) + max(tn)), 6) AS pr_chance,
    round(100 * sum(CASE WHEN lo / tn >= 0.8 THEN pos ELSE 0 END) / max(tp), 6) AS top20,
    round(100 * sum(CASE WHEN lo / tn >= 0.9 THEN pos ELSE 0 END) / max(tp), 6) AS top10,
    round(100 * sum(CASE WHEN lo / tn >= 0.95 THEN pos ELSE 0 END) / max(tp), 6) AS top5"""


def report_sql(src: str, by: str) -> str:
    return f"""WITH prof AS ({profile_sql(src, by)}),
      med AS (SELECT s.{by}, round(100 * quantile_cont(p.lo / p.tn, 0.5), 6) AS median_site_pct
              FROM {src} s JOIN prof p ON s.{by} = p.{by} AND s.score = p.sc WHERE s.label = 1 GROUP BY s.{by})
      SELECT prof.{by}, {REPORT}, max(median_site_pct) AS median_site_pct FROM prof JOIN med ON prof.{by} = med.{by} GROUP BY prof.{by}"""


@query("e_country_report", report_sql("scores", "country"), ("scores",))
def country_report(spark, sf):
    return E.country_report(T.scores(spark, sf), ["country"])


@query("e1_rank_auc", auc_sql("scores", "country"), ("scores",))
def rank_auc(spark, sf):
    return E.auc(T.scores(spark, sf), ["country"])


@query("e2_average_precision", f"""SELECT country, round({AP}, 6) AS pr, round(max(tp) / (max(tp) + max(tn)), 6) AS pr_chance
    FROM ({profile_sql('scores', 'country')}) GROUP BY country""", ("scores",))
def average_precision(spark, sf):
    return E.country_report(T.scores(spark, sf), ["country"]).select("country", "pr", "pr_chance")


@query("e3_roc_curve", f"""SELECT country, sc AS threshold, (tp - plo)::BIGINT AS tp, (tn - lo)::BIGINT AS fp, round((tp - plo) / tp, 6) AS tpr,
    round((tn - lo) / tn, 6) AS fpr FROM ({profile_sql('scores', 'country')})""", ("scores",))
def roc_curve(spark, sf):
    return E.roc_curve(T.scores(spark, sf), ["country"])


@query("e3_trapezoid_area", f"""SELECT country, round(sum((fx - fx0) * (ty + ty0) / 2), 6) AS area FROM (
    SELECT country, (tp - plo) / tp AS ty, (tn - lo) / tn AS fx, (tp - plo - pos) / tp AS ty0, (tn - lo - neg) / tn AS fx0
    FROM ({profile_sql('scores', 'country')})) GROUP BY country""", ("scores",))
def trapezoid(spark, sf):
    p = E.score_profile(T.scores(spark, sf), ["country"])
    d = lambda c: F.col(c).cast("double")
    step = (d("neg") / d("total_neg")) * ((d("total_pos") - d("below_pos")) / d("total_pos") + (d("total_pos") - d("below_pos") - d("pos")) / d("total_pos")) / 2
    return p.groupBy("country").agg(F.round(F.sum(step), 6).alias("area"))


@query("e4_site_percentile_summary", f"""SELECT country, median_site_pct, top20, top10, top5 FROM ({T.sql(report_sql('scores', 'country'), 'scores')})""")
def percentile_summary(spark, sf):
    return E.country_report(T.scores(spark, sf), ["country"]).select("country", "median_site_pct", "top20", "top10", "top5")


@query("e5_top_k_recall", f"""SELECT country, round(sum(CASE WHEN lo / tn >= 0.8 THEN pos ELSE 0 END) / max(tp), 6) AS recall80,
    round(sum(CASE WHEN lo / tn >= 0.9 THEN pos ELSE 0 END) / max(tp), 6) AS recall90,
    round(sum(CASE WHEN lo / tn >= 0.95 THEN pos ELSE 0 END) / max(tp), 6) AS recall95 FROM ({profile_sql('scores', 'country')}) GROUP BY country""", ("scores",))
def top_k_recall(spark, sf):
    p = E.score_profile(T.scores(spark, sf), ["country"])
    return p.groupBy("country").agg(*[F.round(E.top_share_expr(x / 100), 6).alias(f"recall{x}") for x in (80, 90, 95)])


# Forward validation: all sites two or more years after the map, not seen in training, against land.
MAP_YEAR = 2019
FORWARD = f"""SELECT s.* FROM scores s WHERE label = 1 AND year >= {MAP_YEAR + 2} AND score IS NOT NULL AND NOT EXISTS (SELECT 1 FROM train t WHERE t.id = s.l_orderkey)
    UNION ALL SELECT * FROM scores WHERE label = 0"""
TRAIN_IDS = "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'"


@query("e6_forward_validation", f"""WITH train AS ({TRAIN_IDS}), picked AS ({FORWARD}), rep AS ({report_sql('picked', 'country')}) SELECT * FROM rep""", ("scores",))
def forward_validation(spark, sf):
    s = T.scores(spark, sf)
    train = T.read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    sites = R.clean_scores(s, "score").filter((F.col("label") == 1) & (F.col("year") >= MAP_YEAR + 2)).join(train, "l_orderkey", "left_anti")
    return E.country_report(sites.unionByName(s.filter("label = 0")), ["country"])


SETS = """sets AS (SELECT s.*, u.set FROM scores s, (VALUES ('inventory'), ('tzsam'), ('combined')) u(set)
    WHERE u.set = 'combined' OR (u.set = 'inventory' AND source <> 'tz') OR (u.set = 'tzsam' AND source <> 'pvfac'))"""


@query("e7_three_set_roc", f"""WITH {SETS} {auc_sql('sets', 'country, set')}""", ("scores",))
def three_set_roc(spark, sf):
    return E.auc(E.in_subsets(T.scores(spark, sf)), ["country", "set"])


@query("e8_pooled_and_macro_roc", f"""WITH per AS ({auc_sql('scores', 'country')}), all_ AS ({auc_sql('scores', '')})
    SELECT a.roc AS pooled_roc, a.n_pos, a.n_neg, (SELECT round(avg(roc), 6) FROM per) AS country_mean_roc FROM all_ a""", ("scores",))
def pooled(spark, sf):
    s = T.scores(spark, sf)
    mean = E.auc(s, ["country"]).agg(F.round(F.avg("roc"), 6).alias("country_mean_roc"))
    return E.auc(s, []).withColumnRenamed("roc", "pooled_roc").transform(R.attach_row, mean)


# --- bootstrap ---------------------------------------------------------------------------
REPS = B.REPS
# One row per site/land point of the smaller point set: orders scored through their price.
POINTS = """pts AS (SELECT 'C' || (o_custkey % 5)::VARCHAR AS country, (floor(o_totalprice)::BIGINT % 1000) / 1000.0::DOUBLE AS score,
    ((floor(o_totalprice)::BIGINT * 7 + o_custkey) % 1000) / 1000.0::DOUBLE AS score_b, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, o_orderkey,
    {a} AS ha, row_number() OVER (PARTITION BY o_custkey % 5, o_orderstatus = 'F' ORDER BY {h}, o_orderkey) - 1 AS idx,
    count(*) OVER (PARTITION BY o_custkey % 5, o_orderstatus = 'F') AS size FROM orders)""".format(h=H("o_orderkey"), a=H("o_orderkey", 1))
REP_LIST = f"reps_ AS MATERIALIZED (SELECT rep, {H('rep', 2)} AS hr FROM range({REPS}) r(rep))"
DRAWN = f"""{REP_LIST}, points_ AS MATERIALIZED (SELECT * FROM pts), h_ AS ({hash_steps_sql("SELECT country, label, rep, score, score_b, xor(ha, hr) AS h FROM points_, reps_", "h")}),
    rows_ AS (SELECT country, label, rep, score, score_b, {' + '.join(f'(h >= {x})::INT' for x in poisson_limits())} AS times FROM h_)"""


def rep_auc_sql(src: str, by: str, score: str) -> str:
    return f"""SELECT {by}, sum(pos * (lo + neg / 2)) / (max(tp) * max(tn)) AS auc FROM (SELECT *,
        coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS lo,
        (sum(neg) OVER (PARTITION BY {by}))::DOUBLE AS tn, (sum(pos) OVER (PARTITION BY {by}))::DOUBLE AS tp
        FROM (SELECT {by}, {score} AS sc, sum(times * label)::BIGINT AS pos, sum(times * (1 - label))::BIGINT AS neg FROM {src} GROUP BY ALL)) GROUP BY {by}"""


def boot_points(spark, sf):
    o = T.read(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("C"), (F.col("o_custkey") % 5).cast("string")).alias("country"), (F.floor("o_totalprice") % 1000 / 1000.0).alias("score"),
        ((F.floor("o_totalprice") * 7 + F.col("o_custkey")) % 1000 / 1000.0).alias("score_b"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"), "o_orderkey",
    )


def numbered_points(spark, sf):
    """The points with their number inside (country, label), from 0."""
    p = boot_points(spark, sf)
    return R.hash_positions(p, ["country", "label"], F.col("o_orderkey"), ["o_orderkey"], 0, "__p").withColumn("idx", F.col("__p") - 1).drop("__p")


CI = "count(*) AS reps, round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi, round(stddev_pop(auc), 6) AS se"


@query("e9_bootstrap_ci", f"WITH {POINTS}, {DRAWN}, reps AS ({rep_auc_sql('rows_', 'country, rep', 'score')}) SELECT country, {CI} FROM reps GROUP BY country")
def bootstrap_ci(spark, sf):
    return B.interval(B.replicate_auc(boot_points(spark, sf), ["country"], ["score"], "o_orderkey"), ["country"])


# Exactly n of n draws.
EXACT = f"""{REP_LIST}, one AS MATERIALIZED (SELECT *, {H('idx * 2 + label', 1)} AS hi FROM pts),
    h_ AS ({hash_steps_sql("SELECT country, label, rep, size, xor(hi, hr) AS h FROM one, reps_", "h")}),
    times AS (SELECT country, label, rep, h % size AS pick, count(*) AS times FROM h_ GROUP BY ALL),
    rows_ AS (SELECT t.country, t.rep, t.times, t.label, p.score FROM times t JOIN one p ON p.country = t.country AND p.label = t.label AND p.idx = t.pick)"""


@query("e9_bootstrap_ci_exact", f"WITH {POINTS}, {EXACT}, reps AS ({rep_auc_sql('rows_', 'country, rep', 'score')}) SELECT country, {CI} FROM reps GROUP BY country")
def bootstrap_exact(spark, sf):
    return B.interval(B.exact_auc(numbered_points(spark, sf), ["country"], "score"), ["country"])


@query("e9_bootstrap_ci_poisson", f"WITH {POINTS}, {DRAWN}, reps AS ({rep_auc_sql('rows_', 'country, rep', 'score_b')}) SELECT country, {CI} FROM reps GROUP BY country")
def bootstrap_poisson(spark, sf):
    return B.interval(B.replicate_auc(boot_points(spark, sf), ["country"], ["score_b"], "o_orderkey"), ["country"])


@query("e10_paired_gap", f"""WITH {POINTS}, {DRAWN}, a AS ({rep_auc_sql('rows_', 'country, rep', 'score')}), b AS ({rep_auc_sql('rows_', 'country, rep', 'score_b')}),
    g AS (SELECT a.country, a.auc - b.auc AS gap FROM a JOIN b ON a.country = b.country AND a.rep = b.rep)
    SELECT country, round(avg(gap), 6) AS mean_gap, round(quantile_cont(gap, 0.025), 6) AS gap_lo, round(quantile_cont(gap, 0.975), 6) AS gap_hi,
    CASE WHEN quantile_cont(gap, 0.025) > 0 THEN 'yes' ELSE 'no' END AS significant FROM g GROUP BY country""")
def paired_gap(spark, sf):
    reps = B.replicate_auc(boot_points(spark, sf), ["country"], ["score", "score_b"], "o_orderkey")
    gap = reps.groupBy("country", "rep").agg(
        (F.max(F.when(F.col("which") == "score", F.col("auc"))) - F.max(F.when(F.col("which") == "score_b", F.col("auc")))).alias("gap")
    )
    lo = F.percentile("gap", 0.025)
    return gap.groupBy("country").agg(
        F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(lo, 6).alias("gap_lo"), F.round(F.percentile("gap", 0.975), 6).alias("gap_hi"),
        F.when(lo > 0, "yes").otherwise("no").alias("significant"),
    )


@query("e12_paired_pool_comparison", f"""WITH {POINTS}, {DRAWN}, a AS ({rep_auc_sql('rows_', 'country, rep', 'score')}), b AS ({rep_auc_sql('rows_', 'country, rep', 'score_b')}),
    n AS (SELECT country, count(*) AS n FROM pts WHERE label = 1 GROUP BY country),
    per AS (SELECT a.rep, sum(n.n * a.auc) / sum(n.n) AS wa, sum(n.n * b.auc) / sum(n.n) AS wb FROM a JOIN b ON a.country = b.country AND a.rep = b.rep JOIN n ON n.country = a.country GROUP BY a.rep)
    SELECT round(avg(wa), 6) AS pool_a, round(avg(wb), 6) AS pool_b, round(avg(wa - wb), 6) AS diff, round(quantile_cont(wa - wb, 0.025), 6) AS diff_lo,
    round(quantile_cont(wa - wb, 0.975), 6) AS diff_hi, CASE WHEN quantile_cont(wa - wb, 0.025) > 0 OR quantile_cont(wa - wb, 0.975) < 0 THEN 'SIG' ELSE 'tied' END AS verdict FROM per""")
def paired_pools(spark, sf):
    pts = boot_points(spark, sf)
    reps = B.replicate_auc(pts, ["country"], ["score", "score_b"], "o_orderkey")
    n = pts.filter("label = 1").groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    pick = lambda w: F.sum(F.when(F.col("which") == w, F.col("n") * F.col("auc"))) / F.sum(F.when(F.col("which") == w, F.col("n")))
    per = reps.join(n, "country").groupBy("rep").agg(pick("score").alias("wa"), pick("score_b").alias("wb")).withColumn("d", F.col("wa") - F.col("wb"))
    lo, hi = F.percentile("d", 0.025), F.percentile("d", 0.975)
    return per.agg(
        F.round(F.avg("wa"), 6).alias("pool_a"), F.round(F.avg("wb"), 6).alias("pool_b"), F.round(F.avg("d"), 6).alias("diff"),
        F.round(lo, 6).alias("diff_lo"), F.round(hi, 6).alias("diff_hi"), F.when((lo > 0) | (hi < 0), "SIG").otherwise("tied").alias("verdict"),
    )


# --- group-level resampling over (country, config) metrics -------------------------------
GROUP_REPS = 10_000
METRIC = """m AS (SELECT 'C' || (l_suppkey % 13)::VARCHAR AS country, l_partkey % 4 AS config, round(sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*) / 1e7::DOUBLE, 6) AS roc, count(*) AS n FROM lineitem GROUP BY ALL)"""  # sums of whole cents do not depend on the order of rows


def config_metrics(spark, sf):
    l = T.read(spark, sf, "lineitem")
    return l.groupBy(F.concat(F.lit("C"), (F.col("l_suppkey") % 13).cast("string")).alias("country"), (F.col("l_partkey") % 4).alias("config")).agg(
        F.round(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double") / F.count(F.lit(1)) / 1e7, 6).alias("roc"), F.count(F.lit(1)).alias("n")
    )


@query("e13_bootstrap_over_groups", f"""WITH {METRIC}, c AS (SELECT country, row_number() OVER (ORDER BY country) - 1 AS ci, count(*) OVER () AS k FROM (SELECT DISTINCT country FROM m)),
    d AS (SELECT rep, {draw_sql('ci', 'rep')} % k AS pick FROM c, range({GROUP_REPS}) r(rep)),
    t AS (SELECT rep, config, avg(roc) AS macro, sum(roc * n) / sum(n) AS weighted FROM d JOIN c ON c.ci = d.pick JOIN m ON m.country = c.country GROUP BY ALL),
    b AS (SELECT rep, arg_max(config, (round(macro, 9), -config)) AS bm, arg_max(config, (round(weighted, 9), -config)) AS bw FROM t GROUP BY rep)
    SELECT config, round(count(*) FILTER (WHERE bm = config) / {GROUP_REPS}.0::DOUBLE, 6) AS p_best_macro, round(count(*) FILTER (WHERE bw = config) / {GROUP_REPS}.0::DOUBLE, 6) AS p_best_weighted
    FROM b, (SELECT DISTINCT config FROM m) GROUP BY config""")
def bootstrap_groups(spark, sf):
    from heliograde.operators.compare import bootstrap_over_groups

    return bootstrap_over_groups(config_metrics(spark, sf), "country", "config", "roc", "n", GROUP_REPS)


@query("e14_leave_one_group_out", f"""WITH {METRIC}, t AS (SELECT d.country AS dropped, m.config, sum(round(roc * 1e6)::BIGINT)::DOUBLE / count(*) / 1e6::DOUBLE AS macro FROM m JOIN (SELECT DISTINCT country FROM m) d ON d.country <> m.country GROUP BY ALL)
    SELECT dropped, arg_max(config, (round(macro, 9), -config)) AS best_config, round(max(macro), 6) AS best_macro FROM t GROUP BY dropped""")
def leave_one_out(spark, sf):
    from heliograde.operators.compare import leave_one_group_out

    return leave_one_group_out(config_metrics(spark, sf), "country", "config", "roc")


# --- weighted, binned and correlated variants --------------------------------------------
@query("e15_weighted_auc", f"""SELECT country, max(tp)::BIGINT AS n, round({AUC}, 6) AS roc_unweighted, round(sum(w * (lo + neg / 2)) / (sum(w) * max(tn)), 6) AS roc_weighted,
    round(sum(w * (lo + neg / 2)) / (sum(w) * max(tn)) - {AUC}, 6) AS delta
    FROM ({profile_sql('scores', 'country', extra=', sum(CASE WHEN label = 1 THEN capacity ELSE 0 END) AS w')}) GROUP BY country""", ("scores",))
def weighted_auc(spark, sf):
    return E.weighted_auc(T.scores(spark, sf), ["country"], F.col("capacity"))


@query("e16_spearman", """WITH b AS (SELECT country, score, score_b FROM scores WHERE score IS NOT NULL),
    r AS (SELECT country, rank() OVER (PARTITION BY country ORDER BY score) + (count(*) OVER (PARTITION BY country, score) - 1) / 2 AS ra,
      rank() OVER (PARTITION BY country ORDER BY score_b) + (count(*) OVER (PARTITION BY country, score_b) - 1) / 2 AS rb FROM b)
    SELECT country, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY country""", ("scores",))
def spearman(spark, sf):
    return E.spearman(T.scores(spark, sf), ["country"], "score", "score_b")


@query("e16_spearman_ordinal", f"""WITH o AS (SELECT o_custkey % 5 AS grp, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_totalprice, o_orderkey) AS ra,
    row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY {H('o_orderkey', 5)}, o_orderkey) AS rb FROM orders) SELECT grp, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM o GROUP BY grp""")
def spearman_ordinal(spark, sf):
    """Ordinal ranks: ties in row order. Ties are broken by key, i.e. rank within the tie is added."""
    from heliograde.operators.compare import ordinal_rank

    o = T.read(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("grp"), "o_orderkey", "o_totalprice")
    a = ordinal_rank(o, ["grp"], "o_totalprice", "o_orderkey", "ra")
    b = R.hash_positions(a, ["grp"], F.col("o_orderkey"), ["o_orderkey"], 5, "rb")
    return b.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("ra", "rb"), 6).alias("rho"))


def gains(by: str, tops: list[int]) -> str:
    c = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    thr = ", ".join(f"quantile_cont(score, {(100 - x) / 100.0}) AS t{x}" for x in tops if x > 0)
    on = f"USING ({by})" if by else "ON true"
    rows = " UNION ALL ".join(
        f"SELECT {c}{x} AS top_pct_land, " + (f"CASE WHEN score >= t{x} THEN 1 ELSE 0 END" if x > 0 else "0") + " AS inside, capacity FROM s" for x in tops
    )
    return f"""WITH t AS (SELECT {c}{thr} FROM scores WHERE label = 0 AND score IS NOT NULL {g}),
      s AS (SELECT * FROM (SELECT {c}score, capacity FROM scores WHERE label = 1 AND score IS NOT NULL) JOIN t {on}), r AS ({rows})
      SELECT {c}top_pct_land, round(100 * sum(inside * capacity) / sum(capacity), 4) AS pct_weight, round(100 * avg(inside), 4) AS pct_sites FROM r GROUP BY {c}top_pct_land"""


@query("e17_gains_curve", gains("", list(range(0, 101))), ("scores",))
def gains_curve(spark, sf):
    return E.gains_curve(T.scores(spark, sf), [], F.col("capacity"), list(range(0, 101)))


@query("e18_country_coverage", gains("country", [10, 20]), ("scores",))
def country_coverage(spark, sf):
    return E.gains_curve(T.scores(spark, sf), ["country"], F.col("capacity"), [10, 20])


BINNED = """bins AS (SELECT * FROM (VALUES ('<5', 0, 5), ('5-20', 5, 20), ('20-40', 20, 40), ('40+', 40, 1e9)) b(size_bin, lo_, hi_)),
    binned AS (SELECT size_bin, score, label FROM scores JOIN bins ON label = 0 OR (capacity >= lo_ AND capacity < hi_))"""


@query("e19_auc_by_size_bin", f"WITH {BINNED} {auc_sql('binned', 'size_bin')}", ("scores",))
def auc_by_size(spark, sf):
    from heliograde.operators.compare import auc_by_bin

    return auc_by_bin(T.scores(spark, sf), "capacity", [("<5", 0.0, 5.0), ("5-20", 5.0, 20.0), ("20-40", 20.0, 40.0), ("40+", 40.0, 1e9)], "size_bin")


@query("e20_auc_by_lead_time", f"""WITH leads AS (SELECT year - 2017 AS lead FROM scores WHERE label = 1 AND score IS NOT NULL GROUP BY year HAVING count(*) >= 30),
    b AS (SELECT lead, score, label FROM scores JOIN leads ON label = 0 OR year - 2017 = lead) {auc_sql('b', 'lead')}""", ("scores",))
def auc_by_lead(spark, sf):
    from heliograde.operators.compare import auc_by_key_shared_land

    s = T.scores(spark, sf).withColumn("lead", F.col("year") - 2017)
    return auc_by_key_shared_land(s, "lead", minimum=30)


@query("e21_temporal_holdout_gap", f"""WITH a AS ({auc_sql('scores', 'country', 'score')}), b AS ({auc_sql('scores', 'country', 'score_b')})
    SELECT a.country, a.roc AS roc_leaky, b.roc AS roc_honest, round(a.roc - b.roc, 6) AS gap FROM a JOIN b USING (country)""", ("scores",))
def temporal_gap(spark, sf):
    from heliograde.operators.compare import metric_gap

    s = T.scores(spark, sf)
    return metric_gap(E.auc(s, ["country"], "score"), E.auc(s, ["country"], "score_b"), ["country"], "roc_leaky", "roc_honest")


CRITS = ["ghi", "pvout", "gti", "temp", "slope", "elevation", "aspect", "road", "grid", "popdens"]


@query("e23_single_covariate_auc", f"""WITH u AS (UNPIVOT (SELECT country, label, {', '.join(CRITS)} FROM criteria) ON {', '.join(CRITS)} INTO NAME criterion VALUE v),
    med AS (SELECT country, criterion, round(quantile_cont(v, 0.5) FILTER (WHERE label = 1), 6) AS median_sites, round(quantile_cont(v, 0.5) FILTER (WHERE label = 0), 6) AS median_land FROM u GROUP BY ALL),
    a AS (SELECT country, criterion, {AUC} AS auc FROM ({profile_sql('u', 'country, criterion', 'v')}) GROUP BY country, criterion)
    SELECT a.country, a.criterion, round(auc, 6) AS auc, round(abs(2 * auc - 1), 6) AS discrimination, median_sites, median_land FROM a JOIN med USING (country, criterion)""", ("criteria",))
def single_covariate(spark, sf):
    from heliograde.operators.compare import covariate_discrimination

    return covariate_discrimination(T.criteria(spark, sf), ["country"], CRITS)


@query("e24_expert_vs_empirical_weight", f"""WITH u AS (UNPIVOT (SELECT country, label, {', '.join(CRITS)} FROM criteria) ON {', '.join(CRITS)} INTO NAME criterion VALUE v),
    d AS (SELECT country, criterion, abs(2 * ({AUC}) - 1) AS disc FROM ({profile_sql('u', 'country, criterion', 'v')}) GROUP BY country, criterion),
    e AS (SELECT criterion, avg(disc) AS mean_disc FROM d GROUP BY criterion),
    w AS (SELECT * FROM (VALUES ('road', 0.5401::DOUBLE), ('grid', 0.1392), ('slope', 0.0605), ('elevation', 0.0225), ('ghi', 0.0352), ('pvout', 0.0253), ('gti', 0.0169), ('aspect', 0.0759), ('temp', 0.0844)) w(criterion, weight))
    SELECT criterion, round(weight / sum(weight) OVER (), 6) AS expert_share, round(mean_disc / sum(mean_disc) OVER (), 6) AS empirical_share FROM w JOIN e USING (criterion)""", ("criteria",))
def expert_share(spark, sf):
    from heliograde.operators.compare import expert_vs_empirical
    from heliograde.operators.mcda import RICHARDS

    return expert_vs_empirical(T.criteria(spark, sf), ["country"], CRITS, RICHARDS)


@query("e25_top_decile_auc", """WITH t AS (SELECT country, quantile_cont(score, 0.9) AS thr FROM criteria GROUP BY country),
    c AS (SELECT c.country, CASE WHEN score >= thr THEN 1 ELSE 0 END AS label, slope FROM criteria c JOIN t USING (country)), a AS (""" + auc_sql("c", "country", "slope") + """)
    SELECT country, n_pos AS n_top, roc FROM a""", ("criteria",))
def top_decile(spark, sf):
    from heliograde.operators.compare import top_share_auc

    return top_share_auc(T.criteria(spark, sf), "country", "score", "slope", 0.9)


@query("e25_decile_medians", """WITH r AS (SELECT slope, score, rank() OVER (ORDER BY slope) + (count(*) OVER (PARTITION BY slope) - 1) / 2.0::DOUBLE AS rk, count(*) OVER () AS n FROM criteria)
    SELECT least(floor((rk - 0.5::DOUBLE) / n * 10), 9)::BIGINT AS decile, count(*) AS n, round(quantile_cont(score, 0.5), 6) AS median_score, round(avg(slope), 6) AS mean_x FROM r GROUP BY 1""", ("criteria",))
def decile_medians(spark, sf):
    from heliograde.operators.compare import binned_medians

    return binned_medians(T.criteria(spark, sf), "slope", "score", 10)


@query("e26_suitable_fraction", """WITH t AS (SELECT quantile_cont(score, 0.1) AS thr FROM scores WHERE label = 1)
    SELECT round(max(thr), 6) AS threshold, round(avg(CASE WHEN score >= thr THEN 1 ELSE 0 END), 6) AS suitable_fraction FROM scores, t WHERE label = 0 AND score IS NOT NULL""", ("scores",))
def suitable_fraction(spark, sf):
    from heliograde.operators.compare import suitable_share

    return suitable_share(T.scores(spark, sf), 0.10)


@query("e28_weakest_first", f"""WITH a AS ({auc_sql('scores', 'country')}), v AS (SELECT country, sum(capacity) FILTER (WHERE label = 1) AS volume FROM scores GROUP BY country),
    r AS (SELECT country, roc, volume, row_number() OVER (ORDER BY roc, country) AS weakness_rank FROM a JOIN v USING (country)),
    k AS (SELECT corr(ra, rb) AS rho FROM (SELECT rank() OVER (ORDER BY roc) AS ra, rank() OVER (ORDER BY volume) AS rb FROM r))
    SELECT country, roc, volume, weakness_rank, round((SELECT rho FROM k), 6) AS rho FROM r""", ("scores",))
def weakest_first(spark, sf):
    from heliograde.operators.compare import weakest_first as weak

    s = T.scores(spark, sf)
    v = s.groupBy("country").agg(F.sum(F.when(F.col("label") == 1, F.col("capacity"))).alias("volume"))
    return weak(E.auc(s, ["country"]).select("country", "roc").join(v, "country"), "country", "roc", "volume")


@query("e34_lag_matrix", f"""WITH t AS (UNPIVOT (SELECT country, label, score AS t2, score_b AS t3, l_linenumber % 2 AS land FROM scores) ON t2, t3 INTO NAME train_lag VALUE v),
    x AS (SELECT train_lag, CASE WHEN land = 0 THEN 't2' ELSE 't3' END AS land_lag, v, label FROM t), a AS ({auc_sql('x', 'train_lag, land_lag', 'v')})
    SELECT train_lag, max(roc) FILTER (WHERE land_lag = 't2') AS land_t2, max(roc) FILTER (WHERE land_lag = 't3') AS land_t3,
    round((SELECT max(roc) FILTER (WHERE train_lag = 't2' AND land_lag = 't2') - max(roc) FILTER (WHERE train_lag = 't3' AND land_lag = 't3') FROM a), 6) AS matched_gap FROM a GROUP BY train_lag""", ("scores",))
def lag_matrix(spark, sf):
    from heliograde.operators.compare import lag_matrix as matrix

    s = T.scores(spark, sf).withColumn("land_lag", F.when(F.col("l_linenumber") % 2 == 0, "t2").otherwise("t3"))
    return matrix(s, {"t2": "score", "t3": "score_b"}, "land_lag")


@query("e35_paired_regimes", f"""WITH f AS (SELECT * FROM scores WHERE year >= 2021 OR label = 0), l AS (SELECT * FROM scores WHERE year < 2021 OR label = 0),
    a AS ({auc_sql('f', 'country')}), b AS ({auc_sql('l', 'country')})
    SELECT a.country, a.roc AS forward_roc, b.roc AS loco_roc, round(a.roc - b.roc, 6) AS gap FROM a JOIN b USING (country)""", ("scores",))
def paired_regimes(spark, sf):
    from heliograde.operators.compare import metric_gap

    s = T.scores(spark, sf)
    f = E.auc(s.filter("year >= 2021 OR label = 0"), ["country"])
    l = E.auc(s.filter("year < 2021 OR label = 0"), ["country"])
    return metric_gap(f, l, ["country"], "forward_roc", "loco_roc")


# --- windows ------------------------------------------------------------------------------
@query("w1_rank_percentile", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, country, round((rank() OVER (PARTITION BY country ORDER BY score_b)
    + (count(*) OVER (PARTITION BY country, score_b) - 1) / 2) / count(*) OVER (PARTITION BY country), 6) AS pct FROM scores""", ("scores",))
def rank_percentile(spark, sf):
    s = T.scores(spark, sf)
    dist = R.running_sums(R.value_counts(s, ["country"], "score_b", {"n": F.lit(1)}), ["country"], "score_b", ["n"], (0.0, 1.0))
    pct = dist.select("country", "score_b", F.round(R.average_rank() / F.col("total_n"), 6).alias("pct"))
    return s.join(pct, ["country", "score_b"]).select(*KEYS, "country", "pct")


@query("w2_percentile_vs_land_strict", f"""WITH p AS ({profile_sql('scores', 'country')}) SELECT s.country, l_orderkey, l_partkey, l_suppkey, l_linenumber, score, round(lo / tn, 6) AS land_pct
    FROM scores s JOIN p ON p.country = s.country AND p.sc = s.score WHERE s.label = 1""", ("scores",))
def land_percentile_strict(spark, sf):
    return E.site_percentiles(T.scores(spark, sf), ["country"], KEYS)


@query("w2_percentile_vs_land_mid", f"""WITH p AS ({profile_sql('scores', 'country')}) SELECT s.country, l_orderkey, l_partkey, l_suppkey, l_linenumber, score, round((lo + neg / 2) / tn, 6) AS land_pct
    FROM scores s JOIN p ON p.country = s.country AND p.sc = s.score WHERE s.label = 1""", ("scores",))
def land_percentile_mid(spark, sf):
    return E.site_percentiles(T.scores(spark, sf), ["country"], KEYS, ties="mid")


@query("w6_mean_rank", f"""WITH {METRIC}, r AS (SELECT config, rank() OVER (PARTITION BY country ORDER BY roc DESC) + (count(*) OVER (PARTITION BY country, roc) - 1) / 2 AS rk FROM m)
    SELECT config, round(avg(rk), 6) AS mean_rank FROM r GROUP BY config""")
def mean_rank(spark, sf):
    from heliograde.operators.compare import mean_rank as mr

    return mr(config_metrics(spark, sf), "country", "config", "roc")


@query("w5_winner_and_gap", f"""WITH {METRIC}, w AS (SELECT country, arg_max(config, (roc, -config)) AS winner, max(roc) AS best, max(roc) FILTER (WHERE config = 0) AS reference FROM m GROUP BY country)
    SELECT country, winner, round(reference - best, 6) AS gap, count(*) OVER (PARTITION BY winner) AS wins_of_winner FROM w""")
def winner(spark, sf):
    from heliograde.operators.compare import winner_and_gap

    return winner_and_gap(config_metrics(spark, sf), "country", "config", "roc", 0)


@query("w7_cumulative_counts", f"""SELECT country, sc AS threshold, (tp - plo)::BIGINT AS cum_tp, (tn - lo)::BIGINT AS cum_fp FROM ({profile_sql('scores', 'country', 'score_b')})""", ("scores",))
def cumulative_counts(spark, sf):
    return E.roc_curve(T.scores(spark, sf), ["country"], "score_b").select("country", "threshold", F.col("tp").alias("cum_tp"), F.col("fp").alias("cum_fp"))
