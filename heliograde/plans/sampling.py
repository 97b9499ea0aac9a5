"""Queries: caps, budgets, splits, weights, class balance and re-balancing of countries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograde.functions.hashing import hash_order_sql as H
from heliograde.operators import balance as BA
from heliograde.operators import sampling as S
from heliograde.operators import summaries as A
from heliograde.plans.registry import query
from heliograde.sources import files
from heliograde.sources import tables as T

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
HK = H("l_orderkey * 8 + l_linenumber")
ORDER = f"{HK}, l_orderkey, l_partkey, l_suppkey, l_linenumber"
KEYLIST = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def row_key():
    """Key of a line item, for hash orders. Columns need a session, so none is made at import."""
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


@query("sm1_cap_per_chip", f"""SELECT {KEYLIST}, site FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {ORDER}) AS rn FROM pool) WHERE rn <= 40""", ("pool",))
def cap_per_chip(spark, sf):
    return S.cap_per_group(T.pool(spark, sf), ["site"], row_key(), KEYS, 40).select(*KEYS, "site")


def even_sql(src: str, by: str, member: str, count: str, budget: str) -> str:
    """Level, minimum and remainder hand-out of an even budget, written with plain aggregates."""
    return f"""SELECT c.{by.split(',')[0].strip()} AS g0, c.*, least(c.{count}, lv.l) + CASE WHEN c.{count} > lv.l AND
        row_number() OVER (PARTITION BY {', '.join('c.' + x.strip() for x in by.split(','))} ORDER BY c.{count} DESC, {H('c.' + member)}, c.{member}) <= lv.r THEN 1 ELSE 0 END AS alloc
      FROM {src} c JOIN lv USING ({by})"""


LEVELS = """cand AS (SELECT {by}, a.v, sum(least({count}, a.v)) AS used, min(least({budget}, tot)) AS b
      FROM (SELECT s.*, sum({count}) OVER (PARTITION BY {by}) AS tot FROM {src} s) s
      JOIN LATERAL (SELECT unnest(range(0, {top})) AS v) a ON true GROUP BY {by}, a.v),
    lv AS (SELECT {by}, max(v) FILTER (WHERE used <= b) AS l, max(b) - max(used) FILTER (WHERE used <= b) AS r FROM cand GROUP BY {by})"""


@query("sm2_even_budget", """WITH counts AS (SELECT country, site, count(*) AS c, 900 AS budget FROM pool GROUP BY country, site), """
       + LEVELS.format(by="country", count="c", budget="budget", src="counts", top=80)
       + f""" SELECT country, site, c, alloc::BIGINT AS alloc FROM (SELECT counts.country, counts.site, c, least(c, l) + CASE WHEN c > l AND
        row_number() OVER (PARTITION BY counts.country ORDER BY c DESC, {H('counts.site')}, counts.site) <= r THEN 1 ELSE 0 END AS alloc FROM counts JOIN lv USING (country))""", ("pool",))
def even_budget(spark, sf):
    counts = T.pool(spark, sf).groupBy("country", "site").agg(F.count(F.lit(1)).alias("c")).withColumn("budget", F.lit(900).cast("bigint"))
    return S.even_budget(counts, ["country"], "site", "c", "budget").select("country", "site", "c", "alloc")


BUDGET = 1500


@query("sm3_spread_sample", f"""WITH per_site AS (SELECT country, cell, site, count(*) AS c FROM pool GROUP BY ALL), counts AS (SELECT country, cell, sum(c)::BIGINT AS c, {BUDGET} AS budget FROM per_site GROUP BY ALL), """
       + LEVELS.format(by="country", count="c", budget="budget", src="counts", top=400) + f""",
    cq AS (SELECT counts.country, counts.cell, least(c, l) + CASE WHEN c > l AND row_number() OVER (PARTITION BY counts.country ORDER BY c DESC, {H('counts.cell')}, counts.cell) <= r THEN 1 ELSE 0 END AS q FROM counts JOIN lv USING (country)),
    sc AS (SELECT s.*, q FROM per_site s JOIN cq USING (country, cell)),
    cand2 AS (SELECT country, cell, a.v, sum(least(c, a.v)) AS used, min(least(q, tot)) AS b FROM (SELECT s.*, sum(c) OVER (PARTITION BY country, cell) AS tot FROM sc s) s
      JOIN LATERAL (SELECT unnest(range(0, 80)) AS v) a ON true GROUP BY country, cell, a.v),
    lv2 AS (SELECT country, cell, max(v) FILTER (WHERE used <= b) AS l, max(b) - max(used) FILTER (WHERE used <= b) AS r FROM cand2 GROUP BY ALL),
    sq AS (SELECT sc.country, sc.cell, sc.site, least(c, l) + CASE WHEN c > l AND row_number() OVER (PARTITION BY sc.country, sc.cell ORDER BY c DESC, {H('sc.site')}, sc.site) <= r THEN 1 ELSE 0 END AS q2
      FROM sc JOIN lv2 USING (country, cell))
    SELECT {KEYLIST}, country, cell, site FROM (SELECT p.*, q2, row_number() OVER (PARTITION BY p.country, p.cell, p.site ORDER BY {ORDER}) AS rn FROM pool p JOIN sq USING (country, cell, site)) WHERE rn <= q2""", ("pool",))
def spread_sample(spark, sf):
    return S.spread_sample(T.pool(spark, sf), "country", "cell", "site", row_key(), KEYS, BUDGET).select(*KEYS, "country", "cell", "site")


GSPLIT = f"""u AS (SELECT DISTINCT country, site FROM pool), k AS (SELECT country, site, count(*) OVER (PARTITION BY country) AS n,
    row_number() OVER (PARTITION BY country ORDER BY {H('site')}, site) AS rn FROM u),
    split AS (SELECT country, site, CASE WHEN n >= 2 AND rn <= greatest(1, least(round(0.2::DOUBLE * n), n - 1)) THEN 'test' ELSE 'train' END AS split FROM k)"""


@query("sm4_grouped_split", f"WITH {GSPLIT} SELECT * FROM split", ("pool",))
def grouped_split(spark, sf):
    return S.grouped_split(T.pool(spark, sf), "country", "site")


@query("sm4_split_violations", f"WITH {GSPLIT} SELECT country, site, count(DISTINCT split) AS sides FROM split GROUP BY ALL HAVING count(DISTINCT split) > 1", ("pool",))
def split_violations(spark, sf):
    s = S.grouped_split(T.pool(spark, sf), "country", "site")
    return s.groupBy("country", "site").agg(F.countDistinct("split").alias("sides")).filter("sides > 1")


@query("sm5_row_split", f"""SELECT {KEYLIST}, country, CASE WHEN n >= 5 AND rn <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM
    (SELECT *, count(*) OVER (PARTITION BY country) AS n, row_number() OVER (PARTITION BY country ORDER BY {ORDER}) AS rn FROM pool)""", ("pool",))
def row_split(spark, sf):
    return S.row_split(T.pool(spark, sf), "country", row_key(), KEYS).select(*KEYS, "country", "split")


@query("sm6_balanced_classes", f"SELECT {KEYLIST}, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {ORDER}) AS rn FROM pool) WHERE rn <= 5000", ("pool",))
def balanced_classes(spark, sf):
    return S.balanced_classes(T.pool(spark, sf), "label", row_key(), KEYS, 5000).select(*KEYS, "label")


@query("sm6_class_ratios", f"""WITH p AS (SELECT country, label, {KEYLIST} FROM pool), n AS (SELECT count(*) AS n FROM p WHERE label = 1),
    neg AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rn FROM p WHERE label = 0), x AS (SELECT unnest([1, 2, 5]) AS ratio),
    t AS (SELECT ratio, label FROM p, x WHERE label = 1 UNION ALL SELECT ratio, label FROM neg, x, n WHERE rn <= n * ratio)
    SELECT ratio, label, count(*) AS n FROM t GROUP BY ALL""", ("pool",))
def class_ratios(spark, sf):
    p = T.pool(spark, sf)
    return S.class_ratio(p, "label", row_key(), KEYS, [1, 2, 5]).groupBy("ratio", "label").agg(F.count(F.lit(1)).alias("n"))


@query("w3_fill_to_target_area", f"""WITH t AS (SELECT country, sum(area) * 0.1 AS target FROM pool WHERE label = 1 GROUP BY country),
    c AS (SELECT p.*, target, sum(area) OVER (PARTITION BY p.country ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY p.country ORDER BY {ORDER}) AS rn
      FROM pool p JOIN t USING (country) WHERE label = 0) SELECT {KEYLIST}, country, round(cum, 4) AS cum_amount FROM c WHERE cum <= target OR rn = 1""", ("pool",))
def fill_to_target(spark, sf):
    p = T.pool(spark, sf)
    t = p.filter("label = 1").groupBy("country").agg((F.sum("area") * 0.1).alias("target"))
    out = S.fill_to_target(p.filter("label = 0").join(t, "country"), ["country"], row_key(), KEYS, "area", "target")
    return out.select(*KEYS, "country", F.round("cum_amount", 4).alias("cum_amount"))


@query("w4_first_n_and_overflow", f"""SELECT country, CASE WHEN rn <= 1000 THEN 'kept' ELSE 'overflow' END AS part, count(*) AS n, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key FROM
    (SELECT *, row_number() OVER (PARTITION BY country ORDER BY {ORDER}) AS rn FROM pool) GROUP BY 1, 2""", ("pool",))
def first_n(spark, sf):
    return S.split_first(T.pool(spark, sf), ["country"], row_key(), KEYS, 1000).groupBy("country", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key")
    )


@query("m11_balanced_weight", "SELECT label, round(sum(count(*)) OVER () / (2.0 * count(*)), 6)::DOUBLE AS weight FROM pool GROUP BY label", ("pool",))
def balanced_weight(spark, sf):
    return S.balanced_weight(T.pool(spark, sf), "label").withColumn("weight", F.round("weight", 6))


@query("m12_country_mass_weight", """WITH q AS (SELECT country, CASE WHEN country = 7 THEN 0 WHEN country < 4 THEN label * (l_linenumber % 2)::INTEGER ELSE label END AS label FROM pool),
    c AS (SELECT country, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n FROM q GROUP BY country), t AS (SELECT sum(p)::DOUBLE AS tp, sum(n)::DOUBLE AS tn FROM c)
    SELECT country, p AS n_pos, n AS n_neg, round(least(greatest(coalesce((p / tp) / nullif(n / tn, 0), 0), 0.05), 20), 6) AS neg_weight FROM c, t""", ("pool",))
def mass_weight(spark, sf):
    p = T.pool(spark, sf).withColumn(
        "label", F.when(F.col("country") == 7, 0).when(F.col("country") < 4, F.col("label") * (F.col("l_linenumber") % 2)).otherwise(F.col("label"))
    )
    return S.country_mass_weight(p, "country", "label").withColumn("neg_weight", F.round("neg_weight", 6))


# --- re-balancing: negatives per country against positive scenes per country ----------------
COUNTS = """pos AS (SELECT n_name AS country, count(*) AS scenes FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE substring(o_orderpriority, 1, 1)::INTEGER <= 1 + n_nationkey % 4 GROUP BY n_name),
    neg AS (SELECT n_name AS country, count(*) AS now FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey <> 11 GROUP BY n_name),
    base AS (SELECT country, coalesce(now, 0) AS neg_now, coalesce(scenes, 0) AS pos_scenes FROM pos FULL JOIN neg USING (country)),
    tot AS (SELECT sum(neg_now) AS nt, sum(pos_scenes) AS pt FROM base),
    sh AS (SELECT country, neg_now, pos_scenes, pos_scenes / pt AS pos_share, neg_now / nt AS neg_share, round(pos_scenes / pt * nt)::BIGINT AS target FROM base, tot)"""


def country_counts(spark, sf):
    o, c, n = (T.read(spark, sf, t) for t in ("orders", "customer", "nation"))
    cn = c.join(n, c.c_nationkey == n.n_nationkey)
    pos = o.join(cn, o.o_custkey == cn.c_custkey).filter(F.substring("o_orderpriority", 1, 1).cast("int") <= 1 + F.col("n_nationkey") % 4).groupBy(F.col("n_name").alias("country")).agg(F.count(F.lit(1)).alias("pos_scenes"))
    neg = cn.filter("n_nationkey <> 11").groupBy(F.col("n_name").alias("country")).agg(F.count(F.lit(1)).alias("neg_now"))
    return pos.join(neg, "country", "full").fillna(0, ["pos_scenes", "neg_now"])


@query("sm9_proportional_targets", f"WITH {COUNTS} SELECT country, neg_now, pos_scenes, round(pos_share, 6) AS pos_share, round(neg_share, 6) AS neg_share, target, target - neg_now AS deficit FROM sh")
def targets(spark, sf):
    t = BA.proportional_targets(country_counts(spark, sf), "country", "neg_now", "pos_scenes")
    return t.withColumn("pos_share", F.round("pos_share", 6)).withColumn("neg_share", F.round("neg_share", 6))


@query("a20_distribution_distance", f"WITH {COUNTS} SELECT round(0.5 * sum(abs(pos_share - neg_share)), 6) AS tv_distance, round(sum(least(pos_share, neg_share)), 6) AS overlap FROM sh")
def distance(spark, sf):
    t = BA.proportional_targets(country_counts(spark, sf), "country", "neg_now", "pos_scenes")
    return BA.distribution_distance(t, "pos_share", "neg_share")


@query("l4_top_bottom_deficit", f"""WITH {COUNTS}, r AS (SELECT country, target - neg_now AS deficit, row_number() OVER (ORDER BY target - neg_now DESC, country) AS top_rank,
    row_number() OVER (ORDER BY target - neg_now, country) AS bottom_rank FROM sh) SELECT 'deficit' AS side, top_rank AS place, country, deficit FROM r WHERE top_rank <= 5
    UNION ALL SELECT 'surplus', bottom_rank, country, deficit FROM r WHERE bottom_rank <= 5""")
def top_bottom(spark, sf):
    t = BA.proportional_targets(country_counts(spark, sf), "country", "neg_now", "pos_scenes")
    return A.top_and_bottom(t, "country", "deficit", 5)


@query("sm10_fill_to_shares")
def fill(spark, sf):
    """Greedy fill: no SQL twin, since the one-unit-at-a-time rule is a loop (tests compare it to one)."""
    t = BA.proportional_targets(country_counts(spark, sf), "country", "neg_now", "pos_scenes")
    now = t.agg(F.sum("neg_now").alias("n")).first()["n"]  # one number sets the totals of the curve
    return BA.fill_to_shares(t, "country", "neg_now", "pos_share", [int(now * x) for x in (1.0, 1.1, 1.25, 1.5)])


PLAN = f"""{COUNTS}, plan AS (SELECT country, neg_now AS on_disk, target, (neg_now + greatest(target - neg_now, 0) // 2)::BIGINT AS filled, pos_scenes, pos_scenes % 3 = 0 AS priority FROM sh),
    fin AS (SELECT *, (CASE WHEN priority THEN greatest(filled, target) ELSE filled END)::BIGINT AS final FROM plan)"""


def manifest_plan(spark, sf):
    t = BA.proportional_targets(country_counts(spark, sf), "country", "neg_now", "pos_scenes")
    plan = t.select(
        "country", F.col("neg_now").alias("on_disk"), "target", (F.col("neg_now") + F.expr("greatest(target - neg_now, 0) div 2")).alias("filled"),
        "pos_scenes", (F.col("pos_scenes") % 3 == 0).alias("priority"),
    )
    return BA.download_manifest(plan, "country", "on_disk", "filled", "target", "priority")


@query("sm11_download_manifest", f"WITH {PLAN} SELECT country, on_disk, target, filled, final, greatest(final - on_disk, 0) AS add_new FROM fin")
def manifest(spark, sf):
    return manifest_plan(spark, sf).select("country", "on_disk", "target", "filled", "final", "add_new")


@query("a22_starvation_audit", f"""WITH {PLAN} SELECT country, pos_scenes, final, target, round(100 * final / nullif(target, 0)) AS fill_pct, target - final AS short,
    pos_scenes >= 30 AND round(100 * final / nullif(target, 0)) < 90 AS starved FROM fin WHERE final < target""")
def starvation(spark, sf):
    r = BA.starvation_report(manifest_plan(spark, sf), "final", "target", "pos_scenes", 30, 90.0)
    return r.select("country", "pos_scenes", "final", "target", "fill_pct", "short", "starved")


@query("l3_quota_and_shortfall", f"""WITH {PLAN}, need AS (SELECT country, greatest(final - on_disk, 0) * 20 AS need FROM fin), cand AS (SELECT n_name AS country, o_orderkey,
    row_number() OVER (PARTITION BY n_name ORDER BY {H('o_orderkey')}, o_orderkey) AS rn FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    got AS (SELECT country, count(*) AS got, sum(o_orderkey)::BIGINT AS key_sum FROM cand JOIN need USING (country) WHERE rn <= need GROUP BY country)
    SELECT country, need, coalesce(got, 0) AS got, coalesce(key_sum, 0) AS key_sum, need - coalesce(got, 0) AS shortfall FROM need LEFT JOIN got USING (country)""")
def quota(spark, sf):
    need = manifest_plan(spark, sf).select("country", (F.col("add_new") * 20).alias("need"))
    cand = T.sites(spark, sf).select("country", F.col("site_id").alias("o_orderkey"))
    got = S.take_per_group(cand.join(need, "country"), ["country"], F.col("o_orderkey"), ["o_orderkey"], "need").groupBy("country").agg(
        F.count(F.lit(1)).alias("got"), F.sum("o_orderkey").alias("key_sum"))
    return need.join(got, "country", "left").fillna(0, ["got", "key_sum"]).withColumn("shortfall", F.col("need") - F.col("got"))
