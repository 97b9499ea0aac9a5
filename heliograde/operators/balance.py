"""Making one country distribution follow another: shares, deficits, fills, manifests.

Inputs are per-country count tables. Running sums go through ``ranking`` so that even a
table with very many groups is not sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograde.operators import ranking as R
from heliograde.session import durable


def proportional_targets(counts: DataFrame, group: str, now: str, wanted: str) -> DataFrame:
    """Shares of both columns, the proportional target at the present total, and the deficit."""
    t = counts.agg(F.sum(now).alias("__n"), F.sum(wanted).alias("__p"))
    return counts.transform(R.attach_row, t).select(
        group, now, wanted,
        (F.col(wanted) / F.nullif(F.col("__p"), F.lit(0))).alias("pos_share"),
        (F.col(now) / F.greatest(F.col("__n"), F.lit(1))).alias("neg_share"),
        F.round(F.col(wanted) / F.nullif(F.col("__p"), F.lit(0)) * F.col("__n")).cast("bigint").alias("target"),
    ).withColumn("deficit", F.col("target") - F.col(now))


def distribution_distance(shares: DataFrame, a: str, b: str) -> DataFrame:
    """Total-variation distance and overlap of two share columns."""
    return shares.agg(
        F.round(0.5 * F.sum(F.abs(F.col(a) - F.col(b))), 6).alias("tv_distance"),
        F.round(F.sum(F.least(a, b)), 6).alias("overlap"),
    )


def fill_to_shares(shares: DataFrame, group: str, now: str, share: str, totals: list[int]) -> DataFrame:
    """Units to add per group so that the total reaches each N, always to the most under-filled.

    Adding one unit at a time to the group furthest below its share ends at a common level:
    every group that receives any has (share - count / N) cut down to one value, found from
    running sums over groups ordered by that gap. Whole units go by largest remainder; groups
    above the level are untouched. N at or below the present total adds nothing.
    """
    base = shares.agg(F.sum(now).alias("__c0"))
    long = shares.transform(R.attach_row, base).select(
        group, now, share, "__c0", F.explode(F.array(*[F.lit(n) for n in totals])).alias("total")
    ).withColumn("__need", F.greatest(F.col("total") - F.col("__c0"), F.lit(0)))
    gap = F.col(share) * F.col("total") - F.col(now)  # in units
    long = durable(long.withColumn("__neg_gap", -gap))
    dist = R.value_counts(long, ["total"], "__neg_gap", {"k": F.lit(1), "g": F.col("__neg_gap")})
    p = R.running_sums(dist, ["total"], "__neg_gap", ["k", "g"])
    need = long.groupBy("total").agg(F.max("__need").alias("__need"))
    # Level with the groups down to this gap filled: lowering them all to this gap must cost less than needed.
    cost_here = -F.col("below_g") + F.col("below_k") * F.col("__neg_gap")
    k, g = F.col("below_k") + F.col("k"), -(F.col("below_g") + F.col("g"))
    level = (
        p.join(need, "total").filter((cost_here < F.col("__need")) | (F.col("below_k") == 0))
        .groupBy("total").agg(F.max(F.struct(k.alias("k"), ((g - F.col("__need")) / k).alias("level"))).alias("m"))
        .select("total", "m.level")
    )
    raw = F.greatest(F.lit(0.0), -F.col("__neg_gap") - F.col("level"))
    long = durable(long.join(level, "total")).withColumn("__raw", F.when(F.col("__need") > 0, F.round(raw, 9)).otherwise(0.0))
    left = long.groupBy("total").agg((F.max("__need") - F.sum(F.floor("__raw"))).alias("__left"))
    frac = F.round(F.col("__raw") - F.floor("__raw"), 9)
    long = durable(long.join(left, "total").withColumn("__frac", frac))
    dist2 = R.value_counts(long.filter("__frac > 0"), ["total"], "__frac", {"k": F.lit(1)})
    rank = R.running_sums(dist2, ["total"], "__frac", ["k"], (0.0, 1.0)).select(
        "total", "__frac", (F.col("total_k") - F.col("below_k") - F.col("k")).alias("__ahead"), F.col("k").alias("__tied")
    )
    long = long.join(rank, ["total", "__frac"], "left")
    ties = R.hash_positions(long.filter("__ahead < __left"), ["total", "__frac"], F.xxhash64(group).bitwiseAND(F.lit(2**31 - 1)), [group], 0, "__pos")
    plus = ties.filter(F.col("__ahead") + F.col("__pos") <= F.col("__left")).select("total", group, F.lit(1).alias("__one"))
    return long.join(plus, ["total", group], "left").select(
        "total", group, now, share, (F.floor("__raw") + F.coalesce("__one", F.lit(0))).cast("bigint").alias("add")
    )


def download_manifest(plan: DataFrame, group: str, on_disk: str, filled: str, target: str, priority: str) -> DataFrame:
    """Final counts (priority groups are topped up to target) and what is still to be mined."""
    final = F.when(F.col(priority), F.greatest(filled, target)).otherwise(F.col(filled))
    return plan.withColumn("final", final.cast("bigint")).withColumn(
        "add_new", F.greatest(F.col("final") - F.col(on_disk), F.lit(0))
    )


def starvation_report(plan: DataFrame, final: str, target: str, mass: str, min_mass: int = 300, min_fill: float = 70.0) -> DataFrame:
    """Groups still below target: shortfall, fill percentage and whether they are starved."""
    fill = F.round(100 * F.col(final) / F.nullif(F.col(target), F.lit(0)))
    return plan.filter(F.col(final) < F.col(target)).withColumn("fill_pct", fill).withColumn(
        "short", F.col(target) - F.col(final)
    ).withColumn("starved", (F.col(mass) >= min_mass) & (F.col("fill_pct") < min_fill))
