"""Caps, budgets and splits. Sizes, strata and guarantees are exact; 'random' is hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograde.functions.hashing import hash_order
from heliograde.operators import ranking as R
from heliograde.session import durable


def cap_per_group(df: DataFrame, group: list[str], key: Column, ties: list[str], cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of each group. A small cap is applied on the map side before the shuffle."""
    w = Window.partitionBy(*group).orderBy("__h", *ties)
    ranked = df.withColumn("__h", hash_order(key, seed)).withColumn("__rn", F.row_number().over(w))
    return ranked.filter(F.col("__rn") <= cap).drop("__h", "__rn")


def take_per_group(df: DataFrame, group: list[str], key: Column, ties: list[str], quota: str, seed: int = 0) -> DataFrame:
    """The first ``quota`` (a column, constant in each group) rows of each group in hash order."""
    placed = R.hash_positions(df, group, key, ties, seed, "__pos", upto=F.col(quota))
    return placed.filter(F.col("__pos") <= F.col(quota)).drop("__pos")


def split_first(df: DataFrame, group: list[str], key: Column, ties: list[str], n: int, seed: int = 0) -> DataFrame:
    """Tag the first ``n`` rows of each group as kept and the rest as overflow."""
    placed = R.hash_positions(df, group, key, ties, seed, "__pos")
    return placed.withColumn("part", F.when(F.col("__pos") <= n, "kept").otherwise("overflow")).drop("__pos")


def fill_to_target(df: DataFrame, group: list[str], key: Column, ties: list[str], amount: str, target: str, seed: int = 0) -> DataFrame:
    """Rows in hash order while their running amount stays within the group's target.

    A group whose first row already exceeds the target keeps that row, so no group vanishes.
    The running amount is built from per-slice totals, as in ``ranking.hash_positions``.
    """
    base = df.withColumn("__h", hash_order(key, seed)).withColumn(
        R.CELL, F.floor(F.col("__h") / F.lit(R.SPAN // R.CELLS)).cast("int")
    )
    totals = base.groupBy(*group, R.CELL).agg(F.sum(amount).alias("__t"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy(R.CELL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, R.CELL,
        F.coalesce(F.sum("__t").over(earlier), F.lit(0.0)).alias("__o"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy(*group, R.CELL).orderBy("__h", *ties)
    placed = (
        base.join(offsets, [*group, R.CELL])
        .withColumn("cum_amount", F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__o"))
        .withColumn("__pos", F.row_number().over(inside) + F.col("__before"))
    )
    kept = placed.filter((F.col("cum_amount") <= F.col(target)) | (F.col("__pos") == 1))
    return kept.drop("__h", R.CELL, "__o", "__before", "__pos")


def even_budget(counts: DataFrame, group: list[str], member: str, count: str, budget: str, out: str = "alloc") -> DataFrame:
    """Share each group's ``budget`` over its members as evenly as their ``count`` allows.

    Closed form instead of a loop: find the highest level L at which sum(min(count, L)) still
    fits, give everyone min(count, L), and hand the units left over to the members with the
    largest count above L, one each (ties in hash order of the member).

    Works on distinct counts, so a group with millions of members is a short table, and
    only members exactly at the boundary count are ordered.
    """
    dist = counts.filter(F.col(count) > 0).groupBy(*group, count).agg(
        F.count(F.lit(1)).alias("k"), F.sum(count).alias("mass"), F.max(budget).alias("__budget")
    )
    p = durable(R.running_sums(dist, group, count, ["k", "mass"]))
    rest = F.col("total_k") - F.col("below_k")  # members with at least this count
    fits = F.col("below_mass") + rest * F.col(count) <= F.col("__budget")
    level_here = F.floor((F.col("__budget") - F.col("below_mass")) / rest)
    # The first count that does not fit fixes the level; if all fit, everyone gets everything.
    level = p.groupBy(*group).agg(
        F.coalesce(F.min(F.when(~fits, F.struct(F.col(count), level_here.alias("l")))).getField("l"), F.max(count)).alias("__level"),
        F.least(F.max("__budget"), F.max("total_mass")).alias("__b"),
    )
    leveled = p.join(level, group)
    spent = leveled.groupBy(*group).agg(
        F.max("__level").alias("__level"),
        (F.max("__b") - F.sum(F.col("k") * F.least(F.col(count), F.col("__level")))).alias("__left"),
    )
    # Members above this count, for handing out the rest from the largest down.
    above = F.col("total_k") - F.col("below_k") - F.col("k")
    extra = (
        p.join(spent, group)
        .select(*group, count, "__level", F.when(F.col(count) > F.col("__level"),
                F.greatest(F.least(F.col("__left") - above, F.col("k")), F.lit(0))).otherwise(0).alias("__extra"),
                F.col("k").alias("__k"))
    )
    each = counts.filter(F.col(count) > 0).join(extra, [*group, count])
    sure = each.filter((F.col("__extra") == 0) | (F.col("__extra") == F.col("__k"))).withColumn(
        "__plus", F.when(F.col("__extra") > 0, 1).otherwise(0)
    )
    edge = R.hash_positions(
        each.filter((F.col("__extra") > 0) & (F.col("__extra") < F.col("__k"))), group, F.col(member), [member], 0, "__pos"
    ).withColumn("__plus", F.when(F.col("__pos") <= F.col("__extra"), 1).otherwise(0)).drop("__pos")
    return sure.unionByName(edge).withColumn(out, (F.least(F.col(count), F.col("__level")) + F.col("__plus")).cast("bigint")).drop(
        "__level", "__extra", "__k", "__plus"
    )


def spread_sample(df: DataFrame, country: str, cell: str, site: str, key: Column, ties: list[str], budget: int, seed: int = 0) -> DataFrame:
    """At most ``budget`` rows per country, spread evenly over cells, then over sites in a cell.

    Countries within budget are taken whole. Only counts are shuffled to plan the quotas; the
    rows themselves move once, to be ordered inside their (site, hash slice).
    """
    per_site = durable(df.groupBy(country, cell, site).agg(F.count(F.lit(1)).alias("__c")))
    per_cell = per_site.groupBy(country, cell).agg(F.sum("__c").alias("__cc")).withColumn("__b", F.lit(budget).cast("bigint"))
    cell_quota = even_budget(per_cell, [country], cell, "__cc", "__b", "__cell_quota").select(country, cell, "__cell_quota")
    site_in = durable(per_site.join(cell_quota, [country, cell]))
    site_quota = even_budget(site_in, [country, cell], site, "__c", "__cell_quota", "__quota").select(country, cell, site, "__quota")
    quoted = df.join(site_quota, [country, cell, site]).filter(F.col("__quota") > 0)
    return take_per_group(quoted, [country, cell, site], key, ties, "__quota", seed).drop("__quota")


def grouped_split(scenes: DataFrame, stratum: str, scene: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Send whole scenes to test: per stratum max(1, min(round(share n), n - 1)), none when n < 2."""
    unique = scenes.select(stratum, scene).distinct()
    n = unique.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    quota = F.when(F.col("__n") >= 2, F.greatest(F.lit(1), F.least(F.round(F.col("__n") * share), F.col("__n") - 1))).otherwise(0)
    placed = R.hash_positions(unique.join(n.withColumn("__q", quota.cast("bigint")), stratum), [stratum], F.col(scene), [scene], seed, "__pos")
    return placed.select(stratum, scene, F.when(F.col("__pos") <= F.col("__q"), "test").otherwise("train").alias("split"))


def row_split(df: DataFrame, stratum: str, key: Column, ties: list[str], share: float = 0.2, minimum: int = 5, seed: int = 0) -> DataFrame:
    """Row split per stratum, floor(share n) to test; strata below ``minimum`` stay in train."""
    n = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    quota = F.when(F.col("__n") >= minimum, F.floor(F.col("__n") * share)).otherwise(0)
    placed = R.hash_positions(df.join(n.withColumn("__q", quota), stratum), [stratum], key, ties, seed, "__pos")
    return placed.withColumn("split", F.when(F.col("__pos") <= F.col("__q"), "test").otherwise("train")).drop("__pos", "__q", "__n")


def balanced_classes(df: DataFrame, label: str, key: Column, ties: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each class (all of a smaller class)."""
    return take_per_group(df.withColumn("__q", F.lit(n)), [label], key, ties, "__q", seed).drop("__q")


def class_ratio(df: DataFrame, label: str, key: Column, ties: list[str], ratios: list[int], seed: int = 0) -> DataFrame:
    """All positives and ``r`` times as many negatives, for each ratio r, tagged with ``ratio``.

    Ratios nest: the negatives of a smaller ratio are a prefix of those of a larger one, so a
    single placement serves all of them.
    """
    n_pos = df.agg(F.sum((F.col(label) == 1).cast("int")).alias("__p"))
    top = max(ratios)
    neg = df.filter(F.col(label) == 0).transform(R.attach_row, n_pos)
    neg = R.hash_positions(neg, [], key, ties, seed, "__pos", upto=F.col("__p") * top)
    tagged = neg.select("*", F.explode(F.array(*[F.lit(r) for r in ratios])).alias("ratio")).filter(
        F.col("__pos") <= F.col("__p") * F.col("ratio")
    ).drop("__pos", "__p")
    pos = df.filter(F.col(label) == 1).select("*", F.explode(F.array(*[F.lit(r) for r in ratios])).alias("ratio"))
    return pos.unionByName(tagged)


def balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """Class weight n / (2 n_class)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    total = per.agg(F.sum("__nc").alias("__n"))
    return per.transform(R.attach_row, total).select(label, (F.col("__n") / (2.0 * F.col("__nc"))).alias("weight"))


def country_mass_weight(df: DataFrame, country: str, label: str, lo: float = 0.05, hi: float = 20.0) -> DataFrame:
    """Per-country weight of negatives that gives them the positives' country mass, clipped.

    A country without positives gets zero and hence the lower clip.
    """
    per = df.groupBy(country).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("__p"), F.sum((F.col(label) == 0).cast("bigint")).alias("__n")
    )
    total = per.agg(F.greatest(F.sum("__p"), F.lit(1)).alias("__tp"), F.greatest(F.sum("__n"), F.lit(1)).alias("__tn"))
    share = (F.col("__p") / F.col("__tp")) / F.nullif(F.col("__n") / F.col("__tn"), F.lit(0.0))
    w = F.least(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(lo)), F.lit(hi))
    return per.transform(R.attach_row, total).select(country, F.col("__p").alias("n_pos"), F.col("__n").alias("n_neg"), w.alias("neg_weight"))
