"""Descriptive tables: buckets, shares, concentration, distributions, roll-ups, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograde.operators import ranking as R


def conditional_counts(df: DataFrame, group: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Total and one count per named condition."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def shares(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Sum and count per group with share and cumulative share, largest first (ties by name).

    The cumulative share runs over group totals, not rows: mass of larger totals from running
    sums, ties resolved inside one total.
    """
    per = df.groupBy(group).agg(F.sum(value).alias("mass"), F.count(F.lit(1)).alias("n"))
    dist = R.value_counts(per, [], "mass", {"k": F.lit(1), "m": F.col("mass")})
    run = R.running_sums(dist, [], "mass", ["k", "m"]).select(
        "mass", F.col("total_m").alias("__total"), (F.col("total_m") - F.col("below_m") - F.col("m")).alias("__above"))
    w = Window.partitionBy("mass").orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(run, "mass").withColumn("__cum", F.col("__above") + F.sum("mass").over(w))
    return out.select(
        group, "mass", "n", F.round(100 * F.col("mass") / F.col("__total"), 6).alias("share_pct"),
        F.round(100 * F.col("__cum") / F.col("__total"), 6).alias("cum_pct"),
    )


def cap_table(df: DataFrame, count: str, caps: list[int]) -> DataFrame:
    """For each cap: rows bound by it, mass kept and its share. Caps are a fixed list, so this is
    one aggregation whatever the number of caps."""
    total = F.sum(count)
    aggs = [total.alias("__t")]
    for c in caps:
        aggs += [F.count_if(F.col(count) > c).alias(f"__b{c}"), F.sum(F.least(F.col(count), F.lit(c))).alias(f"__k{c}")]
    rows = [F.struct(F.lit(c).alias("cap"), F.col(f"__b{c}").alias("bound"), F.col(f"__k{c}").alias("kept"),
                     F.round(100 * F.col(f"__k{c}") / F.col("__t"), 6).alias("kept_pct")) for c in caps]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def gini(df: DataFrame, group: list[str], value: str, empty: float | None = None) -> DataFrame:
    """Gini coefficient of ``value`` per group; ``empty`` when all mass is zero.

    sum((2 i - n - 1) x_i) needs only the position range of each distinct value.
    """
    dist = R.value_counts(R.clean_scores(df, value), group, value, {"k": F.lit(1)})
    p = R.running_sums(dist, group, value, ["k"])
    # Positions below+1 .. below+k: their (2 i - n - 1) sum to k (2 below + k - n).
    num = F.sum(F.col(value) * F.col("k") * (2 * F.col("below_k") + F.col("k") - F.col("total_k")))
    den = F.max("total_k") * F.sum(F.col(value) * F.col("k"))
    g = num / F.nullif(den, F.lit(0))
    g = F.round(F.coalesce(g, F.lit(empty).cast("double")), 6).alias("gini")
    return p.groupBy(*group).agg(g) if group else p.agg(g)


def distribution(df: DataFrame, group: list[str], value: str, probs=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Percentiles, mean, population spread, coefficient of variation."""
    dist = R.value_counts(R.clean_scores(df, value), group, value, {"n": F.lit(1)})
    p = R.running_sums(dist, group, value, ["n"])
    v, n = F.col(value), F.col("n")
    count, mean = F.max("total_n"), F.sum(v * n) / F.max("total_n")
    var = F.sum(v * v * n) / count - mean * mean
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    qs = {f"p{round(x * 100)}": x for x in probs}
    q = [F.round(e, 6).alias(name) for e, name in zip(R.quantile_exprs(value, "n", qs), qs)]
    aggs = [count.alias("n"), *q, F.round(mean, 4).alias("mean"), F.round(sd, 4).alias("sd"), F.round(sd / F.nullif(mean, F.lit(0.0)), 4).alias("cv")]
    return p.groupBy(*group).agg(*aggs) if group else p.agg(*aggs)


def bins(value: Column, edges: list[tuple[str, float, float]]) -> Column:
    """Name of the [lo, hi) bin."""
    out = None
    for name, lo, hi in edges:
        inside = (value >= lo) & (value < hi)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def top_and_bottom(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k largest and k smallest groups with their place from either end."""
    top = df.orderBy(F.desc(value), group).limit(k).withColumn("side", F.lit("deficit"))
    low = df.orderBy(F.asc(value), group).limit(k).withColumn("side", F.lit("surplus"))
    wt, wl = Window.partitionBy("side").orderBy(F.desc(value), group), Window.partitionBy("side").orderBy(F.asc(value), group)
    t = top.select("side", F.row_number().over(wt).alias("place"), group, value)
    return t.unionByName(low.select("side", F.row_number().over(wl).alias("place"), group, value))


def mode_value(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Most frequent value per group, the smallest on ties, by a two-level count."""
    c = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    return c.groupBy(*group).agg(F.min_by(F.col(value), F.struct(-F.col("__c"), F.col(value))).alias(out))


def between_share(df: DataFrame, cls: str, value: str) -> DataFrame:
    """Share of variance between classes (eta squared)."""
    per = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    mean = F.sum("s") / F.sum("n")
    total = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * mean
    return per.agg(F.sum("n").alias("n"), F.round(between / F.nullif(total, F.lit(0.0)), 6).alias("eta_squared"))


def best_feasible(df: DataFrame, pool: str, metric: str, tag: str, feasible: Column, incumbent: Column) -> DataFrame:
    """Best feasible config of every pool plus the incumbent, each config once."""
    best = df.filter(feasible).groupBy(pool).agg(F.max_by(F.struct(tag, metric), F.struct(F.col(metric), F.col(tag))).alias("b")).select(pool, "b.*", F.lit("best").alias("pick"))
    inc = df.filter(incumbent).select(pool, tag, metric, F.lit("incumbent").alias("pick"))
    both = best.unionByName(inc)
    return both.groupBy(pool, tag, metric).agg(F.min("pick").alias("pick"))


def diversified_top(df: DataFrame, group: str, key: str, rank: str, cap: int, n: int) -> DataFrame:
    """The n best rows with at most ``cap`` per group."""
    w = Window.partitionBy(group).orderBy(F.desc(rank), key)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= cap).drop("__rn").orderBy(F.desc(rank), key).limit(n)
