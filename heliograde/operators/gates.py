"""Pass rates, potential, box margins, cluster metadata and other per-group tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograde.operators.summaries import mode_value

PURGE_MARGIN, TARGET_MARGIN = 1200.0, 1500.0  # fixed margins in metres


def pass_rates(df: DataFrame, gates: dict[str, Column], combined: dict[str, list[str]], label: str = "label") -> DataFrame:
    """(gate, land, sites): share of each population passing every gate and every combination.

    A missing value fails its gate. One pass over the points.
    """
    flags = {k: F.coalesce(g, F.lit(False)) for k, g in gates.items()}
    for name, parts in combined.items():
        flags[name] = reduce(lambda a, b: a & b, [flags[p] for p in parts])
    rate = lambda g, l: F.round(F.avg(F.when(F.col(label) == l, g.cast("int"))), 6)
    aggs = [rate(g, l).alias(f"{k}__{l}") for k, g in flags.items() for l in (0, 1)]
    rows = [F.struct(F.lit(k).alias("gate"), F.col(f"{k}__0").alias("land"), F.col(f"{k}__1").alias("sites")) for k in flags]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def potential(df: DataFrame, gates: list[Column], land_km2: float, density: float, installed_tw: float, label: str = "label") -> DataFrame:
    """Constrained fraction of land, capacity it could carry, ratio to what is installed."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(g, F.lit(False)) for g in gates])
    frac = F.avg(ok.cast("int"))
    tw = frac * land_km2 * density / 1e6
    return df.filter(F.col(label) == 0).agg(F.round(frac, 6).alias("fraction"), F.round(tw, 4).alias("capacity_tw"), F.round(tw / installed_tw, 4).alias("ratio_installed"))


def widen_margins(boxes: DataFrame) -> DataFrame:
    """Two-tier margin rule between a scene box (minx...) and its polygons (pminx...).

    Exported scenes with less than the purge margin are dropped and padded, scenes not yet
    exported are padded below the target margin; only the sides that fall short move.
    """
    left, low = F.col("pminx") - F.col("minx"), F.col("pminy") - F.col("miny")
    right, high = F.col("maxx") - F.col("pmaxx"), F.col("maxy") - F.col("pmaxy")
    margin = F.least(left, low, right, high)
    purge = F.col("exported") & (margin < PURGE_MARGIN)
    pad = purge | (~F.col("exported") & (margin < TARGET_MARGIN))
    side = lambda gap, moved, old: F.when(pad & (gap < TARGET_MARGIN), moved).otherwise(F.col(old))
    return boxes.withColumns({
        "margin": margin, "purge": purge, "pad": pad,
        "minx": side(left, F.col("pminx") - TARGET_MARGIN, "minx"), "miny": side(low, F.col("pminy") - TARGET_MARGIN, "miny"),
        "maxx": side(right, F.col("pmaxx") + TARGET_MARGIN, "maxx"), "maxy": side(high, F.col("pmaxy") + TARGET_MARGIN, "maxy"),
    })


def cluster_metadata(sites: DataFrame, cluster: str, ident: str, area: str = "area_m2", year: str = "year", country: str = "country") -> DataFrame:
    """Per cluster: size, member ids, area, earliest year, most common country (by name on ties).

    The id list is the one output that grows with a cluster; it is wanted as such.
    """
    agg = sites.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("num_sites"), F.collect_list(ident).alias("original_site_ids"), F.sum(area).alias("total_area"), F.min(year).alias("target_year")
    )
    return agg.join(mode_value(sites, [cluster], country, country), cluster)


def main_effects(runs: DataFrame, pool: str, value: str, reference: Column, knobs: list[str]) -> DataFrame:
    """Mean difference to the pool's reference run for every setting of every knob."""
    ref = runs.filter(reference).select(pool, F.col(value).alias("__ref"))
    d = runs.filter(~reference).join(ref, pool).withColumn("__delta", F.col(value) - F.col("__ref"))
    long = d.select("__delta", F.inline(F.array(*[F.struct(F.lit(k).alias("knob"), F.col(k).cast("bigint").alias("setting")) for k in knobs])))
    return long.groupBy("knob", "setting").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("__delta"), 6).alias("mean_delta"))


def group_z(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """z-score inside the group with population spread; NULL for groups of two or fewer or no spread.

    Group moments are aggregated and joined back, so rows of one group stay spread out.
    """
    m = df.groupBy(group).agg(F.count(value).alias("__n"), F.avg(value).alias("__m"), F.stddev_pop(value).alias("__sd"))
    ok = (F.col("__n") > 2) & (F.col("__sd") > 0)
    return df.join(m, group).withColumn(out, F.when(ok, (F.col(value) - F.col("__m")) / F.col("__sd"))).drop("__n", "__m", "__sd")


def chip_contrast(pixels: DataFrame, keys: list[str], score: str, mask: str, lo: float, hi: float, high: float = 0.6) -> DataFrame:
    """Per chip: masked share in [lo, hi], mean score inside and outside the mask, contrast, spread, high share."""
    s, m = F.col(score), F.col(mask) == 1
    agg = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(m.cast("int")).alias("mfrac"), F.avg(F.when(m, s)).alias("pin"), F.avg(F.when(~m, s)).alias("pbg"),
        F.stddev_pop(s).alias("pstd"), F.avg((s > high).cast("int")).alias("phi"),
    )
    return agg.filter(F.col("mfrac").between(lo, hi)).withColumn("contrast", F.round(F.col("pin") - F.col("pbg"), 6))
