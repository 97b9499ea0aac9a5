"""Rasters as tables keyed by (ri, ci): sampling, coarsening, differences, binning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograde.functions.vectors import unit
from heliograde.session import durable


def to_cells(df: DataFrame, step: float, minx: float, maxy: float) -> DataFrame:
    """Row and column of the grid cell of each point."""
    return df.withColumn("ci", F.round((F.col("lon") - minx) / step).cast("bigint")).withColumn(
        "ri", F.round((F.lit(maxy) - F.col("lat")) / step).cast("bigint")
    )


def rasterise(df: DataFrame, value: str, order: str, step: float, minx: float, maxy: float) -> DataFrame:
    """One value per cell: that of the point with the largest ``order``."""
    return to_cells(df, step, minx, maxy).groupBy("ri", "ci").agg(F.max_by(value, order).alias(value))


def sample_grid(points: DataFrame, grid: DataFrame, value: str, step: float, minx: float, maxy: float) -> DataFrame:
    """Grid value at the cell of each point (NULL off the grid)."""
    return to_cells(points, step, minx, maxy).join(grid.select("ri", "ci", value), ["ri", "ci"], "left")


def block_mean(grid: DataFrame, values: list[str], factor: int, keep_partial: bool = False) -> DataFrame:
    """Average over factor x factor blocks; blocks with missing cells are dropped."""
    out = grid.groupBy(
        F.floor(F.col("ri") / factor).cast("bigint").alias("ri"), F.floor(F.col("ci") / factor).cast("bigint").alias("ci")
    ).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(v).alias(v) for v in values])
    return (out if keep_partial else out.filter(F.col("__n") == factor * factor)).drop("__n")


def neighbour_steps(grid: DataFrame, value: str) -> DataFrame:
    """Absolute differences to the next cell right and below. Neighbours meet by an equi-join on
    cell keys, so a grid line of any length is never one task."""
    here = grid.select("ri", "ci", F.col(value).alias("__v"))
    right = here.select("ri", (F.col("ci") - 1).alias("ci"), F.col("__v").alias("__r"))
    down = here.select((F.col("ri") - 1).alias("ri"), "ci", F.col("__v").alias("__d"))
    return here.join(right, ["ri", "ci"], "left").join(down, ["ri", "ci"], "left").select(
        "ri", "ci", F.abs(F.col("__r") - F.col("__v")).alias("step_right"), F.abs(F.col("__d") - F.col("__v")).alias("step_down")
    )


def roughness(grid: DataFrame, value: str) -> DataFrame:
    """Mean of the mean absolute steps along rows and along columns."""
    return neighbour_steps(grid, value).agg(((F.avg("step_right") + F.avg("step_down")) / 2).alias("roughness"))


def slope_aspect(grid: DataFrame, elevation: str, cell_metres: float) -> DataFrame:
    """Slope and aspect in degrees from central differences, one-sided at edges."""
    e = grid.select("ri", "ci", F.col(elevation).cast("double").alias("__e"))
    shifted = lambda dr, dc, n: e.select((F.col("ri") - dr).alias("ri"), (F.col("ci") - dc).alias("ci"), F.col("__e").alias(n))
    j = e
    for dr, dc, n in ((0, -1, "__w"), (0, 1, "__x"), (-1, 0, "__n"), (1, 0, "__s")):
        j = j.join(shifted(dr, dc, n), ["ri", "ci"], "left")

    def gradient(lo: str, hi: str) -> Column:
        width = F.when(F.col(lo).isNotNull() & F.col(hi).isNotNull(), 2.0).otherwise(1.0)
        return (F.coalesce(F.col(hi), F.col("__e")) - F.coalesce(F.col(lo), F.col("__e"))) / width / cell_metres

    gx, gy = gradient("__w", "__x"), gradient("__n", "__s")
    return j.select(
        "ri", "ci", F.degrees(F.atan(F.hypot(gx, gy))).alias("slope"),
        F.pmod(F.degrees(F.atan2(-gx, gy)), F.lit(360.0)).alias("aspect"),
    )


def mean_vector(df: DataFrame, keys: list[str], vec: str, renormalise: bool = False) -> DataFrame:
    """Component-wise mean of embeddings per key, summed by component so that a crowded key
    is combined before the shuffle."""
    parts = df.select(*keys, F.posexplode(vec).alias("__i", "__x")).groupBy(*keys, "__i").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    mean = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__m"))).alias("__a"))
    out = mean.select(*keys, F.transform("__a", lambda s: s.getField("__m")).alias(vec))
    return out.withColumn(vec, unit(vec)) if renormalise else out


def pyramid(cells: DataFrame, factors: list[int], sums: list[str], vec: str, dims: int) -> dict[int, DataFrame]:
    """Block sums of a raster at several factors: the ``sums`` columns and the components of ``vec`` over factor x factor cells.

    Each level is built from the coarsest finer one that divides it, so the raster is read only for the factors that no
    other one divides; levels that others build on are written once. A block is one row whatever ``dims`` is, summed on the map side first.
    """
    order = sorted(set(factors) | {1})
    parent = {f: max(g for g in order if g < f and f % g == 0) for f in order[1:]}
    out = {1: cells.select("ri", "ci", *sums, vec)}
    for f in order[1:]:
        k = f // parent[f]
        block = lambda c: F.floor(F.col(c) / k).cast("bigint").alias(c)  # noqa: B023, E731
        level = out[parent[f]].groupBy(block("ri"), block("ci")).agg(
            *[F.sum(s).alias(s) for s in sums], F.array(*[F.sum(F.col(vec)[i].cast("double")) for i in range(dims)]).alias(vec))
        out[f] = durable(level) if f in parent.values() else level
    return {f: out[f] for f in factors}


def smooth_bins(df: DataFrame, value: str, step: float, sigma: float, radius: int, floor: float = 0.05) -> DataFrame:
    """Mean per lon/lat bin, then Gaussian smoothing of value and mask together.

    Bins whose smoothed weight stays below ``floor`` are NULL. Each occupied bin is spread
    over a fixed kernel and summed, so the cost is bins times kernel size.
    """
    bins = df.groupBy(
        F.floor(F.col("lon") / step).cast("bigint").alias("bx"), F.floor(F.col("lat") / step).cast("bigint").alias("by")
    ).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    norm = sum(taps)
    kernel = [
        F.struct(F.lit(i - radius).cast("bigint").alias("dx"), F.lit(j - radius).cast("bigint").alias("dy"), F.lit(a * b / norm**2).alias("k"))
        for i, a in enumerate(taps) for j, b in enumerate(taps)
    ]
    spread = bins.select("bx", "by", "mean", F.inline(F.array(*kernel))).groupBy(
        (F.col("bx") + F.col("dx")).alias("bx"), (F.col("by") + F.col("dy")).alias("by")
    ).agg(F.sum(F.col("mean") * F.col("k")).alias("__v"), F.sum("k").alias("weight"))
    return bins.join(spread, ["bx", "by"]).select(
        "bx", "by", "n", "mean", "weight", F.when(F.col("weight") >= floor, F.col("__v") / F.col("weight")).alias("smooth")
    )


def density_histogram(df: DataFrame, group: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Histogram per group that integrates to one; the last bin includes its upper edge."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(value) - lo) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    counts = df.filter(F.col(value).between(lo, hi)).groupBy(*group, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*group).agg(F.sum("n").alias("__t"))
    return counts.join(total, group).select(*group, "bin", "n", (F.col("n") / (F.col("__t") * width)).alias("density"))
