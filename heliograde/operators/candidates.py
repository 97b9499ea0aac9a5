"""Generated points, candidate pools, audits and envelopes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograde.functions.hashing import uniform
from heliograde.functions.scalars import METRES_PER_DEGREE, pad_box, utm_epsg
from heliograde.operators import ranking as R
from heliograde.operators import spatial as G
from heliograde.session import durable

# Fixed values of the compass search.
SHIFTS_M = (8000.0, 15000.0, 25000.0)
BEARINGS = tuple(range(0, 360, 45))

CELLS_ACROSS = 16  # cells of a candidate pool to its clearance


def sphere_points(keys: DataFrame, key: str, lat_lo: float, lat_hi: float, seeds: tuple[int, int] = (1, 2)) -> DataFrame:
    """One point per key, uniform by area between two latitudes."""
    lo, hi = F.sin(F.radians(F.lit(lat_lo))), F.sin(F.radians(F.lit(lat_hi)))
    return keys.select(
        key, (uniform(key, seeds[0]) * 360 - 180).alias("lon"),
        F.degrees(F.asin(lo + uniform(F.col(key) * 3 + 1, seeds[1]) * (hi - lo))).alias("lat"),
    )


def box_points(keys: DataFrame, key: str, minx: float, miny: float, maxx: float, maxy: float, seed_x: int, seed_y: int) -> DataFrame:
    """One point per key, uniform in a lon/lat box."""
    return keys.select(key, (F.lit(minx) + uniform(key, seed_x) * (maxx - minx)).alias("lon"),
                       (F.lit(miny) + uniform(F.col(key) * 3 + 1, seed_y) * (maxy - miny)).alias("lat"))


def candidate_pool(candidates: DataFrame, ident: str, sites: DataFrame, site_id: str, clear: float, reach: float) -> DataFrame:
    """Candidates no site is closer to than ``clear`` and some site is within ``reach`` of.

    The nearest site is searched once for the centre of each cell: a candidate's own distance differs by half a diagonal at most, which
    settles all cells but those that a limit runs through. Only candidates there are searched one by one.
    """
    size = max(clear, reach / 4) / CELLS_ACROSS
    half = size * math.sqrt(3.0) / 2
    index = ["cx", "cy", "cz"]
    placed = candidates.select("*", *G.ecef("lon", "lat")).select(*candidates.columns, *[i.alias(n) for i, n in zip(G._indices(size), index)]).filter("lon IS NOT NULL AND lat IS NOT NULL")
    cells = durable(placed.select(*index).distinct())
    centres = cells.select(*index, *[((F.col(f"c{c}") + 0.5) * size).alias(c) for c in "xyz"])
    spots = durable(G.positions(sites, [], site_id))
    widest = reach + half + 2 * G.SLACK
    near = G._descend(centres, spots, [], index, widest, G._ring(1), widest).groupBy(*index).agg(F.min("dist_m").alias("__d"))
    low, high = F.col("__d") - half, F.col("__d") + half
    kinds = near.filter((high >= clear - G.SLACK) & (low <= reach + G.SLACK))
    kinds = durable(kinds.select(*index, ((low >= clear + G.SLACK) & (high <= reach - G.SLACK)).alias("__sure")))
    kept = placed.join(kinds, index).drop(*index)
    close = G.nearest_within(kept.filter("NOT __sure"), sites, site_id, reach).filter(F.col("dist_m") >= clear)
    return kept.filter("__sure").select(*candidates.columns).unionByName(close.select(*candidates.columns))


def label_pixels(pixels: DataFrame, footprints: DataFrame, ident: str, embed_year: str, install_year: str) -> DataFrame:
    """1 iff a footprint over the pixel was built after the pixel's imagery.

    The latest installation over a position decides, so footprints of one shape are combined
    and each position is looked up once.
    """
    edges = ["minx", "miny", "maxx", "maxy"]
    shapes = footprints.groupBy(*edges).agg(F.max(install_year).alias("__y"))
    spots = pixels.select("lon", "lat").distinct().select("lon", "lat", F.col("lon").alias("minx"), F.col("lat").alias("miny"), F.col("lon").alias("maxx"), F.col("lat").alias("maxy"))
    last = G.box_pairs(spots, shapes, left_points=True).groupBy("lon", "lat").agg(F.max("__y").alias("__last"))
    return pixels.join(last, ["lon", "lat"], "left").withColumn("label", F.when(F.col("__last") > F.col(embed_year), 1).otherwise(0)).drop("__last")


def distance_audit(nearest: DataFrame, half_diagonal: float, limit: float) -> DataFrame:
    """Distance summary of a constraint: extremes, quantiles, breaches by centre and by footprint edge.

    Both conventions of the limit are reported: below it, and up to and including it.
    """
    d = F.col("dist_m")
    edge = d - half_diagonal
    q = R.quantiles(nearest, [], "dist_m", {"p1": 0.01, "median": 0.5})
    counts = nearest.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min(d), 3).alias("min_m"), F.count_if(d < limit).alias("centre_within_5km"),
        F.count_if(edge < limit).alias("edge_within_5km"), F.count_if(edge <= limit).alias("edge_upto_5km"), F.count_if(edge < 0).alias("inside"),
    )
    return counts.transform(R.attach_row, q.select(F.round("p1", 3).alias("p1"), F.round("median", 3).alias("median")))


def compass_shift(sites: DataFrame, ident: str, group: str, clear: float) -> DataFrame:
    """First safe point per group: sites in id order, shifted 8, 15, 25 km in eight directions."""
    steps = [F.struct(F.lit(i + 1).alias("step"), F.lit(d).alias("d"), F.lit(float(a)).alias("a")) for i, (d, a) in enumerate((d, a) for d in SHIFTS_M for a in BEARINGS)]
    moved = sites.select(ident, group, F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.inline(F.array(*steps))).select(
        ident, group, "step",
        (F.col("lon0") + F.col("d") * F.cos(F.radians("a")) / (F.cos(F.radians("lat0")) * METRES_PER_DEGREE)).alias("lon"),
        (F.col("lat0") + F.col("d") * F.sin(F.radians("a")) / METRES_PER_DEGREE).alias("lat"),
    ).withColumn("key", F.concat_ws("_", ident, "step"))
    safe = G.clear_of(moved, sites.select(F.col(ident).alias("__site"), "lon", "lat"), "key", "__site", clear)
    return safe.groupBy(group).agg(F.min(F.struct(ident, "step", "lon", "lat")).alias("s")).select(group, "s.*")


def cluster_envelopes(members: DataFrame, cluster: str, pad: float) -> DataFrame:
    """Padded lon/lat envelope of each cluster."""
    e = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("num_sites"), F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    dx = pad / (F.cos(F.radians((F.col("y0") + F.col("y1")) / 2)) * METRES_PER_DEGREE)
    dy = F.lit(pad / METRES_PER_DEGREE)
    r = lambda c, n: F.round(c, 6).alias(n)
    return e.select(cluster, "num_sites", r(F.col("x0") - dx, "minx"), r(F.col("y0") - dy, "miny"), r(F.col("x1") + dx, "maxx"), r(F.col("y1") + dy, "maxy"))


def covering_cells(boxes: DataFrame, step: float) -> DataFrame:
    """Distinct grid cells that touch any box, with the UTM code of the cell corner."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / step).cast("bigint"), F.floor(F.col(hi) / step).cast("bigint"))
    cells = boxes.select(F.explode(span("minx", "maxx")).alias("cx"), "miny", "maxy").select("cx", F.explode(span("miny", "maxy")).alias("cy")).distinct()
    return cells.select("cx", "cy", utm_epsg(F.col("cx") * step, F.col("cy") * step).cast("int").alias("epsg"))
