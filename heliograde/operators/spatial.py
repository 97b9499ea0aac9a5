"""Distance and containment joins on plain columns.

Distances are straight chords between WGS84 positions in earth-centred coordinates, so
there is no projection and no seam at the date line. Searches never emit all pairs of a
crowded area: the searched side is summarised into nested cells (count and tight bounds per
cell), each searching position keeps only the cells that can still hold its answer, and
single points are touched at the last step. Identical positions are searched once.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograde.session import durable

# WGS84 ellipsoid.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
ECC2 = FLATTENING * (2 - FLATTENING)

FINEST_CELL = 16.0  # metres; cells are refined until they are at most 8 times this
SLACK = 0.002  # metres, keeps candidates that tie after rounding to a millimetre
RADII = (5_000.0, 80_000.0, 1_280_000.0, 20_480_000.0)
OFFSET = 1 << 20  # cell indices fit 21 bits each


def ecef(lon: Column | str, lat: Column | str) -> list[Column]:
    """Earth-centred x, y, z in metres."""
    lo = F.radians(F.col(lon) if isinstance(lon, str) else lon)
    la = F.radians(F.col(lat) if isinstance(lat, str) else lat)
    n = F.lit(SEMI_MAJOR) / F.sqrt(1 - ECC2 * F.sin(la) * F.sin(la))
    return [
        (n * F.cos(la) * F.cos(lo)).alias("x"),
        (n * F.cos(la) * F.sin(lo)).alias("y"),
        (n * (1 - ECC2) * F.sin(la)).alias("z"),
    ]


def ecef_sql(lon: str, lat: str) -> tuple[str, str, str]:
    """The same three expressions as SQL text."""
    n = f"({SEMI_MAJOR} / sqrt(1 - {ECC2} * sin(radians({lat})) * sin(radians({lat}))))"
    return (
        f"{n} * cos(radians({lat})) * cos(radians({lon}))",
        f"{n} * cos(radians({lat})) * sin(radians({lon}))",
        f"{n} * {1 - ECC2} * sin(radians({lat}))",
    )


def chord(a: tuple, b: tuple) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0.0)))


def _pack(ix: Column, iy: Column, iz: Column) -> Column:
    return ((ix + OFFSET) * (1 << 42) + (iy + OFFSET) * (1 << 21) + (iz + OFFSET)).cast("bigint")


def _indices(size: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(size)).cast("bigint").alias(f"i{c}") for c in "xyz"]


def _key(shift: int) -> Column:
    return _pack(*[F.shiftright(f"i{c}", shift) for c in "xyz"])


def _ring(width: int, half: bool = False) -> list[int]:
    steps = range(-width, width + 1)
    offs = [dx * (1 << 42) + dy * (1 << 21) + dz for dx, dy, dz in itertools.product(steps, steps, steps)]
    return [o for o in offs if o > 0] if half else offs


def _bounds() -> tuple[Column, Column]:
    """Smallest and largest possible distance from (x, y, z) to a cell's occupants."""
    low, high = F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        gap = F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0))
        far = F.greatest(F.abs(F.col(c) - F.col(f"lo_{c}")), F.abs(F.col(c) - F.col(f"hi_{c}")))
        low, high = low + gap * gap, high + far * far
    return F.sqrt(low), F.sqrt(high)


def _nodes(points: DataFrame, group: list[str], shift: int, foreign: bool = False) -> DataFrame:
    """Cells at one level: how many positions and their tight bounds, and the range of tags. A plain aggregation."""
    return points.groupBy(*group, _key(shift).alias("cell")).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min(_key(shift + 3)).alias("parent"),
        *[F.min(c).alias(f"lo_{c}") for c in "xyz"],
        *[F.max(c).alias(f"hi_{c}") for c in "xyz"],
        *([F.min("tag").alias("lo_tag"), F.max("tag").alias("hi_tag")] if foreign else []),
    )


def _descend(left: DataFrame, points: DataFrame, group: list[str], search: list[str], top: float, ring: list[int],
             radius: float, need: int = 1, foreign: bool = False) -> DataFrame:
    """Candidate points for every search key, coarse cells first.

    ``left`` has x, y, z and the ``search`` columns that identify one search; ``points`` has
    x, y, z and ``near_id``. ``search`` may contain ``home``, the top-level cell of the
    candidate, to get an answer per neighbouring cell instead of one overall. With ``foreign`` only points of another ``tag``
    count (both sides have one, ``search`` names it); cells that hold the own tag alone are left at once.
    """
    depth = max(0, math.floor(math.log(top / FINEST_CELL, 8)))
    fine = top / 8**depth
    pts = points.select("*", *_indices(fine))
    probe = left.select("*", *_indices(fine))
    own = [c for c in search if c != "home"]
    front = probe.select(*own, "x", "y", "z", F.explode(F.array(*[_key(3 * depth) + F.lit(o) for o in ring])).alias("home"))
    front = front.withColumn("cell", F.col("home"))
    stats = ["cnt"] + [f"{b}_{c}" for b in ("lo", "hi") for c in "xyz"] + (["lo_tag", "hi_tag"] if foreign else [])
    low, high = _bounds()
    for level in range(depth, -1, -1):
        nodes = _nodes(pts, group, 3 * level, foreign)
        if level == depth:
            front = front.join(nodes.drop("parent"), [*group, "cell"])
        else:
            front = front.drop(*stats).withColumnRenamed("cell", "parent").join(nodes, [*group, "parent"]).drop("parent")
        if foreign:
            front = front.filter((F.col("lo_tag") != F.col("tag")) | (F.col("hi_tag") != F.col("tag")))
        front = front.withColumn("__lb", low).filter(F.col("__lb") <= radius + SLACK).withColumn("__ub", high)
        w = Window.partitionBy(*search)
        if need == 1:
            limit = F.min("__ub").over(w)
            front = front.withColumn("__limit", limit)
        else:
            front = front.withColumn("__run", F.sum("cnt").over(w.orderBy("__ub")))
            front = front.withColumn("__limit", F.min(F.when(F.col("__run") >= need, F.col("__ub"))).over(w)).drop("__run")
        front = front.filter(F.col("__lb") <= F.coalesce(F.col("__limit"), F.lit(float("inf"))) + SLACK)
        front = front.drop("__lb", "__ub", "__limit")
    hits = pts.select(*group, _key(0).alias("cell"), "near_id", *([F.col("tag").alias("ptag")] if foreign else []), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    found = front.select(*search, *[g for g in group if g not in search], "x", "y", "z", "cell").join(hits, [*group, "cell"])
    if foreign:
        found = found.filter(F.col("ptag") != F.col("tag"))
    d = chord((F.col("x"), F.col("y"), F.col("z")), (F.col("px"), F.col("py"), F.col("pz")))
    return found.withColumn("dist_m", F.round(d, 3)).filter(F.col("dist_m") <= radius)


def positions(df: DataFrame, group: list[str], ident: str) -> DataFrame:
    """Distinct positions with the smallest id found there."""
    return df.groupBy(*group, "lon", "lat").agg(F.min(ident).alias("near_id")).select(
        *group, "lon", "lat", "near_id", *ecef("lon", "lat")
    )


def nearest_within(left: DataFrame, right: DataFrame, right_id: str, radius: float, group: list[str] | None = None) -> DataFrame:
    """``left`` rows that have a ``right`` row within ``radius`` metres, with ``near_id`` and ``dist_m``.

    Ties at the same millimetre go to the smallest id. Both sides carry lon and lat.
    """
    group = group or []
    search = [*group, "lon", "lat"]
    probe = left.select(*search).distinct().select(*search, *ecef("lon", "lat"))
    found = _descend(probe, positions(right, group, right_id), group, search, radius, _ring(1), radius)
    best = found.groupBy(*search).agg(F.min(F.struct("dist_m", "near_id")).alias("b"))
    return left.join(best.select(*search, "b.near_id", "b.dist_m"), search)


def nearest(left: DataFrame, right: DataFrame, right_id: str, left_id: str, radii: tuple[float, ...] = RADII,
            group: list[str] | None = None) -> DataFrame:
    """Nearest ``right`` row for every ``left`` row, at any distance.

    Widening rings: rows answered inside one radius are final, only the rest goes on. Each
    ring is written to the checkpoint folder so that an empty remainder ends the search.
    """
    rest, done = left, None
    for radius in radii:
        hit = durable(nearest_within(rest, right, right_id, radius, group))
        done = hit if done is None else done.unionByName(hit)
        rest = durable(rest.join(hit.select(left_id), left_id, "left_anti"))
        if rest.isEmpty():
            break
    return done


def nearest_other(df: DataFrame, ident: str, radius: float, group: list[str] | None = None, among: DataFrame | None = None) -> DataFrame:
    """For every row the nearest other row of its group within ``radius``: ``near_id``, ``dist_m``.

    ``among`` are the rows searched, where they are more than ``df``.
    """
    group = group or []
    search = [*group, "lon", "lat"]
    w = Window.partitionBy(*search).orderBy(ident)
    here = (
        (df if among is None else among).select(*search, ident).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= 2)
        .groupBy(*search).agg(F.min(ident).alias("near_id"), F.count(F.lit(1)).alias("__m"), F.max(ident).alias("__second"))
    )
    here = here.select(*search, "near_id", "__m", "__second", *ecef("lon", "lat"))
    alone = here.filter(F.col("__m") == 1).select(*search, "x", "y", "z")
    if among is not None:
        alone = alone.join(df.select(*search).distinct(), search, "left_semi")
    found = _descend(alone, here.drop("__m", "__second"), group, search, radius, _ring(1), radius, need=2)
    apart = found.filter((F.col("px") != F.col("x")) | (F.col("py") != F.col("y")) | (F.col("pz") != F.col("z")))
    best = apart.groupBy(*search).agg(F.min(F.struct("dist_m", "near_id")).alias("b")).select(*search, "b.near_id", "b.dist_m")
    shared = here.filter(F.col("__m") > 1).select(*search, F.col("near_id").alias("__first"), "__second")
    joined = df.join(best, search, "left").join(shared, search, "left")
    twin = F.when(F.col(ident) == F.col("__first"), F.col("__second")).otherwise(F.col("__first"))
    return joined.withColumn("near_id", F.coalesce(twin, F.col("near_id"))).withColumn(
        "dist_m", F.when(F.col("__first").isNotNull(), F.lit(0.0)).otherwise(F.col("dist_m"))
    ).filter(F.col("dist_m").isNotNull()).drop("__first", "__second")


def foreign_pairs(spots: DataFrame, radius: float) -> DataFrame:
    """(own_id, tag, near_id, ptag, dist_m): for every spot the close ones of another tag, its nearest among them.

    ``spots`` has near_id, tag, x, y, z, one row per position.
    """
    left = spots.select(F.col("near_id").alias("own_id"), "tag", "x", "y", "z")
    found = _descend(left, spots.select("near_id", "tag", "x", "y", "z"), [], ["own_id", "tag"], radius, _ring(1), radius, foreign=True)
    return found.select("own_id", "tag", "near_id", "ptag", "dist_m")


def nearest_other_any(df: DataFrame, ident: str, group: list[str] | None = None, radii: tuple[float, ...] = RADII) -> tuple[DataFrame, DataFrame]:
    """For every row the nearest other row of its group at any distance, and the rows without one.

    Widening rings: a row answered inside a radius is final. The last default radius is wider than the earth, so the rows
    left are those without a company in their group or without a position.
    """
    rest, done = df, None
    for radius in radii:
        hit = durable(nearest_other(rest, ident, radius, group, df))
        done = hit if done is None else done.unionByName(hit)
        rest = durable(rest.join(hit.select(ident), ident, "left_anti"))
        if rest.isEmpty():
            break
    return done, rest


def clear_of(left: DataFrame, right: DataFrame, left_id: str, right_id: str, distance: float) -> DataFrame:
    """``left`` rows with no ``right`` row closer than ``distance``."""
    near = nearest_within(left, right, right_id, distance).filter(F.col("dist_m") < distance)
    return left.join(near.select(left_id), left_id, "left_anti")


# --- boxes -----------------------------------------------------------------------------

BASE_CELL = 0.01  # degrees; each level is 4 times coarser
LEVELS = 9
EDGE = 1e-9  # degrees; a box covers a cell only if it reaches past its sides by more than rounding


def _size(level: Column) -> Column:
    sizes = [BASE_CELL * 4**k for k in range(LEVELS)]
    out = F.when(level == 0, sizes[0])
    for k in range(1, LEVELS):
        out = out.when(level == k, sizes[k])
    return out


def _level() -> Column:
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    out = F.when(extent <= BASE_CELL, 0)
    for k in range(1, LEVELS):
        out = out.when(extent <= BASE_CELL * 4**k, k)
    return out.otherwise(LEVELS - 1)


def _cells(df: DataFrame, levels: Column) -> DataFrame:
    """Rows per (level, cell) that a box touches; at most four per level at or above its own."""
    lv = df.withColumn("lvl", F.explode(levels)).withColumn("__s", _size(F.col("lvl")))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.col("__s")), F.floor(F.col(hi) / F.col("__s")))
    return lv.withColumn("cx", F.explode(span("minx", "maxx"))).withColumn("cy", F.explode(span("miny", "maxy")))


def box_pairs(left: DataFrame, right: DataFrame, left_points: bool = False) -> DataFrame:
    """Overlapping (left, right) boxes, each pair once. Both sides carry minx, miny, maxx, maxy.

    A box is registered at the level where it spans at most 2 x 2 cells and looked up at that
    level and every coarser one, so big and small boxes meet without flooding either side.
    The pair is reported only in the cell of its intersection's lower left corner.
    """
    edges = ["minx", "miny", "maxx", "maxy"]
    l = left.withColumn("__lev", _level())
    r = right.withColumn("__lev", _level())
    for c in edges:
        r = r.withColumnRenamed(c, f"r_{c}")
    rr = right.withColumn("__lev", _level())
    only = F.array(F.col("__lev"))
    coarser = lambda start: F.sequence(start, F.lit(LEVELS - 1))

    def matched(lc: DataFrame, rc: DataFrame) -> DataFrame:
        rc = rc.select("lvl", "cx", "cy", *[F.col(c).alias(f"r_{c}") for c in edges], *[c for c in right.columns if c not in edges])
        lc = lc.select("lvl", "cx", "cy", "__s", *left.columns)
        j = lc.join(rc, ["lvl", "cx", "cy"])
        overlap = (
            (F.col("minx") <= F.col("r_maxx")) & (F.col("r_minx") <= F.col("maxx"))
            & (F.col("miny") <= F.col("r_maxy")) & (F.col("r_miny") <= F.col("maxy"))
        )
        here = (F.floor(F.greatest("minx", "r_minx") / F.col("__s")) == F.col("cx")) & (
            F.floor(F.greatest("miny", "r_miny") / F.col("__s")) == F.col("cy")
        )
        return j.filter(overlap & here).drop("lvl", "cx", "cy", "__s")

    out = matched(_cells(l, coarser(F.col("__lev"))), _cells(rr, only))
    if left_points:
        return out
    finer = rr.filter(F.col("__lev") < LEVELS - 1)
    return out.unionByName(matched(_cells(l, only), _cells(finer, coarser(F.col("__lev") + 1))))


def _spread(shapes: DataFrame) -> DataFrame:
    """(lvl, cx, cy, edges, __id, full): each box in the cells it touches two levels below its own, at most 17 x 17, and whether it covers them."""
    lv = shapes.withColumn("__own", F.greatest(_level() - 2, F.lit(0)))
    cells = _cells(lv, F.array("__own"))
    inside = lambda c, lo, hi: (F.col(lo) <= F.col(c) * F.col("__s") - EDGE) & ((F.col(c) + 1) * F.col("__s") + EDGE <= F.col(hi))
    return cells.withColumn("full", inside("cx", "minx", "maxx") & inside("cy", "miny", "maxy")).drop("__s", "__own")


def _at(level: int) -> list[Column]:
    s = BASE_CELL * 4**level
    return [F.floor(F.col("lon") / F.lit(s)).alias("cx"), F.floor(F.col("lat") / F.lit(s)).alias("cy")]


def first_containing(points: DataFrame, boxes: DataFrame, box_id: str) -> DataFrame:
    """Smallest id of a box that contains each point (NULL if none). Boxes include their edges.

    Boxes become cells first. Of the boxes that cover a cell only the smallest id counts, and of those that cross it only ids below that, so a point meets
    one row a level and the few boxes left in its cell, however many lie over it.
    """
    edges = ["minx", "miny", "maxx", "maxy"]
    where = ["lvl", "cx", "cy"]
    shapes = durable(boxes.groupBy(*edges).agg(F.min(box_id).alias("__id")).filter("__id IS NOT NULL"))
    spread = _spread(shapes)
    full = durable(spread.filter("full").groupBy(*where).agg(F.min("__id").alias("best")))
    part = spread.filter("NOT full").drop("full")
    levels = sorted(r.lvl for r in spread.select("lvl").distinct().collect())  # 9 at most
    for level in levels:
        over = full.filter(F.col("lvl") == level).select(F.col("cx").alias("__ox"), F.col("cy").alias("__oy"), F.col("best").alias("__over"))
        up = F.when(F.col("lvl") <= level, F.pow(F.lit(4.0), F.lit(level) - F.col("lvl")))  # null below: no such ancestor
        part = part.join(over, (F.floor(F.col("cx") / up) == F.col("__ox")) & (F.floor(F.col("cy") / up) == F.col("__oy")), "left")
        part = part.filter(F.col("__over").isNull() | (F.col("__id") < F.col("__over"))).drop("__ox", "__oy", "__over")
    part = durable(part)
    cells = full.select(*where, "best", F.lit(False).alias("open")).unionByName(part.select(*where, F.lit(None).cast(full.schema["best"].dataType).alias("best"), F.lit(True).alias("open")))
    cells = durable(cells.groupBy(*where).agg(F.min("best").alias("best"), F.max("open").alias("open")))
    marked = points.withColumns({"__best": F.lit(None).cast(full.schema["best"].dataType), "__open": F.lit(False)})
    for level in levels:
        own = cells.filter(F.col("lvl") == level).select(F.col("cx").alias("__x"), F.col("cy").alias("__y"), "best", "open")
        x, y = _at(level)
        marked = marked.join(own, (x == F.col("__x")) & (y == F.col("__y")), "left").withColumns(
            {"__best": F.least("__best", "best"), "__open": F.col("__open") | F.coalesce("open", F.lit(False))}
        ).drop("__x", "__y", "best", "open")
    done = marked.filter(~F.col("__open")).withColumnRenamed("__best", box_id).drop("__open")
    rest = marked.filter("__open").drop("__open")
    spots = rest.select("lon", "lat").distinct()
    met = None
    for level in levels:
        hit = spots.select("lon", "lat", *_at(level)).join(part.filter(F.col("lvl") == level).drop("lvl"), ["cx", "cy"])
        hit = hit.filter((F.col("lon") >= F.col("minx")) & (F.col("lon") <= F.col("maxx")) & (F.col("lat") >= F.col("miny")) & (F.col("lat") <= F.col("maxy"))).select("lon", "lat", "__id")
        met = hit if met is None else met.unionByName(hit)
    if met is None:
        return done
    rest = rest.join(met.groupBy("lon", "lat").agg(F.min("__id").alias("__id")), ["lon", "lat"], "left")
    return done.unionByName(rest.withColumn(box_id, F.least("__best", "__id")).drop("__best", "__id"))


def inside_any(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points inside some box. Which one is not asked, so a covered cell needs no box any more."""
    return first_containing(points, boxes.select("minx", "miny", "maxx", "maxy", F.lit(0).alias("__any")), "__any").filter("__any IS NOT NULL").drop("__any")


def overlap_summary(left: DataFrame, right: DataFrame, sums: dict[str, Column], mins: dict[str, Column], maxs: dict[str, Column]) -> DataFrame:
    """Per left box: number of overlapping right boxes and sums, minima, maxima over them.

    Right boxes of the same shape are combined first, so stacked copies cost one comparison.
    """
    edges = ["minx", "miny", "maxx", "maxy"]
    shapes = right.groupBy(*edges).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.min(c).alias(n) for n, c in mins.items()],
        *[F.max(c).alias(n) for n, c in maxs.items()],
    )
    pairs = box_pairs(left.select(*edges).distinct(), shapes)
    per = pairs.groupBy(*edges).agg(
        F.sum("__n").alias("n_overlaps"),
        *[F.sum(n).alias(n) for n in sums], *[F.min(n).alias(n) for n in mins], *[F.max(n).alias(n) for n in maxs],
    )
    return left.join(per, edges)
