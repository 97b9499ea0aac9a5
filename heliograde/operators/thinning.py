"""Iterative spatial jobs: spaced samples, densest-first trimming, chained clusters.

Every round works on one row per cell or on the rows still undecided, and is written to the
checkpoint folder; the driver only asks whether anything is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograde.functions.hashing import hash_order
from heliograde.operators import spatial as G
from heliograde.operators.compare import ordinal_rank
from heliograde.operators.sampling import take_per_group
from heliograde.session import durable

DIRECT = 10_000_000  # pairs of positions compared without going to smaller cells
FEW_PAIRS = 1_000_000  # ordered pairs within the widest separation that one graph for all separations may hold

DIRECT = 10_000_000  # pairs of positions compared without going to smaller cells
FEW_PAIRS = 1_000_000  # ordered pairs within the widest separation that one graph for all separations may hold


def spaced_points(points: DataFrame, ident: str, separation: float, seeds: DataFrame | None = None, seed_id: str | None = None,
                  group: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Points accepted one by one in hash order if no accepted point or seed is within ``separation``.

    Equal to the sequential rule, but in rounds. Space is cut into cells whose diagonal is the
    separation, so one cell accepts at most one point. A cell's first undecided point is
    accepted once it comes before the first undecided point of every cell in reach; points
    near an accepted one are then rejected. No pair of undecided points is ever formed.
    """
    group = group or []
    size = separation / math.sqrt(3.0)
    base = points.select("*", hash_order(F.col(ident), seed).alias("__h"), *G.ecef("lon", "lat"))
    if seeds is not None:
        blocked = G.nearest_within(points, seeds, seed_id, separation).filter(F.col("dist_m") < separation)
        base = base.join(blocked.select(ident), ident, "left_anti")
    base = base.select("*", *G._indices(size)).withColumn("cell", G._key(0)).drop("ix", "iy", "iz")
    open_ = durable(base)
    accepted = None
    reach = G._ring(2)
    first = F.struct("__h", ident)
    while True:
        leader = open_.groupBy(*group, "cell").agg(F.min(F.struct("__h", ident, "x", "y", "z")).alias("p"))
        leader = leader.select(*group, "cell", F.struct("p.__h", f"p.{ident}").alias("o"), "p.x", "p.y", "p.z", F.col(f"p.{ident}").alias("__id"))
        seen = leader.select(*group, "o", F.explode(F.array(*[F.col("cell") + F.lit(k) for k in reach if k != 0])).alias("cell"))
        earliest = seen.groupBy(*group, "cell").agg(F.min("o").alias("other"))
        new = durable(
            leader.join(earliest, [*group, "cell"], "left")
            .filter(F.col("other").isNull() | (F.col("o") < F.col("other")))
            .select(*group, "cell", F.col("__id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
        )
        shadow = new.select(*group, "ax", "ay", "az", F.explode(F.array(*[F.col("cell") + F.lit(k) for k in reach])).alias("cell"))
        d = G.chord((F.col("x"), F.col("y"), F.col("z")), (F.col("ax"), F.col("ay"), F.col("az")))
        decided = open_.select(*group, "cell", ident, "x", "y", "z").join(shadow, [*group, "cell"]).filter(d < separation).select(ident).distinct()
        open_ = durable(open_.join(decided, ident, "left_anti"))
        ids = new.select(F.col("__id").alias(ident))
        accepted = ids if accepted is None else accepted.unionByName(ids)
        if open_.isEmpty():
            break
    return points.join(accepted, ident, "left_semi")


def spaced_sample(candidates: DataFrame, ident: str, need: DataFrame, group: str, ladder: list[float],
                  seeds: DataFrame | None = None, seed_id: str | None = None, seed: int = 0) -> DataFrame:
    """Spaced sample of ``need`` points per group, relaxing the spacing only where it falls short.

    ``need`` holds (group, need). The result carries the spacing used; a group short at the
    last spacing keeps what it got.
    """
    todo, out = durable(need), None
    for i, separation in enumerate(ladder):
        pool = candidates.join(todo, group)
        got = spaced_points(pool, ident, separation, seeds, seed_id, [group], seed).withColumn("spacing_m", F.lit(float(separation)))
        got = durable(take_per_group(got, [group], F.col(ident), [ident], "need", seed))
        have = got.groupBy(group).agg(F.count(F.lit(1)).alias("__have"))
        short = durable(todo.join(have, group, "left").filter(F.coalesce("__have", F.lit(0)) < F.col("need")).drop("__have"))
        last = i == len(ladder) - 1
        final = got if last else got.join(short.select(group), group, "left_anti")
        out = final if out is None else out.unionByName(final)
        if last or short.isEmpty():
            break
        todo = short
    return out.drop("need")


def trim_densest(df: DataFrame, ident: str, group: str, keep: DataFrame, radii: tuple[float, ...] = G.RADII) -> DataFrame:
    """Rows removed to bring each group down to ``keep`` (group, keep), most crowded first.

    The rule removes the row whose nearest neighbour is closest (lowest id of the pair) again
    and again. Two rows that are each other's nearest lose their lower id whatever happens
    elsewhere, so all such pairs go in one round; removal distances only grow, so ordering
    all removals by (distance, id) gives the sequential order and the first n - keep of
    each group are the answer. Copies of a position go in closed form, so rounds do not grow with them. The default radii span the earth; a group that cannot be brought down to what it may keep (less
    than one row, or radii too short) is an error, never a short answer.
    """
    size = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    quota = durable(size.join(keep, group).select(group, F.greatest(F.col("__n") - F.col("keep"), F.lit(0)).alias("__cut")).filter("__cut > 0"))
    rows = durable(df.filter("lon IS NOT NULL AND lat IS NOT NULL").join(quota, group).select(ident, group, "lon", "lat"))
    # Of rows at one position all but the highest id go at distance 0, whatever else there is.
    alive = durable(rows.groupBy(group, "lon", "lat").agg(F.max(ident).alias(ident)))
    removed = durable(rows.join(alive.select(ident), ident, "left_anti").select(group, ident, F.lit(0.0).alias("dist_m")))
    for radius in radii:
        while not alive.isEmpty():
            nn = durable(G.nearest_other(alive, ident, radius, [group]).select(group, ident, "near_id", "dist_m"))
            back = nn.select(group, F.col(ident).alias("near_id"), F.col("near_id").alias(ident))
            gone = durable(nn.join(back, [group, ident, "near_id"]).filter(F.col(ident) < F.col("near_id")).select(group, ident, "dist_m"))
            removed = removed.unionByName(gone)
            # A group is settled once enough rows went at distances no remaining pair can undercut.
            closest = nn.join(gone.select(ident), ident, "left_anti").groupBy(group).agg(F.min("dist_m").alias("__next"))
            settled = (
                removed.join(closest, group, "left").filter(F.col("__next").isNull() | (F.col("dist_m") < F.col("__next")))
                .groupBy(group).agg(F.count(F.lit(1)).alias("__r")).join(quota, group).filter("__r >= __cut").select(group)
            )
            alive = durable(alive.join(gone.select(ident), ident, "left_anti").join(settled, group, "left_anti"))
            if gone.isEmpty():
                break
        if alive.isEmpty():
            break
    went = removed.groupBy(group).agg(F.count(F.lit(1)).alias("__r"))
    short = quota.join(went, group, "left").filter(F.coalesce("__r", F.lit(0)) < F.col("__cut"))
    if not short.isEmpty():
        raise ValueError(f"some groups cannot be trimmed to what they may keep, such as {short.first()[group]!r}")
    ordered = ordinal_rank(removed, [group], "dist_m", ident, "step").join(quota, group)
    return ordered.filter(F.col("step") <= F.col("__cut")).select(group, ident, "dist_m", "step")


def connected_components(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(node, label): label is the smallest node reachable. ``edges`` has (a, b), any direction.

    Each round a node first hands its larger neighbours, then its smaller ones, to the smallest node it knows, until every
    component is a star around its smallest node; rounds grow with the logarithm of the longest chain. The hub of a star is
    only ever the probe side of an inner join, which can be split. With ``by`` several graphs on the same nodes are solved together.
    """
    by = by or []
    links = durable(edges.filter("a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda t: tuple(t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*by, "a", "b"))).first())
    before = state(links)
    while True:
        both = links.unionByName(links.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        known = both.groupBy(*by, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter("b > a").join(known, [*by, "a"]).select(*by, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        known = large.groupBy(*by, "a").agg(F.min("b").alias("m"))
        pair = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        links = durable(large.join(known, [*by, "a"]).select(*by, F.inline(pair)).filter("a <> b").distinct())
        after = state(links)
        if after == before:
            root = links.select(*by, F.col("a").alias("node"), F.col("b").alias("__root"))
            return nodes.join(root, [*by, "node"], "left").select(*by, "node", F.coalesce("__root", "node").alias("label"))
        before = after


def _levels(separation: float) -> tuple[float, int]:
    """(fine, up): cells of size ``fine`` shifted ``up`` bits are cells whose diagonal is the separation."""
    size = separation / math.sqrt(3.0)
    up = max(0, math.floor(math.log2(size / G.FINEST_CELL)))
    return size / 2**up, up


def _boxes(keyed: DataFrame, shift: int, *more) -> DataFrame:
    """(cell, cnt, lo, hi, more...): positions in each cell and their tight bounds."""
    bound = lambda f: F.struct(*[f(c).alias(c) for c in "xyz"])
    return keyed.groupBy(G._key(shift).alias("cell")).agg(F.count(F.lit(1)).alias("cnt"), bound(F.min).alias("lo"), bound(F.max).alias("hi"), *more)


def _gaps() -> tuple[Column, Column]:
    """Smallest and largest possible distance between the occupants of two cells."""
    low, high = F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        ahead, behind = F.col(f"a.lo.{c}") - F.col(f"b.hi.{c}"), F.col(f"b.lo.{c}") - F.col(f"a.hi.{c}")
        near, far = F.greatest(ahead, behind, F.lit(0.0)), F.greatest(-ahead, -behind)
        low, high = low + near * near, high + far * far
    return F.sqrt(low), F.sqrt(high)


def _relabelled(pairs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, new) of the labels in ``links``, and the ``pairs`` (la, lb, ...) that still join two of them."""
    ends = links.select(F.col("la").alias("node")).union(links.select("lb")).distinct()
    to = durable(connected_components(ends, links.select(F.col("la").alias("a"), F.col("lb").alias("b"))).withColumnRenamed("label", "new"))
    for c in ("la", "lb"):
        pairs = pairs.join(to.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
    return to.withColumnRenamed("node", "label"), pairs.filter("la <> lb")


def _merged(of: DataFrame, to: DataFrame) -> DataFrame:
    return durable(of.join(to, "label", "left").select("top", F.coalesce("new", "label").alias("label")))


def chained_cells(spots: DataFrame, separation: float) -> DataFrame:
    """(top, label) stored: for each cell whose diagonal is the separation the smallest ``near_id`` that its positions reach by steps no longer.

    ``spots`` has near_id, x, y, z, one row per position. A cell is linked in itself, and cells of half its size that touch
    are linked, so crowded areas are joined on counts of cells alone. Only pairs of cells of different clusters are looked into, on both
    sides at once: bounds settle a pair or rule it out, the rest goes on to smaller cells, and to positions once these are few.
    """
    fine, up = _levels(separation)
    keyed = spots.select("near_id", "x", "y", "z", *G._indices(fine))
    half = keyed.groupBy(G._key(max(up - 1, 0)).alias("cell"), G._key(up).alias("top")).agg(F.min("near_id").alias("first"))
    half = durable(half)
    of = durable(half.groupBy("top").agg(F.min("first").alias("label")))
    if up:
        own = half.join(of, "top")
        touching = own.select(F.col("label").alias("a"), F.explode(F.array(*[F.col("cell") + F.lit(o) for o in G._ring(1, half=True)])).alias("cell"))
        touching = touching.join(own.select("cell", F.col("label").alias("b")), "cell").filter("a <> b").select("a", "b")
        label = connected_components(of.select(F.col("label").alias("node")), touching)
        of = _merged(of, label.select(F.col("node").alias("label"), F.col("label").alias("new")))
    if of.select("label").distinct().limit(2).count() < 2:
        return of
    around = of.select(F.col("top").alias("ca"), F.col("label").alias("la"), F.explode(F.array(*[F.col("top") + F.lit(o) for o in G._ring(2, half=True)])).alias("cb"))
    pairs = around.join(of.select(F.col("top").alias("cb"), F.col("label").alias("lb")), "cb").filter("la <> lb")
    shift, low_high = up, _gaps()
    while True:
        boxes = _boxes(keyed, shift)
        wide = pairs.alias("p").join(boxes.alias("a"), F.col("ca") == F.col("a.cell")).join(boxes.alias("b"), F.col("cb") == F.col("b.cell"))
        wide = wide.filter(low_high[0] <= separation + G.SLACK)
        pairs = durable(wide.select("ca", "cb", "la", "lb", (F.col("a.cnt") * F.col("b.cnt")).alias("work"), (low_high[1] <= separation).alias("sure")))
        work, sure = pairs.agg(F.sum("work"), F.count_if("sure")).first()
        if work is not None and work > DIRECT and sure:
            to, pairs = _relabelled(pairs, pairs.filter("sure"))
            of, pairs = _merged(of, to), durable(pairs)
            work = pairs.agg(F.sum("work")).first()[0]
        if work is None:
            return of
        if work <= DIRECT or shift == 0:
            break
        down = max(shift - 2, 0)
        parts = keyed.select(G._key(shift).alias("parent"), G._key(down).alias("cell")).distinct()
        for c in ("a", "b"):
            pairs = pairs.join(parts.select(F.col("parent").alias(f"c{c}"), F.col("cell").alias(f"n{c}")), f"c{c}")
        pairs, shift = pairs.select(F.col("na").alias("ca"), F.col("nb").alias("cb"), "la", "lb"), down
    points = keyed.select(G._key(shift).alias("cell"), "x", "y", "z")
    met = pairs.join(points.alias("a"), F.col("ca") == F.col("a.cell")).join(points.alias("b"), F.col("cb") == F.col("b.cell"))
    d = F.round(G.chord(tuple(F.col(f"a.{c}") for c in "xyz"), tuple(F.col(f"b.{c}") for c in "xyz")), 3)
    links = durable(met.filter(d <= separation).select("la", "lb").distinct())
    return of if links.isEmpty() else _merged(of, _relabelled(pairs, links)[0])


def _levels(separation: float) -> tuple[float, int]:
    """(fine, up): cells of size ``fine`` shifted ``up`` bits are cells whose diagonal is the separation."""
    size = separation / math.sqrt(3.0)
    up = max(0, math.floor(math.log2(size / G.FINEST_CELL)))
    return size / 2**up, up


def _boxes(keyed: DataFrame, shift: int, *more) -> DataFrame:
    """(cell, cnt, lo, hi, more...): positions in each cell and their tight bounds."""
    bound = lambda f: F.struct(*[f(c).alias(c) for c in "xyz"])
    return keyed.groupBy(G._key(shift).alias("cell")).agg(F.count(F.lit(1)).alias("cnt"), bound(F.min).alias("lo"), bound(F.max).alias("hi"), *more)


def _gaps() -> tuple[Column, Column]:
    """Smallest and largest possible distance between the occupants of two cells."""
    low, high = F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        ahead, behind = F.col(f"a.lo.{c}") - F.col(f"b.hi.{c}"), F.col(f"b.lo.{c}") - F.col(f"a.hi.{c}")
        near, far = F.greatest(ahead, behind, F.lit(0.0)), F.greatest(-ahead, -behind)
        low, high = low + near * near, high + far * far
    return F.sqrt(low), F.sqrt(high)


def _relabelled(pairs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, new) of the labels in ``links``, and the ``pairs`` (la, lb, ...) that still join two of them."""
    ends = links.select(F.col("la").alias("node")).union(links.select("lb")).distinct()
    to = durable(connected_components(ends, links.select(F.col("la").alias("a"), F.col("lb").alias("b"))).withColumnRenamed("label", "new"))
    for c in ("la", "lb"):
        pairs = pairs.join(to.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
    return to.withColumnRenamed("node", "label"), pairs.filter("la <> lb")


def _merged(of: DataFrame, to: DataFrame) -> DataFrame:
    return durable(of.join(to, "label", "left").select("top", F.coalesce("new", "label").alias("label")))


def chained_cells(spots: DataFrame, separation: float) -> DataFrame:
    """(top, label) stored: for each cell whose diagonal is the separation the smallest ``near_id`` that its positions reach by steps no longer.

    ``spots`` has near_id, x, y, z, one row per position. A cell is linked in itself, and cells of half its size that touch
    are linked, so crowded areas are joined on counts of cells alone. Only pairs of cells of different clusters are looked into, on both
    sides at once: bounds settle a pair or rule it out, the rest goes on to smaller cells, and to positions once these are few.
    """
    fine, up = _levels(separation)
    keyed = spots.select("near_id", "x", "y", "z", *G._indices(fine))
    half = keyed.groupBy(G._key(max(up - 1, 0)).alias("cell"), G._key(up).alias("top")).agg(F.min("near_id").alias("first"))
    half = durable(half)
    of = durable(half.groupBy("top").agg(F.min("first").alias("label")))
    if up:
        own = half.join(of, "top")
        touching = own.select(F.col("label").alias("a"), F.explode(F.array(*[F.col("cell") + F.lit(o) for o in G._ring(1, half=True)])).alias("cell"))
        touching = touching.join(own.select("cell", F.col("label").alias("b")), "cell").filter("a <> b").select("a", "b")
        label = connected_components(of.select(F.col("label").alias("node")), touching)
        of = _merged(of, label.select(F.col("node").alias("label"), F.col("label").alias("new")))
    if of.select("label").distinct().limit(2).count() < 2:
        return of
    around = of.select(F.col("top").alias("ca"), F.col("label").alias("la"), F.explode(F.array(*[F.col("top") + F.lit(o) for o in G._ring(2, half=True)])).alias("cb"))
    pairs = around.join(of.select(F.col("top").alias("cb"), F.col("label").alias("lb")), "cb").filter("la <> lb")
    shift, low_high = up, _gaps()
    while True:
        boxes = _boxes(keyed, shift)
        wide = pairs.alias("p").join(boxes.alias("a"), F.col("ca") == F.col("a.cell")).join(boxes.alias("b"), F.col("cb") == F.col("b.cell"))
        wide = wide.filter(low_high[0] <= separation + G.SLACK)
        pairs = durable(wide.select("ca", "cb", "la", "lb", (F.col("a.cnt") * F.col("b.cnt")).alias("work"), (low_high[1] <= separation).alias("sure")))
        work, sure = pairs.agg(F.sum("work"), F.count_if("sure")).first()
        if work is not None and work > DIRECT and sure:
            to, pairs = _relabelled(pairs, pairs.filter("sure"))
            of, pairs = _merged(of, to), durable(pairs)
            work = pairs.agg(F.sum("work")).first()[0]
        if work is None:
            return of
        if work <= DIRECT or shift == 0:
            break
        down = max(shift - 2, 0)
        parts = keyed.select(G._key(shift).alias("parent"), G._key(down).alias("cell")).distinct()
        for c in ("a", "b"):
            pairs = pairs.join(parts.select(F.col("parent").alias(f"c{c}"), F.col("cell").alias(f"n{c}")), f"c{c}")
        pairs, shift = pairs.select(F.col("na").alias("ca"), F.col("nb").alias("cb"), "la", "lb"), down
    points = keyed.select(G._key(shift).alias("cell"), "x", "y", "z")
    met = pairs.join(points.alias("a"), F.col("ca") == F.col("a.cell")).join(points.alias("b"), F.col("cb") == F.col("b.cell"))
    d = F.round(G.chord(tuple(F.col(f"a.{c}") for c in "xyz"), tuple(F.col(f"b.{c}") for c in "xyz")), 3)
    links = durable(met.filter(d <= separation).select("la", "lb").distinct())
    return of if links.isEmpty() else _merged(of, _relabelled(pairs, links)[0])


def chain_clusters(df: DataFrame, ident: str, separation: float) -> DataFrame:
    """(ident, cluster_id): rows linked by steps of at most ``separation`` metres.

    The cluster id is the smallest row id in it. Rows without a position have no cluster.
    """
    fine, up = _levels(separation)
    spots = durable(G.positions(df.filter("lon IS NOT NULL AND lat IS NOT NULL"), [], ident).select("near_id", "x", "y", "z"))
    of = chained_cells(spots, separation)
    rows = df.select(ident, *G.ecef("lon", "lat")).select(ident, *G._indices(fine)).select(ident, G._key(up).alias("top"))
    return rows.join(of, "top").select(ident, F.col("label").alias("cluster_id"))


def separation_sweep(df: DataFrame, ident: str, separations: list[float]) -> DataFrame:
    """(separation, clusters, largest): clusters of ``chain_clusters`` and rows of the largest, for every separation.

    Separations are taken in rising order, each a run over the cells of the distinct positions; once all is one cluster the
    wider ones have the same. Where positions are so few that their pairs within the widest fit a small table, one graph of these serves all.
    """
    there = df.filter("lon IS NOT NULL AND lat IS NOT NULL").groupBy("lon", "lat").agg(F.min(ident).alias("near_id"), F.count(F.lit(1)).alias("__m"))
    spots = durable(there.select("near_id", "__m", *G.ecef("lon", "lat")))
    rising = sorted(separations)
    size = rising[-1] / math.sqrt(3.0)
    keyed = spots.select("*", *G._indices(size)).withColumn("cell", G._key(0))
    cells = durable(keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("cnt")))
    ring = F.array(*[F.lit(o) for o in G._ring(2)])
    met = cells.select(F.explode(F.transform(ring, lambda o: F.col("cell") + o)).alias("cell"), F.col("cnt").alias("n")).join(cells, "cell")
    if (met.agg(F.sum(F.col("n") * F.col("cnt"))).first()[0] or 0) <= FEW_PAIRS:
        return _sweep_pairs(keyed, rising, ring)
    out = None
    for k, s in enumerate(rising):
        fine, up = _levels(s)
        of = chained_cells(spots, s)
        rows = spots.select("__m", *G._indices(fine)).groupBy(G._key(up).alias("top")).agg(F.sum("__m").alias("__m"))
        sums = rows.join(of, "top").groupBy("label").agg(F.sum("__m").alias("__m"))
        row = sums.agg(F.count(F.lit(1)).alias("clusters"), F.max("__m").alias("largest")).first()  # two numbers
        same = rising[k:] if row.clusters <= 1 else [s]
        got = df.sparkSession.createDataFrame([(float(t), row.clusters, row.largest) for t in same], "separation double, clusters long, largest long")
        out = got if out is None else out.unionByName(got)
        if row.clusters <= 1:
            break
    return out


def _sweep_pairs(keyed: DataFrame, separations: list[float], ring: Column) -> DataFrame:
    """``separation_sweep`` past the pairs of positions in neighbouring cells."""
    left = keyed.select(F.col("near_id").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], F.explode(F.transform(ring, lambda o: F.col("cell") + o)).alias("cell"))
    d = F.round(G.chord(tuple(F.col(f"a{c}") for c in "xyz"), tuple(F.col(c) for c in "xyz")), 3)
    near = left.join(keyed, "cell").filter(F.col("a") < F.col("near_id")).select("a", F.col("near_id").alias("b"), d.alias("dist_m")).filter(F.col("dist_m") <= separations[-1])
    every = F.explode(F.array(*[F.lit(float(s)) for s in separations])).alias("separation")
    edges = near.select("*", every).filter(F.col("dist_m") <= F.col("separation"))
    nodes = keyed.select(F.col("near_id").alias("node"), "__m", every)
    label = connected_components(nodes.drop("__m"), edges, ["separation"])
    size = label.join(keyed.select(F.col("near_id").alias("node"), "__m"), "node").groupBy("separation", "label").agg(F.sum("__m").alias("__m"))
    return size.groupBy("separation").agg(F.count(F.lit(1)).alias("clusters"), F.max("__m").alias("largest"))
