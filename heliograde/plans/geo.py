"""Queries: distance, containment, thinning and clustering of sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograde.functions import scalars as X
from heliograde.functions.hashing import hash_order_sql as H, uniform, uniform_sql as U
from heliograde.operators import candidates as C
from heliograde.operators import ranking as R
from heliograde.operators import spatial as G
from heliograde.operators import thinning as TH
from heliograde.plans.registry import query
from heliograde.sources import tables as T

DS = ("dense_sites", "detectors")


def xyz(view: str, keep: str, name: str) -> str:
    x, y, z = G.ecef_sql("lon", "lat")
    return f"{name} AS (SELECT {keep}, lon, lat, {x} AS x, {y} AS y, {z} AS z FROM {view})"


DIST = "round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 3)"
D_TO_S = f"""{xyz('detectors', 'det_id, country, capacity_mw', 'a')}, {xyz('dense_sites', 'dense_id, nation, year', 'b')},
    nn AS (SELECT a.det_id, a.country, min(({DIST}, b.dense_id)) AS m FROM a, b GROUP BY ALL), n AS (SELECT det_id, country, m[1] AS dist_m, m[2] AS near_id FROM nn)"""

# Boxes: sites with a half size between 0.5 and 8 km, a few copies of one shape.
BOX = """bx AS (SELECT dense_id, year, lon - hx AS minx, lat - hy AS miny, lon + hx AS maxx, lat + hy AS maxy FROM (SELECT *, (500 + dense_id * 97 % 7500) / (cos(radians(lat)) * 111320) AS hx, (500 + dense_id * 97 % 7500) / 111320.0::DOUBLE AS hy FROM dense_sites))"""


def boxes(spark, sf):
    half = (F.lit(500) + F.col("dense_id") * 97 % 7500).cast("double")
    return T.dense_sites(spark, sf).select("dense_id", "year", X.pad_box(F.col("lon"), F.col("lat"), half).alias("b")).select("dense_id", "year", "b.*")


@query("j5_within_first_match", f"WITH {BOX} SELECT det_id, coalesce((SELECT min(dense_id) FROM bx WHERE lon BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy), -1) AS dense_id FROM detectors", DS)
def within(spark, sf):
    return G.first_containing(T.detectors(spark, sf).select("det_id", "lon", "lat"), boxes(spark, sf), "dense_id").select("det_id", F.coalesce("dense_id", F.lit(-1)).alias("dense_id"))


TZBOX = """tz AS (SELECT det_id, capacity_mw, year(try_cast(substring(constructed_after, 1, 10) AS DATE)) AS ya, year(try_cast(substring(constructed_before, 1, 10) AS DATE)) AS yb,
    lon - hx AS minx, lat - hy AS miny, lon + hx AS maxx, lat + hy AS maxy FROM (SELECT *, (100 + det_id % 900) / (cos(radians(lat)) * 111320) AS hx, (100 + det_id % 900) / 111320.0::DOUBLE AS hy FROM detectors)),
    ov AS (SELECT bx.dense_id, bx.year, count(*) AS n_overlaps, sum(capacity_mw) AS cap_mw, min(ya) AS min_after, max(yb) AS max_before FROM bx JOIN tz ON bx.minx <= tz.maxx AND tz.minx <= bx.maxx AND bx.miny <= tz.maxy AND tz.miny <= bx.maxy GROUP BY ALL)"""


def overlaps(spark, sf):
    half = (F.lit(100) + F.col("det_id") % 900).cast("double")
    tz = T.detectors(spark, sf).select(
        "capacity_mw", X.date_year("constructed_after").alias("ya"), X.date_year("constructed_before").alias("yb"), X.pad_box(F.col("lon"), F.col("lat"), half).alias("b")
    ).select("capacity_mw", "ya", "yb", "b.*")
    return G.overlap_summary(boxes(spark, sf), tz, {"cap_mw": F.col("capacity_mw")}, {"min_after": F.col("ya")}, {"max_before": F.col("yb")})


@query("j6_overlap_summary", f"WITH {BOX}, {TZBOX} SELECT dense_id, n_overlaps, round(cap_mw, 4) AS cap_mw, coalesce(min_after, -1)::INTEGER AS min_after, coalesce(max_before, -1)::INTEGER AS max_before FROM ov", DS)
def overlap_summary(spark, sf):
    return overlaps(spark, sf).select("dense_id", "n_overlaps", F.round("cap_mw", 4).alias("cap_mw"), F.coalesce("min_after", F.lit(-1)).alias("min_after"), F.coalesce("max_before", F.lit(-1)).alias("max_before"))


@query("j6_overlap_worst_case", f"WITH {BOX}, {TZBOX} SELECT count(*) AS boxes_hit, count(*) FILTER (WHERE n_overlaps > 1) AS multi, max(n_overlaps) AS worst FROM ov", DS)
def worst(spark, sf):
    return overlaps(spark, sf).agg(F.count(F.lit(1)).alias("boxes_hit"), F.count_if(F.col("n_overlaps") > 1).alias("multi"), F.max("n_overlaps").alias("worst"))


CLASS = "CASE WHEN max_before <= year THEN 'before' WHEN min_after > year THEN 'after' ELSE 'straddle' END"


@query("j12_temporal_class", f"WITH {BOX}, {TZBOX} SELECT {CLASS} AS timing, count(*) AS n, sum(n_overlaps)::BIGINT AS overlaps FROM ov GROUP BY 1", DS)
def temporal_class(spark, sf):
    c = F.when(F.col("max_before") <= F.col("year"), "before").when(F.col("min_after") > F.col("year"), "after").otherwise("straddle")
    return overlaps(spark, sf).groupBy(c.alias("timing")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_overlaps").alias("overlaps"))


LABEL = f"""WITH {BOX}, px AS (SELECT det_id AS px_id, lon, lat, (2017 + det_id % 5)::INTEGER AS embed_year FROM detectors),
    h AS (SELECT px_id, max(year) AS last_year FROM px JOIN bx ON lon BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy GROUP BY px_id) SELECT px_id, CASE WHEN last_year > embed_year THEN 1 ELSE 0 END AS label FROM px LEFT JOIN h USING (px_id)"""


def labelled(spark, sf):
    px = T.detectors(spark, sf).select(F.col("det_id").alias("px_id"), "lon", "lat", (F.lit(2017) + F.col("det_id") % 5).cast("int").alias("embed_year"))
    return C.label_pixels(px, boxes(spark, sf), "px_id", "embed_year", "year")


@query("p9_future_label", LABEL, DS)
def future_label(spark, sf):
    return labelled(spark, sf).select("px_id", "label")


@query("j7_contains_with_time", f"SELECT label, count(*) AS n, min(px_id) AS first_px FROM ({T.sql(LABEL, *DS)}) GROUP BY label")
def contains_with_time(spark, sf):
    return labelled(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("px_id").alias("first_px"))


@query("j8_nearest", f"WITH {D_TO_S} SELECT det_id, near_id, dist_m FROM n", DS)
def nearest(spark, sf):
    return G.nearest(T.detectors(spark, sf).select("det_id", "lon", "lat"), T.dense_sites(spark, sf), "dense_id", "det_id").select("det_id", "near_id", "dist_m")


@query("j9_nearest_within", f"WITH {D_TO_S} SELECT det_id, coalesce(CASE WHEN dist_m < 5000 THEN near_id END, -1) AS near_id FROM n", DS)
def nearest_within(spark, sf):
    d = T.detectors(spark, sf).select("det_id", "lon", "lat")
    hit = G.nearest_within(d, T.dense_sites(spark, sf), "dense_id", 5000.0).filter("dist_m < 5000")
    return d.join(hit.select("det_id", "near_id"), "det_id", "left").select("det_id", F.coalesce("near_id", F.lit(-1)).alias("near_id"))


@query("j10_exclusion", f"WITH {D_TO_S} SELECT det_id FROM n WHERE dist_m >= 5000", DS)
def exclusion(spark, sf):
    return G.clear_of(T.detectors(spark, sf), T.dense_sites(spark, sf), "det_id", "dense_id", 5000.0).select("det_id")


@query("j11_distance_audit", f"""WITH {D_TO_S}, e AS (SELECT dist_m, dist_m - 1810.193 AS edge_m FROM n) SELECT count(*) AS n, round(min(dist_m), 3) AS min_m, round(quantile_cont(dist_m, 0.01), 3) AS p1, round(quantile_cont(dist_m, 0.5), 3) AS median,
    count(*) FILTER (WHERE dist_m < 5000) AS centre_within_5km, count(*) FILTER (WHERE edge_m < 5000) AS edge_within_5km, count(*) FILTER (WHERE edge_m <= 5000) AS edge_upto_5km, count(*) FILTER (WHERE edge_m < 0) AS inside FROM e""", DS)
def audit(spark, sf):
    nn = G.nearest(T.detectors(spark, sf).select("det_id", "lon", "lat"), T.dense_sites(spark, sf), "dense_id", "det_id")
    return C.distance_audit(nn, 1810.193, 5000.0)


@query("j11_contamination_by_country", f"WITH {D_TO_S} SELECT country, count(*) AS chips, count(*) FILTER (WHERE dist_m <= 5000) AS within5, round(100 * count(*) FILTER (WHERE dist_m <= 5000) / count(*), 1) AS pct5 FROM n GROUP BY country", DS)
def contamination(spark, sf):
    d = T.detectors(spark, sf).select("det_id", "country", "lon", "lat")
    near = G.nearest_within(d, T.dense_sites(spark, sf), "dense_id", 5000.0).select("det_id", F.lit(1).alias("hit"))
    j = d.join(near, "det_id", "left")
    return j.groupBy("country").agg(F.count(F.lit(1)).alias("chips"), F.count("hit").alias("within5"), F.round(100 * F.count("hit") / F.count(F.lit(1)), 1).alias("pct5"))


@query("j15_closest_neighbour", f"""WITH {xyz('detectors', 'det_id, country', 'a')}, b AS (SELECT * FROM a), nn AS (SELECT a.det_id, a.country, min(({DIST}, b.det_id)) AS m FROM a JOIN b ON a.country = b.country AND a.det_id <> b.det_id GROUP BY ALL)
    SELECT det_id, m[2] AS near_id, m[1] AS dist_m FROM nn""", ("detectors",))
def closest_neighbour(spark, sf):
    found, _ = G.nearest_other_any(T.detectors(spark, sf).select("det_id", "country", "lon", "lat"), "det_id", ["country"])
    return found.select("det_id", "near_id", "dist_m")


# --- generated points ------------------------------------------------------------------------
SPHERE = f"""SELECT o_orderkey AS point_id, round({U('o_orderkey', 1)} * 360 - 180, 6) AS lon, round(degrees(asin(sin(radians(-56)) + {U('o_orderkey * 3 + 1', 2)} * (sin(radians(72)) - sin(radians(-56))))), 6) AS lat FROM orders"""


@query("sm12_sphere_points", SPHERE)
def sphere_points(spark, sf):
    o = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("point_id"))
    return C.sphere_points(o, "point_id", -56.0, 72.0).select("point_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


CAND = f"""cand AS (SELECT o_orderkey AS point_id, 10 + {U('o_orderkey', 5)} * 2 AS lon, 40 + {U('o_orderkey * 3 + 1', 6)} * 2 AS lat FROM orders)"""


def box_candidates(spark, sf):
    o = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("point_id"))
    return C.box_points(o, "point_id", 10.0, 40.0, 12.0, 42.0, 5, 6)


@query("sm12_points_in_region", f"WITH {CAND}, {BOX} SELECT point_id FROM cand WHERE EXISTS (SELECT 1 FROM bx WHERE lon BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy)", ("dense_sites",))
def points_in_region(spark, sf):
    return G.inside_any(box_candidates(spark, sf), boxes(spark, sf)).select("point_id")


@query("sm13_candidate_pool", f"""WITH {CAND}, {xyz('cand', 'point_id', 'a')}, {xyz('dense_sites', 'dense_id', 'b')}, n AS (SELECT point_id, min({DIST}) AS d FROM a, b GROUP BY point_id) SELECT point_id FROM n WHERE d >= 5000 AND d <= 20000""", ("dense_sites",))
def candidate_pool(spark, sf):
    return C.candidate_pool(box_candidates(spark, sf), "point_id", T.dense_sites(spark, sf), "dense_id", 5000.0, 20000.0).select("point_id")


SHIFT = f"""off AS (SELECT row_number() OVER (ORDER BY d, a) AS step, d, a FROM (SELECT unnest([8000, 15000, 25000]) AS d), (SELECT unnest(range(0, 360, 45)) AS a)),
    sh AS (SELECT dense_id, nation, step, lon + d * cos(radians(a)) / (cos(radians(lat)) * 111320) AS lon, lat + d * sin(radians(a)) / 111320 AS lat FROM dense_sites, off),
    {xyz('sh', 'dense_id, nation, step', 'a')}, {xyz('dense_sites', 'dense_id', 'b')}, safe AS (SELECT a.dense_id, a.nation, a.step FROM a, b GROUP BY ALL HAVING min({DIST}) >= 7500)"""


@query("sm14_compass_shift", f"WITH {SHIFT} SELECT nation, dense_id, step FROM safe QUALIFY row_number() OVER (PARTITION BY nation ORDER BY dense_id, step) = 1", ("dense_sites",))
def compass(spark, sf):
    return C.compass_shift(T.dense_sites(spark, sf), "dense_id", "nation", 7500.0).select("nation", "dense_id", F.col("step").cast("bigint").alias("step"))


# --- iterative jobs ----------------------------------------------------------------------------
@query("sm7_spaced_sample")
def spaced(spark, sf):
    """Sequential acceptance has no SQL form; tests compare it with the loop."""
    d = T.detectors(spark, sf).select("det_id", "country", "lon", "lat")
    need = d.groupBy("country").agg(F.ceil(F.count(F.lit(1)) / 2).cast("int").alias("need"))
    return TH.spaced_sample(d, "det_id", need, "country", [12000.0, 9000.0, 6000.0], T.dense_sites(spark, sf), "dense_id")


@query("sm8_trim_densest")
def trim(spark, sf):
    """Repeated removal has no SQL form; tests compare it with the loop."""
    d = T.detectors(spark, sf).select("det_id", "country", "lon", "lat")
    keep = d.groupBy("country").agg(F.floor(F.count(F.lit(1)) * 0.95).alias("keep"))
    return TH.trim_densest(d, "det_id", "country", keep)


CC = f"""WITH RECURSIVE scattered AS ({T.SQL['scattered']}), {xyz('scattered', 'site_id', 'a')}, b AS (SELECT * FROM a), e AS (SELECT a.site_id AS u, b.site_id AS v FROM a, b WHERE {DIST} <= 3000),
    reach(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u), cc AS (SELECT u AS site_id, min(v) AS cluster_id FROM reach GROUP BY u)"""


@query("sm15_chain_clusters", CC + " SELECT site_id, cluster_id FROM cc")
def clusters(spark, sf):
    return TH.chain_clusters(T.scattered(spark, sf), "site_id", 3000.0)


@query("sm15_cluster_envelopes", CC + """ SELECT cluster_id, count(*) AS num_sites, round(min(lon) - 1500 / (cos(radians((min(lat) + max(lat)) / 2)) * 111320), 6) AS minx, round(min(lat) - 1500 / 111320.0::DOUBLE, 6) AS miny,
    round(max(lon) + 1500 / (cos(radians((min(lat) + max(lat)) / 2)) * 111320), 6) AS maxx, round(max(lat) + 1500 / 111320.0::DOUBLE, 6) AS maxy FROM cc JOIN scattered USING (site_id) GROUP BY cluster_id""")
def envelopes(spark, sf):
    d = T.scattered(spark, sf)
    return C.cluster_envelopes(d.join(TH.chain_clusters(d, "site_id", 3000.0), "site_id"), "cluster_id", 1500.0)


SWEEP = f"""WITH RECURSIVE scattered AS ({T.SQL['scattered']}), {xyz('scattered', 'site_id', 'a')}, b AS (SELECT * FROM a), near AS (SELECT a.site_id AS u, b.site_id AS v, {DIST} AS d FROM a, b WHERE a.site_id <> b.site_id),
    sep AS (SELECT unnest(range(1, 21)) AS s), e AS (SELECT s, u, v FROM near JOIN sep ON d <= s * 1000),
    cc(s, u, l) USING KEY (s, u) AS (SELECT s, site_id, site_id FROM a, sep UNION
      SELECT r.s, r.u, min(w.l) FROM cc w JOIN e ON e.s = w.s AND e.v = w.u JOIN recurring.cc r ON r.s = e.s AND r.u = e.u WHERE w.l < r.l GROUP BY r.s, r.u)
    SELECT s::INTEGER AS separation_km, count(*) AS clusters, max(n)::BIGINT AS largest FROM (SELECT s, l, count(*) AS n FROM cc GROUP BY s, l) GROUP BY s"""


@query("sm15_separation_sweep", SWEEP)
def sweep(spark, sf):
    """Clusters for separations of 1 to 20 km, read off one spanning forest."""
    got = TH.separation_sweep(T.scattered(spark, sf), "site_id", [km * 1000.0 for km in range(1, 21)])
    return got.select((F.col("separation") / 1000).cast("int").alias("separation_km"), "clusters", "largest")


@query("sm16_land_grid", f"""WITH {BOX}, g AS (SELECT floor(minx / 0.05)::BIGINT AS x0, floor(maxx / 0.05)::BIGINT AS x1, floor(miny / 0.05)::BIGINT AS y0, floor(maxy / 0.05)::BIGINT AS y1 FROM bx),
    c AS (SELECT DISTINCT cx, cy FROM (SELECT unnest(range(x0, x1 + 1)) AS cx, y0, y1 FROM g), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS cy))
    SELECT cx, cy, (least(greatest(floor((cx * 0.05::DOUBLE + 180) / 6)::INTEGER + 1, 1), 60) + CASE WHEN cy >= 0 THEN 32600 ELSE 32700 END)::INTEGER AS epsg FROM c""", ("dense_sites",))
def land_grid(spark, sf):
    return C.covering_cells(boxes(spark, sf), 0.05)


@query("r5_distance_grid", f"""WITH {BOX}, g AS (SELECT DISTINCT floor(lon / 0.05)::BIGINT AS cx, floor(lat / 0.05)::BIGINT AS cy FROM detectors), ctr AS (SELECT cx, cy, (cx + 0.5::DOUBLE) * 0.05::DOUBLE AS lon, (cy + 0.5::DOUBLE) * 0.05::DOUBLE AS lat FROM g),
    {xyz('ctr', 'cx, cy', 'a')}, {xyz('dense_sites', 'dense_id', 'b')} SELECT cx, cy, min({DIST}) AS dist_m FROM a, b GROUP BY cx, cy""", DS)
def distance_grid(spark, sf):
    cells = T.detectors(spark, sf).select(F.floor(F.col("lon") / 0.05).cast("bigint").alias("cx"), F.floor(F.col("lat") / 0.05).cast("bigint").alias("cy")).distinct()
    centres = cells.select("cx", "cy", ((F.col("cx") + 0.5) * 0.05).alias("lon"), ((F.col("cy") + 0.5) * 0.05).alias("lat"), F.concat_ws("_", "cx", "cy").alias("cell_id"))
    return G.nearest(centres, T.dense_sites(spark, sf), "dense_id", "cell_id").select("cx", "cy", "dist_m")
