"""Queries: rasters as tables, embeddings, moments, MCDA."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from heliograde.functions import vectors as V
from heliograde.operators import evaluate as E
from heliograde.operators import grids as GR
from heliograde.operators import mcda as M
from heliograde.operators import moments as MO
from heliograde.operators import ranking as R
from heliograde.plans.evaluation import auc_sql, report_sql
from heliograde.plans.registry import query
from heliograde.plans.tabular import SUIT
from heliograde.sources import tables as T

r6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)
KEYLIST = "l_orderkey, l_partkey, l_suppkey, l_linenumber"

CELLED = "cells AS (SELECT *, round((42.0::DOUBLE - lat) / 0.05::DOUBLE)::BIGINT AS ri, round((lon - 10.0::DOUBLE) / 0.05::DOUBLE)::BIGINT AS ci FROM detectors)"


@query("r1_points_to_cells", f"WITH {CELLED} SELECT ri, ci, arg_max(capacity_mw, det_id) AS capacity_mw FROM cells GROUP BY ri, ci", ("detectors",))
def points_to_cells(spark, sf):
    return GR.rasterise(T.detectors(spark, sf), "capacity_mw", "det_id", 0.05, 10.0, 42.0)


@query("r2_sample_grid", f"WITH {CELLED}, g AS (SELECT ri, ci, arg_max(capacity_mw, det_id) AS v FROM cells GROUP BY ri, ci), s AS (SELECT dense_id, round((42.0::DOUBLE - lat) / 0.05::DOUBLE)::BIGINT AS ri, round((lon - 10.0::DOUBLE) / 0.05::DOUBLE)::BIGINT AS ci FROM dense_sites) SELECT dense_id, v AS capacity_mw FROM s LEFT JOIN g USING (ri, ci)", ("detectors", "dense_sites"))
def sample_grid(spark, sf):
    g = GR.rasterise(T.detectors(spark, sf), "capacity_mw", "det_id", 0.05, 10.0, 42.0)
    return GR.sample_grid(T.dense_sites(spark, sf), g, "capacity_mw", 0.05, 10.0, 42.0).select("dense_id", "capacity_mw")


@query("r3_block_mean", "SELECT ri // 3 AS ri, ci // 3 AS ci, round(avg(value), 6) AS value FROM grid GROUP BY 1, 2 HAVING count(*) = 9", ("grid",))
def block_mean(spark, sf):
    return GR.block_mean(T.grid(spark, sf), ["value"], 3).select("ri", "ci", r6("value"))


STEPS = "SELECT a.ri, a.ci, abs(r.value - a.value) AS sr, abs(d.value - a.value) AS sd FROM {g} a LEFT JOIN {g} r ON r.ri = a.ri AND r.ci = a.ci + 1 LEFT JOIN {g} d ON d.ri = a.ri + 1 AND d.ci = a.ci"


@query("w8_roughness", f"SELECT round((avg(sr) + avg(sd)) / 2, 6) AS roughness FROM ({STEPS.format(g='grid')})", ("grid",))
def roughness(spark, sf):
    return GR.roughness(T.grid(spark, sf), "value").select(r6("roughness"))


@query("f9_slope_aspect", """WITH g AS (SELECT ri, ci, value * 500 AS e FROM grid), j AS (SELECT a.ri, a.ci, a.e, w.e AS we, x.e AS xe, n.e AS ne, s.e AS se FROM g a LEFT JOIN g w ON w.ri = a.ri AND w.ci = a.ci - 1 LEFT JOIN g x ON x.ri = a.ri AND x.ci = a.ci + 1
      LEFT JOIN g n ON n.ri = a.ri - 1 AND n.ci = a.ci LEFT JOIN g s ON s.ri = a.ri + 1 AND s.ci = a.ci),
    d AS (SELECT ri, ci, (coalesce(xe, e) - coalesce(we, e)) / (CASE WHEN xe IS NOT NULL AND we IS NOT NULL THEN 2 ELSE 1 END) / 1000 AS gx, (coalesce(se, e) - coalesce(ne, e)) / (CASE WHEN se IS NOT NULL AND ne IS NOT NULL THEN 2 ELSE 1 END) / 1000 AS gy FROM j)
    SELECT ri, ci, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope, round(cos(atan2(-gx, gy)), 5) + 0.0 AS cos_aspect FROM d""", ("grid",))
def slope_aspect(spark, sf):
    s = GR.slope_aspect(T.grid(spark, sf).withColumn("e", F.col("value") * 500), "e", 1000.0)
    return s.select("ri", "ci", F.round("slope", 5).alias("slope"), (F.round(F.cos(F.radians("aspect")), 5) + 0.0).alias("cos_aspect"))


@query("e31_agreement_by_block", " UNION ALL ".join(f"SELECT {k} AS block, count(*) AS n, round(corr(value, value_b), 6) AS correlation, round(avg(abs(value - value_b)), 6) AS mean_abs FROM (SELECT ri // {k}, ci // {k}, avg(value) AS value, avg(value_b) AS value_b FROM grid GROUP BY 1, 2 HAVING count(*) = {k * k})" for k in (1, 2, 4)), ("grid",))
def agreement(spark, sf):
    g, out = T.grid(spark, sf), None
    for k in (1, 2, 4):
        b = GR.block_mean(g, ["value", "value_b"], k)
        row = b.agg(F.lit(k).alias("block"), F.count(F.lit(1)).alias("n"), r6(F.corr("value", "value_b"), "correlation"), r6(F.avg(F.abs(F.col("value") - F.col("value_b"))), "mean_abs"))
        out = row if out is None else out.unionByName(row)
    return out


TAPS = [math.exp(-0.5 * (k / 1.0) ** 2) for k in range(-2, 3)]


@query("r6_smoothed_bins", "WITH b AS (SELECT floor(lon / 0.1)::BIGINT AS bx, floor(lat / 0.1)::BIGINT AS \"by\", count(*) AS n, avg(capacity_mw) AS mean FROM detectors GROUP BY 1, 2), k AS (SELECT * FROM (VALUES "
       + ", ".join(f"({i - 2}, {j - 2}, {a * c / sum(TAPS) ** 2!r}::DOUBLE)" for i, a in enumerate(TAPS) for j, c in enumerate(TAPS)) + """) k(dx, dy, w)),
    s AS (SELECT bx + dx AS bx, "by" + dy AS "by", sum(mean * w) AS v, sum(w) AS weight FROM b, k GROUP BY 1, 2) SELECT bx, "by", n, round(mean, 6) AS mean, round(CASE WHEN weight >= 0.05 THEN v / weight END, 6) AS smooth FROM b JOIN s USING (bx, "by")""", ("detectors",))
def smoothed(spark, sf):
    return GR.smooth_bins(T.detectors(spark, sf), "capacity_mw", 0.1, 1.0, 2).select("bx", "by", "n", r6("mean"), r6("smooth"))


@query("r7_density_histogram", "WITH h AS (SELECT label, least(floor(score / 0.05::DOUBLE), 19)::BIGINT AS bin, count(*) AS n FROM scores WHERE score BETWEEN 0 AND 1 GROUP BY 1, 2) SELECT label, bin, n, round(n / (sum(n) OVER (PARTITION BY label) * 0.05::DOUBLE), 6) AS density FROM h", ("scores",))
def histogram(spark, sf):
    return GR.density_histogram(T.scores(spark, sf), ["label"], "score", 0.0, 1.0, 20).select("label", "bin", "n", r6("density"))


@query("r7_two_dimensional_bins", "SELECT floor(slope / 5)::BIGINT AS bx, floor(ghi / 5000)::BIGINT AS \"by\", count(*) AS n, round(avg(score), 6) AS mean_score FROM criteria GROUP BY 1, 2", ("criteria",))
def bins_2d(spark, sf):
    return T.criteria(spark, sf).groupBy(F.floor(F.col("slope") / 5).cast("bigint").alias("bx"), F.floor(F.col("ghi") / 5000).cast("bigint").alias("by")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score"), "mean_score"))


@query("c7_map_disagreement", """WITH r AS (SELECT ri, ci, (rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2) / count(*) OVER () AS pa, (rank() OVER (ORDER BY value_b) + (count(*) OVER (PARTITION BY value_b) - 1) / 2) / count(*) OVER () AS pb FROM grid)
    SELECT ri, ci, round(pa - pb, 6) AS difference FROM r""", ("grid",))
def disagreement(spark, sf):
    g = T.grid(spark, sf)
    n = g.agg(F.count(F.lit(1)).alias("__n"))
    j = R.with_rank(R.with_rank(g, [], "value", "ra", (0.0, 1.0)), [], "value_b", "rb", (0.0, 1.0)).transform(R.attach_row, n)
    return j.select("ri", "ci", r6((F.col("ra") - F.col("rb")) / F.col("__n"), "difference"))


# --- embeddings --------------------------------------------------------------------------------
@query("f10_norm_dot_cosine", "WITH p AS (SELECT a.px_id, a.emb AS x, b.emb AS y FROM pixels a JOIN pixels b ON b.px_id = (a.px_id * 7 + 3) % (SELECT count(*) FROM pixels)) SELECT px_id, round(sqrt(list_dot_product(x, x)), 6) AS norm, round(list_dot_product(x, y), 6) AS dot, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 6) AS cosine FROM p", ("pixels",))
def vector_ops(spark, sf):
    p = T.pixels(spark, sf).select("px_id", F.col("emb").alias("x"))
    n = p.agg(F.count(F.lit(1)).alias("n"))
    other = p.select(F.col("px_id").alias("k"), F.col("x").alias("y"))
    j = p.transform(R.attach_row, n).withColumn("k", (F.col("px_id") * 7 + 3) % F.col("n")).join(other, "k")
    return j.select("px_id", r6(V.l2_norm("x"), "norm"), r6(V.dot("x", "y"), "dot"), r6(V.cosine("x", "y"), "cosine"))


MEANV = "u AS (SELECT {k}, unnest(emb) AS x, generate_subscripts(emb, 1) AS i FROM pixels), mv AS (SELECT {k}, i, avg(x) AS m FROM u GROUP BY ALL)"


@query("f11_mean_vector", "WITH " + MEANV.format(k="chip") + " SELECT chip, count(*) AS dims, round(sqrt(sum(m * m)), 6) AS norm, round(max(m), 6) AS largest, round(sum(m * i), 6) AS checksum FROM mv GROUP BY chip", ("pixels",))
def mean_vector(spark, sf):
    m = GR.mean_vector(T.pixels(spark, sf), ["chip"], "emb")
    weighted = F.aggregate(F.transform("emb", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return m.select("chip", F.size("emb").cast("bigint").alias("dims"), r6(V.l2_norm("emb"), "norm"), r6(F.array_max("emb"), "largest"), r6(weighted, "checksum"))


@query("a18_mean_and_resultant", "WITH " + MEANV.format(k="label") + ", n AS (SELECT label, count(*) AS n FROM pixels GROUP BY label), w AS (SELECT i, max(m) FILTER (WHERE label = 1) AS mp, max(m) FILTER (WHERE label = 0) AS mn FROM mv GROUP BY i) SELECT mv.label, max(n) AS n, round(sqrt(sum(m * m)), 6) AS resultant, round((SELECT sum(mp * mn) / (sqrt(sum(mp * mp)) * sqrt(sum(mn * mn))) FROM w), 6) AS cos_means FROM mv JOIN n USING (label) GROUP BY mv.label", ("pixels",))
def resultant(spark, sf):
    s = MO.component_sums(T.pixels(spark, sf), ["label"], "emb").withColumn("m", F.col("s") / F.col("n"))
    at = lambda l: F.max(F.when(F.col("label") == l, F.col("m")))
    w = s.groupBy("i").agg(at(1).alias("mp"), at(0).alias("mn")).agg((F.sum(F.col("mp") * F.col("mn")) / (F.sqrt(F.sum(F.col("mp") * F.col("mp"))) * F.sqrt(F.sum(F.col("mn") * F.col("mn"))))).alias("c"))
    per = s.groupBy("label").agg(F.max("n").alias("n"), r6(F.sqrt(F.sum(F.col("m") * F.col("m"))), "resultant"))
    return per.transform(R.attach_row, w).select("label", "n", "resultant", r6("c", "cos_means"))


@query("a18_covariance", "WITH p AS (SELECT label, px_id, unnest(emb) AS x, generate_subscripts(emb, 1) - 1 AS i FROM pixels) SELECT a.label, a.i::INTEGER AS i, b.i::INTEGER AS j, count(*) AS n, round(covar_pop(a.x, b.x), 8) AS cov FROM p a JOIN p b USING (px_id) GROUP BY a.label, a.i, b.i", ("pixels",))
def covariance(spark, sf):
    p = T.pixels(spark, sf)
    m = MO.component_sums(p, ["label"], "emb").select("label", "i", (F.col("s") / F.col("n")).alias("m"))
    o = MO.outer_sums(p, "label", "emb")
    j = o.join(m.withColumnRenamed("m", "mi"), ["label", "i"]).join(m.select("label", F.col("i").alias("j"), F.col("m").alias("mj")), ["label", "j"])
    return j.select("label", "i", "j", "n", F.round(F.col("s") / F.col("n") - F.col("mi") * F.col("mj"), 8).alias("cov"))


@query("a19_norm_statistics", "SELECT label, count(*) AS n, round(min(nm), 6) AS lo, round(quantile_cont(nm, 0.5), 6) AS median, round(max(nm), 6) AS hi, count(*) FILTER (WHERE abs(nm - 1) < 1e-3) AS unit_length FROM (SELECT label, sqrt(list_dot_product(emb, emb)) AS nm FROM pixels) GROUP BY label", ("pixels",))
def norms(spark, sf):
    n = T.pixels(spark, sf).select("label", V.l2_norm("emb").alias("nm"))
    s = n.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.min("nm"), "lo"), r6(F.max("nm"), "hi"), F.count_if(F.abs(F.col("nm") - 1) < 1e-3).alias("unit_length"))
    return s.join(R.quantiles(n, ["label"], "nm", {"median": 0.5}).withColumn("median", F.round("median", 6)), "label")


# Blocks of pixels: position from the id, 40 cells of 10 m wide. The fixed model is the closeness to the mean site vector.
FACTORS = [1, 3, 5, 10, 20, 50, 100, 200]
ABL = """px AS (SELECT px_id, px_id // 40 AS ri, px_id % 40 AS ci, label, emb FROM pixels), u AS (SELECT px_id, ri, ci, unnest(emb) AS x, generate_subscripts(emb, 1) AS i FROM px),
    proto AS (SELECT i, avg(x) AS m FROM u JOIN px USING (px_id) WHERE label = 1 GROUP BY i), sc AS (SELECT px_id, 1 / (1 + sqrt(sum((x - m) * (x - m)))) AS s FROM u JOIN proto USING (i) GROUP BY px_id)"""


def _ablation_sql() -> str:
    parts = ["SELECT '10 native' AS curve, label, round(s, 9) AS score FROM px JOIN sc USING (px_id)"]
    for k in FACTORS[1:]:
        block = f"ri // {k} AS br, ci // {k} AS bc"
        mean = f"(SELECT br, bc, i, avg(x) AS v FROM (SELECT {block}, i, x FROM u) GROUP BY ALL)"
        forms = f"""SELECT br, bc, sqrt(sum((v - m) * (v - m))) AS raw, sqrt(sum((v / len - m) * (v / len - m))) AS ren
            FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY br, bc)) AS len FROM {mean}) JOIN proto USING (i) GROUP BY br, bc"""
        cells = f"SELECT b.*, avg_s FROM ({forms}) b JOIN (SELECT {block}, avg(s) AS avg_s FROM px JOIN sc USING (px_id) GROUP BY ALL) USING (br, bc)"
        for name, s in (("mean_vector", "1 / (1 + raw)"), ("unit_mean", "1 / (1 + ren)"), ("score_mean", "avg_s")):
            parts.append(f"SELECT '{10 * k} {name}', label, round({s}, 9) FROM (SELECT {block}, label FROM px) JOIN ({cells}) USING (br, bc)")
    return f"""WITH {ABL}, pts AS ({' UNION ALL '.join(parts)})
      SELECT split_part(curve, ' ', 1)::INTEGER AS resolution_m, split_part(curve, ' ', 2) AS method, * EXCLUDE (curve) FROM ({report_sql('pts', 'curve')})"""


@query("r4_resolution_ablation", _ablation_sql(), ("pixels",))
def ablation(spark, sf):
    """Every pixel scored from its coarse cell at eight resolutions: mean vector, its unit form, and mean of scores.

    With S the vector sum of a block, n its pixels and m the mean site vector, |S/n - m|² and |S/|S| - m|² follow from S·S and S·m.
    """
    p = T.pixels(spark, sf).select(F.floor(F.col("px_id") / 40).cast("bigint").alias("ri"), (F.col("px_id") % 40).alias("ci"), "label", "emb")
    proto = GR.mean_vector(p.filter("label = 1").withColumn("g", F.lit(1)), ["g"], "emb").first()["emb"]  # 64 numbers
    pv, mm = V.literal_vector(proto), float(sum(x * x for x in proto))
    close = lambda square: 1 / (1 + F.sqrt(F.greatest(square, F.lit(0.0))))
    q, d, n = F.col("q"), F.col("d"), F.col("n")
    dots = lambda t: t.withColumn("q", V.dot("emb", "emb")).withColumn("d", V.dot("emb", pv))
    pos = F.when(F.col("label") == 1, 1).otherwise(0)
    cells = dots(p).select("ri", "ci", F.lit(1).alias("n"), pos.alias("pos"), (1 - pos).alias("neg"), close(q - 2 * d + mm).alias("s"), "emb")
    out = None
    for k, level in GR.pyramid(cells, FACTORS, ["n", "pos", "neg", "s"], "emb", len(proto)).items():
        forms = {"native": F.col("s")} if k == 1 else {
            "mean_vector": close(q / (n * n) - 2 * d / n + mm), "unit_mean": close(1 - 2 * d / F.sqrt(q) + mm), "score_mean": F.col("s") / n}
        rows = F.array(*[F.struct(F.lit(m).alias("method"), F.round(s, 9).alias("score")) for m, s in forms.items()])
        long = dots(level).select(F.lit(10 * k).alias("resolution_m"), "pos", "neg", F.inline(rows))
        out = long if out is None else out.unionByName(long)
    group = ["resolution_m", "method"]
    return E.report(E.count_profile(out, group), group)


@query("m1_prototype_cosine", "WITH proto AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(emb) AS x, generate_subscripts(emb, 1) AS i FROM pixels WHERE label = 1) GROUP BY i)) SELECT px_id, round(list_cosine_similarity(emb, m), 6) AS score FROM pixels, proto", ("pixels",))
def prototype(spark, sf):
    p = T.pixels(spark, sf)
    mean = MO.component_sums(p.filter("label = 1"), ["label"], "emb").orderBy("i").collect()  # 64 rows
    import numpy as np

    return p.select("px_id", r6(MO.prototype_score("emb", np.array([r["s"] / r["n"] for r in mean])), "score"))


@query("m4_contrast_direction", "WITH mv AS (SELECT i, avg(x) FILTER (WHERE label = 1) - avg(x) FILTER (WHERE label = 0) AS w FROM (SELECT label, unnest(emb) AS x, generate_subscripts(emb, 1) AS i FROM pixels) GROUP BY i), pv AS (SELECT list(w ORDER BY i) AS w, sqrt(sum(w * w)) AS nw FROM mv) SELECT px_id, round(list_dot_product(emb, w) / nw, 6) AS score FROM pixels, pv", ("pixels",))
def contrast(spark, sf):
    p = T.pixels(spark, sf)
    m = MO.fit_moments(p, "label", "emb")
    return p.select("px_id", r6(MO.contrast_score("emb", m[1]["mean"], m[0]["mean"]), "score"))


# --- MCDA ----------------------------------------------------------------------------------------
CR = sorted(M.DIRECTION)
LONG = f"u AS (UNPIVOT (SELECT country, label, {', '.join(CR)} FROM criteria) ON {', '.join(CR)} INTO NAME criterion VALUE v)"
RANGES = f"{LONG}, rg AS (SELECT country, criterion, count(*) AS n_finite, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM u WHERE label = 0 GROUP BY ALL HAVING count(*) >= 100)"


@query("c1_criterion_ranges", f"WITH {RANGES} SELECT country, criterion, n_finite, round(lo, 6) AS lo, round(hi, 6) AS hi FROM rg", ("criteria",))
def ranges(spark, sf):
    return M.criterion_ranges(T.criteria(spark, sf), "country", CR).select("country", "criterion", "n_finite", r6("lo"), r6("hi"))


def _norm_sql() -> str:
    wide = ", ".join(f"max(lo) FILTER (WHERE criterion = '{c}') AS lo_{c}, max(hi) FILTER (WHERE criterion = '{c}') AS hi_{c}" for c in CR)
    one = []
    for c in CR:
        v = f"CASE WHEN {c} IS NULL OR lo_{c} IS NULL THEN NULL ELSE least(greatest(({c} - lo_{c}) / (hi_{c} - lo_{c} + 1e-12), 0), 1) END"
        one.append(f"({v if M.DIRECTION[c] == 'b' else f'1 - {v}'}) AS n_{c}, lo_{c} IS NOT NULL AS has_{c}")
    return f"""{RANGES}, wd AS (SELECT country, {wide} FROM rg GROUP BY country), nm AS (SELECT c.*, {', '.join(one)}, {SUIT} AS n_land,
        coalesce(wdpa, 0) >= 0.5 OR coalesce(worldcover, -1) IN (80, 90) AS excl FROM criteria c LEFT JOIN wd USING (country))"""


@query("c1_normalised", f"WITH {_norm_sql()} SELECT {KEYLIST}, country, round(n_ghi, 6) AS n_ghi, round(n_slope, 6) AS n_slope, round(n_road, 6) AS n_road, round(n_grid, 6) AS n_grid FROM nm", ("criteria",))
def normalised(spark, sf):
    c = T.criteria(spark, sf)
    n = M.normalise(c, "country", CR, M.criterion_ranges(c, "country", CR))
    return n.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "country", *[r6(f"n_{x}") for x in ("ghi", "slope", "road", "grid")])


def _score_sql(vectors, modes, places: int = 9) -> str:
    parts = []
    for name, vec in vectors.items():
        for mode in modes:
            w = {c: (f"CASE WHEN has_{c} THEN {v!r} ELSE 0 END" if c != "land" else repr(v)) for c, v in vec.items()}
            if mode == "weighted" and "land" not in vec:
                w["land"] = repr(sum(vec.values()) / len(vec))
            tot = "(" + " + ".join(f"({x})::DOUBLE" for x in w.values()) + ")"
            val = lambda c: f"CASE WHEN NOT has_{c} THEN 0 ELSE n_{c} END" if c != "land" else "n_land"
            t = {c: f"(({x})::DOUBLE / {tot})" for c, x in w.items()}
            wlc = " + ".join(f"{t[c]} * ({val(c)})" for c in w)
            dp = " + ".join(f"({t[c]} * ({val(c)}) - {t[c]}) * ({t[c]} * ({val(c)}) - {t[c]})" for c in w)
            dm = " + ".join(f"{t[c]} * ({val(c)}) * {t[c]} * ({val(c)})" for c in w)
            for agg, s in (("wlc", wlc), ("topsis", f"sqrt({dm}) / (sqrt({dp}) + sqrt({dm}) + 1e-12)")):
                parts.append(f"SELECT {KEYLIST}, country, label, source, '{name}' AS config, '{agg}' AS aggregator, '{mode}' AS land, round(CASE WHEN ({s}) IS NOT NULL AND excl THEN 0 ELSE {s} END, {places}) AS mcda FROM nm")
    return f"{_norm_sql()}, sc AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE mcda IS NOT NULL)"


BOTH = ("excl", "weighted")


def scored(spark, sf, **kw):
    keep = kw.pop("keep", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "country", "label", "source"])
    s = M.score_configs(T.criteria(spark, sf), "country", keep, **kw)
    return s.withColumn("mcda", F.round("mcda", 9))


@query("c2_prepared_weights", f"WITH {RANGES}, w AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}', {v!r}::DOUBLE)" for n, vec in M.config_vectors().items() for c, v in vec.items())
       + ") w(config, criterion, weight)), lw AS (SELECT config, avg(weight) AS lw FROM w GROUP BY config), a AS (SELECT country, config, criterion, weight FROM w JOIN rg USING (criterion) UNION ALL SELECT country, config, 'land', lw FROM lw, (SELECT DISTINCT country FROM rg)) SELECT country, config, criterion, round(weight / sum(weight) OVER (PARTITION BY country, config), 6) AS weight FROM a", ("criteria",))
def prepared_weights(spark, sf):
    r = M.criterion_ranges(T.criteria(spark, sf), "country", CR)
    return M.weight_table(r, "country", M.config_vectors()).withColumn("weight", F.round("weight", 6))


@query("c3_weighted_sum", f"WITH {_score_sql({'richards': M.RICHARDS}, ('excl',))} SELECT {KEYLIST}, mcda FROM sc WHERE aggregator = 'wlc'", ("criteria",))
def weighted_sum(spark, sf):
    return scored(spark, sf, vectors={"richards": M.RICHARDS}, modes=("excl",), aggregators=("wlc",)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "mcda")


@query("c4_topsis", f"WITH {_score_sql({'chen': M.CHEN}, ('weighted',))} SELECT {KEYLIST}, mcda FROM sc WHERE aggregator = 'topsis'", ("criteria",))
def topsis(spark, sf):
    return scored(spark, sf, vectors={"chen": M.CHEN}, modes=("weighted",), aggregators=("topsis",)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "mcda")


BY = "country, config, aggregator, land"


@query("c5_config_matrix", f"WITH {_score_sql(M.config_vectors(), BOTH)} {auc_sql('sc', BY, 'mcda', 'HAVING max(tp) + max(tn) >= 50 AND max(tp) >= 5')}", ("criteria",))
def config_matrix(spark, sf):
    """Points with a model score alone; configs with fewer than 50 rows or 5 sites in a country are left out."""
    finite = F.col("score").isNotNull() & ~F.isnan("score")
    return M.config_areas(T.criteria(spark, sf), "country", only=finite).filter("n_pos + n_neg >= 50 AND n_pos >= 5")


@query("e11_best_config", f"WITH {_score_sql(M.config_vectors(), BOTH)}, a AS ({auc_sql('sc', BY, 'mcda')}) SELECT country, config, aggregator, land, roc FROM a WHERE n_pos >= 5 AND n_neg >= 5 QUALIFY row_number() OVER (PARTITION BY country ORDER BY roc DESC, config, aggregator, land) = 1", ("criteria",))
def best_config(spark, sf):
    a = M.config_areas(T.criteria(spark, sf), "country").filter("n_pos >= 5 AND n_neg >= 5")
    return a.groupBy("country").agg(F.min(F.struct((-F.col("roc")).alias("k"), "config", "aggregator", "land")).alias("b")).select("country", "b.config", "b.aggregator", "b.land", (-F.col("b.k")).alias("roc"))


OLD = {"balanced": M.BALANCED, "irradiance": M.IRRADIANCE, "infrastructure": M.INFRASTRUCTURE}


@query("c8_three_vector_benchmark", f"WITH {_score_sql(OLD, ('excl',))}, w AS (SELECT * FROM sc WHERE aggregator = 'wlc') {auc_sql('w', 'country, config', 'mcda')}", ("criteria",))
def three_vectors(spark, sf):
    return M.config_areas(T.criteria(spark, sf), "country", vectors=OLD, modes=("excl",), aggregators=("wlc",)).drop("aggregator", "land")


@query("c6_expert_classes", "WITH b AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {lo!r}::DOUBLE, {hi!r}::DOUBLE, {k})" for c, bs in M.BREAKPOINTS.items() for lo, hi, k in bs)
       + ") b(criterion, lo, hi, class)), u AS (UNPIVOT (SELECT country, road, grid, slope, elevation FROM criteria) ON road, grid, slope, elevation INTO NAME criterion VALUE v) SELECT country, u.criterion, coalesce(class, -1) AS class, count(*) AS n FROM u LEFT JOIN b ON b.criterion = u.criterion AND v >= lo AND v < hi GROUP BY ALL", ("criteria",))
def expert_classes(spark, sf):
    from heliograde.operators.compare import stack_criteria

    u = stack_criteria(T.criteria(spark, sf), ["country"], ["road", "grid", "slope", "elevation"])
    cls = F.coalesce(*[F.when(F.col("criterion") == c, M.reclassify(F.col("value"), c)) for c in M.BREAKPOINTS], F.lit(-1))
    return u.groupBy("country", "criterion", cls.alias("class")).agg(F.count(F.lit(1)).alias("n"))
