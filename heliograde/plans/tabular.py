"""Queries: scans, predicates, scalar rules, joins, aggregations, top lists, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heliograde.functions import scalars as X
from heliograde.functions.hashing import hash_order, hash_order_sql as H
from heliograde.operators import ranking as R
from heliograde.operators import summaries as A
from heliograde.plans.evaluation import METRIC, config_metrics, profile_sql
from heliograde.plans.registry import query
from heliograde.session import scratch_folder
from heliograde.sources import files
from heliograde.sources import tables as T
from heliograde.streaming import incremental as I

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
r6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


# --- scans --------------------------------------------------------------------------------
@query("s1_column_subset_scan", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def column_subset(spark, sf):
    """Orders as CSV in the job's scratch space; one of its columns is parsed."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    orders = T.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    files.write_rows_csv(orders, path)
    return files.read_csv(spark, path, orders.schema, ["o_custkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("s2_yearly_files", "SELECT gen_year, count(*) AS n, round(sum(power), 2) AS power FROM generation GROUP BY gen_year", ("generation",))
def yearly(spark, sf):
    """Write the facts as one CSV folder per year into the job's scratch space, read them back, year from the path."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    T.generation(spark, sf).select("pv_id", "power", F.col("gen_year").alias("y")).write.partitionBy("y").option("header", "true").csv(path)
    back = files.read_yearly(spark, f"{path}/*", "pv_id bigint, power double", ["power"])
    return back.groupBy("gen_year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("power"), 2).alias("power"))


@query("s3_pushed_predicate", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2000-01-01'")
def pushed(spark, sf):
    o = T.read(spark, sf, "orders")
    return o.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))).select("o_orderkey", "o_totalprice")


@query("s4_pushed_bbox", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 1000 AND 2500 AND c_nationkey BETWEEN 5 AND 15")
def pushed_bbox(spark, sf):
    """Two range columns, the shape of a bounding-box filter, both reaching the scan."""
    return T.read(spark, sf, "customer").filter(F.col("c_acctbal").between(1000, 2500) & F.col("c_nationkey").between(5, 15)).select("c_custkey", "c_acctbal")


@query("s5_attribute_only_scan", "SELECT country, count(*) AS n, min(year) AS first_year, max(year) AS last_year FROM sites GROUP BY country", ("sites",))
def attributes(spark, sf):
    return T.sites(spark, sf).select("country", "year").groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("s6_json_rollup", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks, sum((json_extract(props, '$.k'))::BIGINT)::BIGINT AS k_sum, max((json_extract(props, '$.k'))::BIGINT) AS k_max FROM events GROUP BY user_id")
def json_rollup(spark, sf):
    """JSON reports of a user with an array of at most 100 entries, written to the job's scratch space, read back and rolled up to a row a user."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    e = T.read(spark, sf, "events").select("user_id", F.floor(F.col("event_id") / 100).alias("part"), F.struct("event_type", F.from_json("props", "k bigint").getField("k").alias("k")).alias("e"))
    e.groupBy("user_id", "part").agg(F.collect_list("e").alias("entries")).drop("part").write.json(path)
    reports = files.read_json_reports(spark, path, "user_id bigint, entries array<struct<event_type: string, k: bigint>>", lines=True)
    clicks = F.count(F.when(F.col("event_type") == "click", 1))
    return files.roll_up(reports, "user_id", "entries", [F.count("event_type").alias("n"), clicks.alias("clicks"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max")])


NAME_RX = r"^(POS|NEG)_([A-Z]{3})_(\d+)_(\d{4})(?:_(\d+))?\.tif$"
PARTS = f"""SELECT chip, regexp_matches(chip, '{NAME_RX}') AS ok, nullif(regexp_extract(chip, '{NAME_RX}', 1), '') AS kind, nullif(regexp_extract(chip, '{NAME_RX}', 2), '') AS iso3,
    nullif(regexp_extract(chip, '{NAME_RX}', 3), '')::BIGINT AS scene, nullif(regexp_extract(chip, '{NAME_RX}', 4), '')::INTEGER AS year, nullif(regexp_extract(chip, '{NAME_RX}', 5), '')::INTEGER AS tile FROM chip_names"""


@query("s7_chip_names", f"SELECT chip, ok, kind, iso3, coalesce(scene, -1) AS scene, coalesce(year, -1) AS year, coalesce(tile, -1) AS tile FROM ({PARTS})", ("chip_names",))
def names(spark, sf):
    """Malformed names are kept and marked; their numeric parts show as -1."""
    return files.read_names(T.chip_names(spark, sf), "chip").fillna(-1, ["scene", "year", "tile"])


@query("s8_sorted_sink", "SELECT p_partkey, p_retailprice FROM part")
def sorted_sink(spark, sf):
    """Sorted CSV written and read back: same rows."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    files.write_sorted_csv(T.read(spark, sf, "part").select("p_partkey", "p_retailprice"), path, [F.desc("p_retailprice"), "p_partkey"])
    return spark.read.csv(path, header=True, schema="p_partkey bigint, p_retailprice double")


@query("s9_metric_rows", """SELECT experiment, scope::VARCHAR AS scope, round(avg(value), 5) AS value, count(*) AS n_pos FROM results_log GROUP BY ALL""", ("results_log",))
def metric_rows(spark, sf):
    """Two batches appended to a log, the second one twice as a retry does, and read back."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    m = T.results_log(spark, sf).groupBy("experiment", "scope").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_pos"))
    I.append_batch(m.filter("scope < 25"), path, "low")
    for _ in range(2):
        I.append_batch(m.filter("scope >= 25"), path, "high")
    return I.read_results(spark, path).select("experiment", "scope", "value", "n_pos")


@query("s10_stage_events", "SELECT event_type AS stage, CASE WHEN value > 100 THEN 'slow' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def stage_events(spark, sf):
    """Stage events written as JSON lines and rolled up by stage and status."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    e = T.read(spark, sf, "events")
    I.append_stages(e.select(F.col("event_type").alias("stage"), F.when(F.col("value") > 100, "slow").otherwise("ok").alias("status"), "ts"), path)
    back = spark.read.schema("stage string, status string").json(path)
    return back.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"))


@query("s11_replace_by_key", """WITH cur AS (SELECT experiment, scope, max(event_id) AS v FROM results_log WHERE value <= 100 GROUP BY ALL), new AS (SELECT experiment, scope, -min(event_id) AS v FROM results_log WHERE value > 100 GROUP BY ALL)
    SELECT * FROM cur WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.experiment = cur.experiment AND new.scope = cur.scope) UNION ALL SELECT * FROM new""", ("results_log",))
def replace(spark, sf):
    """A stored table, its rows replaced by key on disk and read back."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    log = T.results_log(spark, sf)
    cur = log.filter("value <= 100").groupBy("experiment", "scope").agg(F.max("event_id").alias("v"))
    new = log.filter("value > 100").groupBy("experiment", "scope").agg((-F.min("event_id")).alias("v"))
    for rows in (cur, new):
        I.replace_stored(spark, path, rows, ["experiment", "scope"], "experiment")
    return spark.read.schema(new.schema).parquet(path)


@query("s12_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def resume(spark, sf):
    done = T.read(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return I.remaining(T.read(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("s13_site_manifest", """WITH b AS (SELECT 'NEG_' || upper(replace(substring(country, 1, 3), ' ', '')) || '_' || site_id::VARCHAR || '_' || year::VARCHAR AS name, country, year, lon, lat FROM sites)
    SELECT name, year, round(lon - 2560 / (cos(radians(lat)) * 111320), 6) AS minx, round(lat - 2560 / 111320.0::DOUBLE, 6) AS miny, name || '.tif' AS old_filename, 'Polygon' AS geometry FROM b""", ("sites",))
def site_manifest(spark, sf):
    s = T.sites(spark, sf).withColumn("name", F.regexp_replace(X.chip_name("NEG", F.col("country"), F.col("site_id"), F.col("year")), r"\.tif$", "")).withColumn(
        "box", X.pad_box(F.col("lon"), F.col("lat"), 2560.0))
    j = s.select("name", "year", files.site_feature().alias("feature"))
    get = lambda p: F.get_json_object("feature", p)
    return j.select(
        "name", get("$.properties.target_year").cast("int").alias("year"), r6(get("$.properties.bounds[0]").cast("double"), "minx"),
        r6(get("$.properties.bounds[1]").cast("double"), "miny"), get("$.properties.old_filename").alias("old_filename"), get("$.geometry.type").alias("geometry"),
    )


# --- predicates and scalar rules --------------------------------------------------------------
@query("p1_site_eligibility", """WITH e AS (SELECT * FROM sites WHERE year >= 2019 AND area_m2 >= 100000), c AS (SELECT country, count(*) AS n FROM e GROUP BY country)
    SELECT count(*) AS n, round(sum(area_m2), 2) AS area, min(year) AS first_year, (SELECT country FROM c ORDER BY n DESC, country LIMIT 1) AS mode_country FROM e""", ("sites",))
def eligibility(spark, sf):
    e = T.sites(spark, sf).filter("year >= 2019 AND area_m2 >= 100000").withColumn("g", F.lit(0))
    per = e.groupBy("country").agg(F.count(F.lit(1)).alias("c"), F.sum("area_m2").alias("a"), F.min("year").alias("y"))
    return per.agg(F.sum("c").alias("n"), F.round(F.sum("a"), 2).alias("area"), F.min("y").alias("first_year"), F.min_by("country", F.struct(-F.col("c"), F.col("country"))).alias("mode_country"))


@query("p2_imagery_year", "SELECT site_id, greatest(year - 2, 2017) AS image_year, greatest(year - 3, 2017) AS image_year_t3, 'POS_' || upper(replace(substring(country, 1, 3), ' ', '')) || '_' || site_id::VARCHAR || '_' || greatest(year - 2, 2017)::VARCHAR || '.tif' AS filename FROM sites", ("sites",))
def imagery_year(spark, sf):
    y = X.imagery_year("year")
    return T.sites(spark, sf).select("site_id", y.alias("image_year"), X.imagery_year("year", 3).alias("image_year_t3"), X.chip_name("POS", F.col("country"), F.col("site_id"), y).alias("filename"))


@query("p3_year_redraw", f"SELECT site_id, (CASE WHEN year - 3 BETWEEN 2017 AND 2022 THEN year - 3 ELSE 2017 + {H('site_id', 3)} % 6 END)::INTEGER AS year FROM sites", ("sites",))
def year_redraw(spark, sf):
    return T.sites(spark, sf).select("site_id", X.redraw_year(F.col("year") - 3, hash_order("site_id", 3)).alias("year"))


@query("p4_date_gate", """WITH d AS (SELECT *, try_cast(substring(constructed_after, 1, 10) AS DATE) AS d FROM detectors)
    SELECT CASE WHEN constructed_after IS NULL THEN 'missing' WHEN d IS NULL THEN 'unparseable' WHEN year(d) < 2020 THEN 'too early' ELSE 'kept' END AS reason, count(*) AS n, round(sum(capacity_mw), 4) AS capacity FROM d GROUP BY 1""", ("detectors",))
def date_gate(spark, sf):
    d = T.detectors(spark, sf).withColumn("y", X.date_year("constructed_after"))
    why = F.when(F.col("constructed_after").isNull(), "missing").when(F.col("y").isNull(), "unparseable").when(F.col("y") < 2020, "too early").otherwise("kept")
    return d.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("capacity_mw"), 4).alias("capacity"))


@query("p5_spatial_gate", "SELECT det_id, nn_m, nn_m > 1000 AS is_new FROM detectors WHERE nn_m >= 1000", ("detectors",))
def spatial_gate(spark, sf):
    return T.detectors(spark, sf).filter("nn_m >= 1000").select("det_id", "nn_m", (F.col("nn_m") > 1000).alias("is_new"))


@query("p6_all_finite", "SELECT label, count(*) AS n, count(*) FILTER (WHERE len(list_filter(emb, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) AS finite FROM pixels GROUP BY label", ("pixels",))
def finite(spark, sf):
    from heliograde.functions.vectors import all_finite

    return T.pixels(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(all_finite("emb")).alias("finite"))


RAW = "(CASE WHEN l_partkey % 29 = 0 THEN -999 WHEN l_partkey % 31 = 0 THEN -1e38 WHEN l_partkey % 37 = 0 THEN -1 ELSE l_extendedprice END)::DOUBLE"


@query("p7_nodata", f"SELECT l_suppkey % 13 AS country, count(*) AS n, count(CASE WHEN {RAW} IN (-999, -1) OR {RAW} < -1e30 THEN NULL ELSE 1 END) AS valid, round(avg(CASE WHEN {RAW} IN (-999, -1) OR {RAW} < -1e30 THEN NULL ELSE {RAW} END), 4) AS mean FROM lineitem GROUP BY 1")
def nodata(spark, sf):
    p = F.col("l_partkey")
    raw = F.when(p % 29 == 0, -999.0).when(p % 31 == 0, -1e38).when(p % 37 == 0, -1.0).otherwise(F.col("l_extendedprice"))
    v = T.read(spark, sf, "lineitem").select((F.col("l_suppkey") % 13).alias("country"), raw.alias("raw")).withColumn("v", X.without_nodata("raw"))
    return v.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("valid"), F.round(F.avg("v"), 4).alias("mean"))


@query("p8_pool_filters", "SELECT 'exclude_3' AS rule, count(*) AS n, sum(label)::BIGINT AS n_pos FROM pool WHERE country <> 3 UNION ALL SELECT 'until_2021', count(*), sum(label)::BIGINT FROM pool WHERE year <= 2021", ("pool",))
def pool_filters(spark, sf):
    """Every leave-out variant from one scan: rules are tags on the row, not separate passes."""
    p = T.pool(spark, sf)
    rules = F.filter(F.array(F.when(F.col("country") != 3, F.lit("exclude_3")), F.when(F.col("year") <= 2021, F.lit("until_2021"))), lambda x: x.isNotNull())
    return p.select("label", F.explode(rules).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"))


@query("p10_exclusion_mask", "SELECT country, count(*) AS n, count(*) FILTER (WHERE coalesce(wdpa, 0) >= 0.5 OR coalesce(worldcover, -1) IN (80, 90)) AS excluded, round(avg(CASE WHEN coalesce(wdpa, 0) >= 0.5 OR coalesce(worldcover, -1) IN (80, 90) THEN 0 ELSE score END), 6) AS mean_score FROM criteria GROUP BY country", ("criteria",))
def exclusion(spark, sf):
    c = T.criteria(spark, sf).withColumn("x", X.excluded_land("worldcover", "wdpa"))
    return c.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count_if("x").alias("excluded"), F.round(F.avg(F.when(F.col("x"), 0.0).otherwise(F.col("score"))), 6).alias("mean_score"))


GATES = {"suit": "score >= 0.436", "slope": "slope <= 5", "grid": "grid <= 10000", "wc": "coalesce(worldcover, -1) IN (20, 30, 60)", "wc_crop": "coalesce(worldcover, -1) IN (20, 30, 40, 60)", "wdpa": "wdpa < 0.5"}
GATE_ALL = {"all": [g for g in GATES if g != "wc_crop"], "all_crop": [g for g in GATES if g != "wc"]}


@query("p11_gate_pass_rates", "WITH g AS (SELECT label, " + ", ".join(f"({e})::INTEGER AS g_{k}" for k, e in GATES.items()) + ", "
       + ", ".join(f"({' AND '.join('(' + GATES[g] + ')' for g in gs)})::INTEGER AS g_{k}" for k, gs in GATE_ALL.items())
       + " FROM criteria) " + " UNION ALL ".join(f"SELECT '{k}' AS gate, round(avg(g_{k}) FILTER (WHERE label = 0), 6) AS land, round(avg(g_{k}) FILTER (WHERE label = 1), 6) AS sites FROM g" for k in [*GATES, *GATE_ALL]), ("criteria",))
def gates(spark, sf):
    from heliograde.operators.gates import pass_rates

    return pass_rates(T.criteria(spark, sf), {k: F.expr(e) for k, e in GATES.items()}, GATE_ALL)


@query("e27_potential", "SELECT round(avg((" + " AND ".join("(" + GATES[g] + ")" for g in GATE_ALL["all"]) + ")::INTEGER), 6) AS fraction, round(avg((" + " AND ".join("(" + GATES[g] + ")" for g in GATE_ALL["all"]) + ")::INTEGER) * 1.3e8 * 39.4 / 1e6, 4) AS capacity_tw, round(avg((" + " AND ".join("(" + GATES[g] + ")" for g in GATE_ALL["all"]) + ")::INTEGER) * 1.3e8 * 39.4 / 1e6 / 1.33, 4) AS ratio_installed FROM criteria WHERE label = 0", ("criteria",))
def potential(spark, sf):
    from heliograde.operators.gates import potential as pot

    return pot(T.criteria(spark, sf), [F.expr(GATES[g]) for g in GATE_ALL["all"]], 1.3e8, 39.4, 1.33)


@query("p12_pack_score", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(round(score * 10000)::SMALLINT, (-1)::SMALLINT) AS packed, CASE WHEN score IS NULL THEN NULL ELSE round(score * 10000) / 10000 END AS unpacked FROM scores", ("scores",))
def pack(spark, sf):
    s = T.scores(spark, sf).withColumn("packed", X.pack_score("score"))
    return s.select(*KEYS, "packed", X.unpack_score("packed").alias("unpacked"))


@query("p13_replace_column", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, score, round(cos(radians(temp * 8) - pi()), 6) AS aspect, slope FROM criteria", ("criteria",))
def replace_column(spark, sf):
    """The raw circular aspect is dropped and its folded form takes its place; the rest passes."""
    c = T.criteria(spark, sf).withColumn("raw_aspect", F.col("temp") * 8)
    fixed = c.withColumn("aspect", X.folded_aspect(F.col("raw_aspect"), F.col("slope"), F.lit(1.0)).getField("equatorwardness")).drop("raw_aspect")
    return fixed.select(*KEYS, "score", r6("aspect"), "slope")


@query("f1_slug_and_iso", "SELECT site_id, replace(lower(country), ' ', '_') AS slug, upper(substring(country, 1, 3)) AS code FROM sites", ("sites",))
def slugs(spark, sf):
    return T.sites(spark, sf).select("site_id", X.slug("country").alias("slug"), F.upper(F.substring("country", 1, 3)).alias("code"))


LISTS = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '[' || o_orderkey || ', ' || o_custkey || ']' WHEN 1 THEN '(' || o_orderkey || ',' || o_custkey || ')' WHEN 2 THEN o_orderkey || '; ' || o_custkey ELSE '''' || o_custkey || '''' END AS txt FROM orders"


@query("f2_parse_id_list", f"WITH t AS ({LISTS}) SELECT o_orderkey, list_sum(ids)::BIGINT AS id_sum, len(ids) AS n FROM (SELECT o_orderkey, list_transform(regexp_extract_all(txt, '\\d+'), lambda x: x::BIGINT) AS ids FROM t)")
def id_lists(spark, sf):
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    txt = (F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("["), k, F.lit(", "), c, F.lit("]"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("("), k, F.lit(","), c, F.lit(")")))
           .when(F.col("o_orderkey") % 4 == 2, F.concat(k, F.lit("; "), c)).otherwise(F.concat(F.lit("'"), c, F.lit("'"))))
    ids = T.read(spark, sf, "orders").select("o_orderkey", X.parse_id_list(txt).alias("ids"))
    return ids.select("o_orderkey", F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"), F.size("ids").cast("bigint").alias("n"))


@query("f3_date_year", "SELECT det_id, coalesce(year(try_cast(substring(constructed_after, 1, 10) AS DATE)), -1)::INTEGER AS yr_after, coalesce(year(try_cast(substring(constructed_before, 1, 10) AS DATE)), -1)::INTEGER AS yr_before FROM detectors", ("detectors",))
def date_years(spark, sf):
    return T.detectors(spark, sf).select("det_id", X.date_year("constructed_after").alias("yr_after"), X.date_year("constructed_before").alias("yr_before")).fillna(-1, ["yr_after", "yr_before"])


@query("f4_utm_zone", "SELECT site_id, (least(greatest(floor((lon + 180) / 6)::INTEGER + 1, 1), 60) + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END)::INTEGER AS epsg FROM sites", ("sites",))
def utm(spark, sf):
    return T.sites(spark, sf).select("site_id", X.utm_epsg("lon", "lat").alias("epsg"))


@query("f5_metric_padding", "SELECT site_id, round(lon - 1500 / (cos(radians(lat)) * 111320), 6) AS minx, round(lat - 1500 / 111320.0::DOUBLE, 6) AS miny, round(lon + 1500 / (cos(radians(lat)) * 111320), 6) AS maxx, round(lat + 1500 / 111320.0::DOUBLE, 6) AS maxy FROM sites", ("sites",))
def padding(spark, sf):
    s = T.sites(spark, sf).select("site_id", X.pad_box(F.col("lon"), F.col("lat"), 1500.0).alias("b"))
    return s.select("site_id", *[r6(f"b.{c}", c) for c in ("minx", "miny", "maxx", "maxy")])


MARGIN = """WITH m AS (SELECT o_custkey, min(o_orderkey % 997 * 10.0::DOUBLE) AS pminx, max(o_orderkey % 997 * 10.0::DOUBLE) AS pmaxx, min(o_orderkey % 991 * 10.0::DOUBLE) AS pminy, max(o_orderkey % 991 * 10.0::DOUBLE) AS pmaxy FROM orders GROUP BY o_custkey),
    b AS (SELECT *, pminx - (o_custkey % 20) * 100 AS bminx, pmaxx + (o_custkey % 17) * 100 AS bmaxx, pminy - (o_custkey % 19) * 100 AS bminy, pmaxy + (o_custkey % 23) * 100 AS bmaxy, o_custkey % 2 = 0 AS exported FROM m),
    g AS (SELECT *, least(pminx - bminx, pminy - bminy, bmaxx - pmaxx, bmaxy - pmaxy) AS margin FROM b), f AS (SELECT *, exported AND margin < 1200 AS purge, (exported AND margin < 1200) OR (NOT exported AND margin < 1500) AS pad FROM g)"""


@query("f6_edge_margins", MARGIN + """ SELECT o_custkey, margin, purge, pad, CASE WHEN pad AND pminx - bminx < 1500 THEN pminx - 1500 ELSE bminx END AS minx, CASE WHEN pad AND pminy - bminy < 1500 THEN pminy - 1500 ELSE bminy END AS miny,
    CASE WHEN pad AND bmaxx - pmaxx < 1500 THEN pmaxx + 1500 ELSE bmaxx END AS maxx, CASE WHEN pad AND bmaxy - pmaxy < 1500 THEN pmaxy + 1500 ELSE bmaxy END AS maxy FROM f""")
def edge_margins(spark, sf):
    from heliograde.operators.gates import widen_margins

    k = F.col("o_orderkey")
    m = T.read(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min(k % 997 * 10.0).alias("pminx"), F.max(k % 997 * 10.0).alias("pmaxx"), F.min(k % 991 * 10.0).alias("pminy"), F.max(k % 991 * 10.0).alias("pmaxy"))
    c = F.col("o_custkey")
    b = m.select("*", (F.col("pminx") - c % 20 * 100).alias("minx"), (F.col("pmaxx") + c % 17 * 100).alias("maxx"), (F.col("pminy") - c % 19 * 100).alias("miny"),
                 (F.col("pmaxy") + c % 23 * 100).alias("maxy"), (c % 2 == 0).alias("exported"))
    return widen_margins(b).select("o_custkey", "margin", "purge", "pad", "minx", "miny", "maxx", "maxy")


@query("f6_inflate_boxes", "SELECT o_orderkey, greatest(w, 2400) AS w, greatest(h, 2400) AS h, round(greatest(w, 2400) * greatest(h, 2400) / 1e6, 6) AS area_km2 FROM (SELECT o_orderkey, sqrt(o_totalprice) * 5 AS w, sqrt(o_totalprice) * 3 AS h FROM orders)")
def inflate(spark, sf):
    o = T.read(spark, sf, "orders").select("o_orderkey", F.greatest(F.sqrt("o_totalprice") * 5, F.lit(2400.0)).alias("w"), F.greatest(F.sqrt("o_totalprice") * 3, F.lit(2400.0)).alias("h"))
    return o.select("*", F.round(F.col("w") * F.col("h") / 1e6, 6).alias("area_km2"))


@query("f7_degree_cells", "SELECT ((floor(lat) + 90) * 360 + floor(lon) + 180)::BIGINT AS cell, count(*) AS n FROM sites GROUP BY 1", ("sites",))
def degree_cells(spark, sf):
    return T.sites(spark, sf).groupBy(X.degree_cell("lon", "lat").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("f8_folded_aspect", "SELECT site_id, round(cos(radians(site_id % 360) - CASE WHEN lat >= 0 THEN pi() ELSE 0 END), 6) AS equatorwardness, round(sin(radians(site_id % 360)), 6) AS eastness, round(sin(radians(site_id % 40)) * cos(radians(site_id % 360) - CASE WHEN lat >= 0 THEN pi() ELSE 0 END), 6) AS slope_x, round((1 - cos(radians(site_id % 360))) / 2, 6) AS northness FROM sites", ("sites",))
def aspect(spark, sf):
    k = F.col("site_id")
    a = T.sites(spark, sf).select("site_id", X.folded_aspect(k % 360, k % 40, F.col("lat")).alias("a"), X.northness01(k % 360).alias("northness"))
    # + 0.0 turns a rounded negative zero into zero
    return a.select("site_id", *[(F.round(F.col(c), 6) + 0.0).alias(n) for c, n in (("a.equatorwardness", "equatorwardness"), ("a.eastness", "eastness"), ("a.slope_x_equatorward", "slope_x"), ("northness", "northness"))])


@query("f12_log_clip", "SELECT o_orderkey, round(ln(o_totalprice), 6) AS lg, round(sqrt(o_totalprice), 6) AS rt, least(greatest(o_totalprice / 100000, 0.5), 3) AS clipped FROM orders")
def log_clip(spark, sf):
    v = F.col("o_totalprice")
    return T.read(spark, sf, "orders").select("o_orderkey", r6(F.ln(v), "lg"), r6(F.sqrt(v), "rt"), F.least(F.greatest(v / 100000, F.lit(0.5)), F.lit(3.0)).alias("clipped"))


SUIT = "CASE coalesce(worldcover, -1) WHEN 10 THEN 0.3 WHEN 20 THEN 0.8 WHEN 30 THEN 0.9 WHEN 40 THEN 0.6 WHEN 50 THEN 0.1 WHEN 60 THEN 1.0 WHEN 70 THEN 0.2 WHEN 80 THEN 0 WHEN 90 THEN 0 WHEN 95 THEN 0 WHEN 100 THEN 0.5 ELSE 0.3 END::DOUBLE"


@query("f13_land_suitability", f"SELECT coalesce(worldcover, -1) AS worldcover, count(*) AS n, round(avg({SUIT}), 6) AS suitability FROM criteria GROUP BY 1", ("criteria",))
def land_suit(spark, sf):
    return T.criteria(spark, sf).groupBy(F.coalesce("worldcover", F.lit(-1)).alias("worldcover")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(X.land_suitability("worldcover")), 6).alias("suitability"))


@query("f14_percentile_flags", """WITH p AS (SELECT country, sc, lo / tn AS pct FROM (""" + profile_sql("scores", "country") + """)) SELECT s.country, count(*) AS n, count(*) FILTER (WHERE pct >= 0.8) AS top20, count(*) FILTER (WHERE pct >= 0.9) AS top10, count(*) FILTER (WHERE pct >= 0.95) AS top5
    FROM scores s JOIN p ON p.country = s.country AND p.sc = s.score WHERE label = 1 GROUP BY s.country""", ("scores",))
def percentile_flags(spark, sf):
    from heliograde.operators.evaluate import site_percentiles

    s = X.top_flags(site_percentiles(T.scores(spark, sf), ["country"], KEYS), "land_pct")
    return s.groupBy("country").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in ("top20", "top10", "top5")])


@query("f15_nested_json", """WITH j AS (SELECT p_partkey, [{'name': 'slope', 'imp': p_size % 10}, {'name': 'grid', 'imp': p_partkey % 10}, {'name': 'road', 'imp': (p_size + p_partkey) % 7}] AS l FROM part)
    SELECT p_partkey, array_to_string(list_transform(list_slice(list_sort(list_transform(l, lambda x: {'k': -x.imp, 'name': x.name})), 1, 2), lambda x: x.name || ' ' || (-x.k)::VARCHAR), ', ') AS top2 FROM j""")
def nested_json(spark, sf):
    """Importances as JSON text, the two largest read back as one line."""
    p, s = F.col("p_partkey"), F.col("p_size")
    item = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("int").alias("imp"))
    doc = T.read(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.array(item("slope", s % 10), item("grid", p % 10), item("road", (s + p) % 7)).alias("importances"))).alias("doc"))
    parsed = doc.select("p_partkey", F.from_json("doc", "importances array<struct<name:string,imp:int>>").getField("importances").alias("i"))
    ordered = F.array_sort(F.transform("i", lambda x: F.struct((-x["imp"]).alias("k"), x["name"].alias("name"), x["imp"].alias("imp"))))
    return parsed.select("p_partkey", F.array_join(F.transform(F.slice(ordered, 1, 2), lambda x: F.concat_ws(" ", x["name"], x["imp"].cast("string"))), ", ").alias("top2"))


# --- joins --------------------------------------------------------------------------------
@query("j1_left_join", "SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_join(spark, sf):
    o, c, n = (T.read(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.join(c.filter("c_acctbal > 0"), o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select("o_orderkey", "c_mktsegment", "n_name")


@query("j2_anti_join", "SELECT site_id, country FROM sites WHERE site_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')", ("sites",))
def anti_join(spark, sf):
    seen = T.read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("site_id"))
    return T.sites(spark, sf).join(seen, "site_id", "left_anti").select("site_id", "country")


@query("j3_training_ids", """WITH t AS (SELECT o_orderkey AS a, o_custkey AS b FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING') SELECT a AS site_id FROM t UNION SELECT b FROM t""")
def training_ids(spark, sf):
    """Members of clusters on the training side, read from their stringified id lists."""
    o = T.read(spark, sf, "orders").select(
        "o_custkey", F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_custkey").cast("string"), F.lit("]")).alias("original_site_ids"))
    train = T.read(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(train, "o_custkey").select(F.explode(X.parse_id_list("original_site_ids")).alias("site_id")).distinct()


@query("j4_coordinate_key_join", """WITH d AS (SELECT round(lon, 5) AS k1, round(lat, 5) AS k2, arg_max(capacity_mw, det_id) AS capacity_mw FROM detectors GROUP BY ALL)
    SELECT s.dense_id, round(capacity_mw, 6) AS capacity_mw FROM dense_sites s LEFT JOIN d ON round(s.lon, 5) = k1 AND round(s.lat, 5) = k2""", ("dense_sites", "detectors"))
def coordinate_join(spark, sf):
    key = lambda: [F.round("lon", 5).alias("k1"), F.round("lat", 5).alias("k2")]
    d = T.detectors(spark, sf).groupBy(*key()).agg(F.max_by("capacity_mw", "det_id").alias("capacity_mw"))
    return T.dense_sites(spark, sf).select("dense_id", *key()).join(d, ["k1", "k2"], "left").select("dense_id", r6("capacity_mw"))


@query("j13_set_coverage", "WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'), b AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n_any")
def coverage(spark, sf):
    a = T.read(spark, sf, "lineitem").filter("l_shipdate >= timestamp_ntz '1998-01-01'").select(F.col("l_orderkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = T.read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    per = a.unionByName(b).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per.agg(F.sum("a").cast("bigint").alias("n_a"), F.sum("b").cast("bigint").alias("n_b"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_both"), F.count(F.lit(1)).alias("n_any"))


@query("j14_pixel_to_cell", "WITH g AS (SELECT site_id AS chip, ((floor(lat) + 90) * 360 + floor(lon) + 180)::BIGINT AS cell FROM sites WHERE area_m2 >= 50000) SELECT p.px_id, coalesce(g.cell, -1) AS cell FROM pixels p LEFT JOIN g USING (chip)", ("sites", "pixels"))
def pixel_cells(spark, sf):
    g = T.sites(spark, sf).filter("area_m2 >= 50000").select(F.col("site_id").alias("chip"), X.degree_cell("lon", "lat").alias("cell"))
    return T.pixels(spark, sf).select("px_id", "chip").join(g, "chip", "left").select("px_id", F.coalesce("cell", F.lit(-1)).alias("cell"))


@query("j16_two_lag_alignment", "WITH t3 AS (SELECT o_orderkey, o_totalprice AS v3 FROM orders WHERE o_orderstatus <> 'P') SELECT s.site_id, s.year - 2 AS t2_year, CASE WHEN s.year - 2 <= 2017 OR v3 IS NULL THEN 't2' ELSE 't3' END AS lag, CASE WHEN s.year - 2 <= 2017 THEN area_m2 ELSE coalesce(v3 * 2, area_m2) END AS value FROM sites s LEFT JOIN t3 ON site_id = o_orderkey", ("sites",))
def two_lags(spark, sf):
    t3 = T.read(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("site_id"), (F.col("o_totalprice") * 2).alias("v3"))
    j = T.sites(spark, sf).select("site_id", (F.col("year") - 2).alias("t2_year"), "area_m2").join(t3, "site_id", "left")
    usable = (F.col("t2_year") > 2017) & F.col("v3").isNotNull()
    return j.select("site_id", "t2_year", F.when(usable, "t3").otherwise("t2").alias("lag"), F.when(usable, F.col("v3")).otherwise(F.col("area_m2")).alias("value"))


@query("j17_cache_coverage", "WITH c AS (SELECT *, count(*) OVER (PARTITION BY site) AS n FROM pool) SELECT CASE WHEN year <= 2019 THEN 'free' WHEN n <= 120 THEN 'covered' ELSE 'need' END AS status, count(*) AS n FROM c GROUP BY 1", ("pool",))
def cache_coverage(spark, sf):
    """Chip sizes come from an aggregation joined back, not from a window over the rows."""
    per = T.pool(spark, sf).groupBy("site", "year").agg(F.count(F.lit(1)).alias("k"))
    size = per.groupBy("site").agg(F.sum("k").alias("size"))
    status = F.when(F.col("year") <= 2019, "free").when(F.col("size") <= 120, "covered").otherwise("need")
    return per.join(size, "site").groupBy(status.alias("status")).agg(F.sum("k").alias("n"))


# --- aggregations ---------------------------------------------------------------------------
@query("a1_year_buckets", "SELECT country, count(*) AS total, count(*) FILTER (WHERE year <= 2018) AS upto_2018, count(*) FILTER (WHERE year >= 2021) AS from_2021, count(*) FILTER (WHERE year = 2022) AS in_2022 FROM sites GROUP BY country HAVING count(*) FILTER (WHERE year >= 2021) >= 50", ("sites",))
def year_buckets(spark, sf):
    y = F.col("year")
    return A.conditional_counts(T.sites(spark, sf), ["country"], {"upto_2018": y <= 2018, "from_2021": y >= 2021, "in_2022": y == 2022}).filter("from_2021 >= 50")


@query("a2_share_and_cumulative", "WITH g AS (SELECT site, count(*) AS n, sum(area) AS mass FROM pool GROUP BY site) SELECT site, mass, n, round(100 * mass / sum(mass) OVER (), 6) AS share_pct, round(100 * sum(mass) OVER (ORDER BY mass DESC, site ROWS UNBOUNDED PRECEDING) / sum(mass) OVER (), 6) AS cum_pct FROM g", ("pool",))
def share(spark, sf):
    return A.shares(T.pool(spark, sf), "site", F.col("area"))


@query("a3_cap_table", "WITH c AS (SELECT site, country, count(*) AS n FROM pool GROUP BY ALL), k AS (SELECT unnest([1, 2, 5, 10, 20]) AS cap) SELECT cap, count(*) FILTER (WHERE n > cap) AS bound, sum(least(n, cap))::BIGINT AS kept, round(100 * sum(least(n, cap)) / sum(n), 6) AS kept_pct FROM c, k GROUP BY cap", ("pool",))
def caps(spark, sf):
    return A.cap_table(T.pool(spark, sf).groupBy("site", "country").agg(F.count(F.lit(1)).alias("n")), "n", [1, 2, 5, 10, 20])


GINI = "WITH c AS (SELECT country, site, count(*) AS n FROM pool GROUP BY ALL), r AS (SELECT country, n, row_number() OVER (PARTITION BY country ORDER BY n, site) AS i, count(*) OVER (PARTITION BY country) AS k FROM c) SELECT country, round(sum((2 * i - k - 1) * n) / nullif(max(k) * sum(n), 0), 6) AS gini FROM r GROUP BY country"


@query("a4_gini", GINI, ("pool",))
def gini(spark, sf):
    return A.gini(T.pool(spark, sf).groupBy("country", "site").agg(F.count(F.lit(1)).alias("n")), ["country"], "n")


@query("a5_distribution", "SELECT o_orderpriority, count(*) AS n, " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 6) AS p{round(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd, round(stddev_pop(o_totalprice) / avg(o_totalprice), 4) AS cv FROM orders GROUP BY o_orderpriority")
def distribution(spark, sf):
    return A.distribution(T.read(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")


@query("a6_ratio_of_sums", "SELECT coalesce(country, -1) AS country, round(sum(power) / sum(area_m2), 6) AS density, round(100 * (sum(clean) - sum(power)) / sum(clean), 6) AS loss_pct FROM generation GROUP BY GROUPING SETS ((country), ())", ("generation",))
def ratio(spark, sf):
    return T.generation(spark, sf).rollup("country").agg(r6(F.sum("power") / F.sum("area_m2"), "density"), r6(100 * (F.sum("clean") - F.sum("power")) / F.sum("clean"), "loss_pct")).fillna(-1, ["country"])


@query("a7_group_medians", "WITH g AS (SELECT country, count(*) AS n, round(quantile_cont(power, 0.5), 6) AS median, round(quantile_cont(power, 0.75) - quantile_cont(power, 0.25), 6) AS iqr FROM generation GROUP BY country), t AS (SELECT * FROM g ORDER BY n DESC, country LIMIT 8) SELECT *, round((SELECT max(median) / min(median) FROM t), 6) AS span FROM t", ("generation",))
def medians(spark, sf):
    g = T.generation(spark, sf)
    n = g.groupBy("country").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "country").limit(8)
    q = R.quantiles(g, ["country"], "power", {"a": 0.25, "m": 0.5, "b": 0.75})
    t = n.join(q, "country").select("country", "n", r6("m", "median"), r6(F.col("b") - F.col("a"), "iqr"))
    return t.transform(R.attach_row, t.agg(r6(F.max("median") / F.min("median"), "span")))


@query("a8_year_totals", "SELECT gen_year, count(DISTINCT pv_id) AS facilities, round(sum(power), 2) AS power FROM generation GROUP BY gen_year", ("generation",))
def year_totals(spark, sf):
    return T.generation(spark, sf).groupBy("gen_year", "pv_id").agg(F.sum("power").alias("p")).groupBy("gen_year").agg(F.count(F.lit(1)).alias("facilities"), F.round(F.sum("p"), 2).alias("power"))


SIZES = [("<1", 0.0, 1.0), ("1-5", 1.0, 5.0), ("5-20", 5.0, 20.0), ("20-100", 20.0, 100.0), ("100+", 100.0, 1e9)]


@query("a9_size_bins", "SELECT CASE " + " ".join(f"WHEN capacity_mw >= {lo} AND capacity_mw < {hi} THEN '{n}'" for n, lo, hi in SIZES) + " END AS size, count(*) AS n, round(quantile_cont(capacity_mw, 0.5), 6) AS median FROM detectors GROUP BY 1", ("detectors",))
def size_bins(spark, sf):
    d = T.detectors(spark, sf).withColumn("size", A.bins(F.col("capacity_mw"), SIZES))
    n = d.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    return n.join(R.quantiles(d, ["size"], "capacity_mw", {"median": 0.5}).withColumn("median", F.round("median", 6)), "size")


@query("a10_latest_non_null", "SELECT pv_id, arg_max(power, o) AS power, arg_max(aerosol_loss, o) FILTER (WHERE aerosol_loss IS NOT NULL) AS aerosol_loss FROM (SELECT *, gen_year * 1000000000::BIGINT + l_orderkey * 10 + l_linenumber AS o FROM generation) GROUP BY pv_id", ("generation",))
def latest(spark, sf):
    g = T.generation(spark, sf).withColumn("o", F.col("gen_year") * F.lit(1000000000).cast("bigint") + F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return I.latest_non_null(g, "pv_id", "o", ["power", "aerosol_loss"])


@query("a11_cluster_metadata", """WITH s AS (SELECT *, site_id // 10 AS cluster_id FROM sites), c AS (SELECT cluster_id, country, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT cluster_id, country FROM c QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, country) = 1)
    SELECT s.cluster_id, count(*) AS num_sites, round(sum(area_m2), 2) AS total_area, min(year) AS target_year, max(m.country) AS country, sum(site_id)::BIGINT AS id_sum FROM s JOIN m USING (cluster_id) GROUP BY s.cluster_id""", ("sites",))
def cluster_metadata(spark, sf):
    from heliograde.operators.gates import cluster_metadata as meta

    s = T.sites(spark, sf).withColumn("cluster_id", F.floor(F.col("site_id") / 10).cast("bigint"))
    m = meta(s, "cluster_id", "site_id")
    return m.select("cluster_id", "num_sites", F.round("total_area", 2).alias("total_area"), "target_year", "country",
                    F.aggregate("original_site_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


@query("a12_scenes_vs_chips", f"WITH p AS ({PARTS}), c AS (SELECT iso3, scene, count(*) AS files FROM p WHERE ok AND kind = 'POS' GROUP BY ALL) SELECT iso3, sum(files)::BIGINT AS chips, count(*) AS scenes, round(avg(files), 6) AS files_per_scene, max(files) AS max_files FROM c GROUP BY iso3", ("chip_names",))
def scenes(spark, sf):
    p = files.read_names(T.chip_names(spark, sf), "chip").filter("ok AND kind = 'POS'")
    per = p.groupBy("iso3", "scene").agg(F.count(F.lit(1)).alias("files"))
    return per.groupBy("iso3").agg(F.sum("files").alias("chips"), F.count(F.lit(1)).alias("scenes"), r6(F.avg("files"), "files_per_scene"), F.max("files").alias("max_files"))


@query("a13_pivot", f"WITH {METRIC} SELECT country, " + ", ".join(f"max(roc) FILTER (WHERE config = {i}) AS cfg_{i}" for i in range(4)) + " FROM m GROUP BY country")
def pivot(spark, sf):
    m = config_metrics(spark, sf)
    return m.groupBy("country").pivot("config", [0, 1, 2, 3]).agg(F.max("roc")).select("country", *[F.col(str(i)).alias(f"cfg_{i}") for i in range(4)])


@query("a14_weighted_macro_robust", f"WITH {METRIC} SELECT config, round(sum(roc * n) / sum(n), 6) AS weighted, round(avg(roc), 6) AS macro, round(avg(roc) FILTER (WHERE country NOT IN ('C1', 'C2')), 6) AS robust FROM m GROUP BY config")
def means(spark, sf):
    return config_metrics(spark, sf).groupBy("config").agg(r6(F.sum(F.col("roc") * F.col("n")) / F.sum("n"), "weighted"), r6(F.avg("roc"), "macro"), r6(F.avg(F.when(~F.col("country").isin("C1", "C2"), F.col("roc"))), "robust"))


@query("a15_main_effects", """WITH s AS (SELECT pool, config % 2 AS knob_a, config // 2 AS knob_b, config, avg(value) AS v FROM results_log GROUP BY ALL), r AS (SELECT pool, v AS ref FROM s WHERE config = 0), d AS (SELECT s.*, v - ref AS delta FROM s JOIN r USING (pool) WHERE config <> 0)
    SELECT CASE WHEN knob_a IS NULL THEN 'knob_b' ELSE 'knob_a' END AS knob, coalesce(knob_a, knob_b) AS setting, count(*) AS n, round(avg(delta), 6) AS mean_delta FROM d GROUP BY GROUPING SETS ((knob_a), (knob_b))""", ("results_log",))
def main_effects(spark, sf):
    from heliograde.operators.gates import main_effects as effects

    s = T.results_log(spark, sf).groupBy("pool", "config").agg(F.avg("value").alias("v"))
    s = s.select("*", (F.col("config") % 2).alias("knob_a"), F.floor(F.col("config") / 2).cast("bigint").alias("knob_b"))
    return effects(s, "pool", "v", F.col("config") == 0, ["knob_a", "knob_b"])


@query("a16_spread", "SELECT scope, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM results_log GROUP BY scope", ("results_log",))
def spread(spark, sf):
    return T.results_log(spark, sf).groupBy("scope").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), r6(F.avg("value"), "mean"), F.count(F.lit(1)).alias("n"), r6(F.max("value") - F.min("value"), "spread"))


@query("a17_between_class_variance", "WITH t AS (SELECT avg(score) AS m, sum(score) AS s FROM criteria), c AS (SELECT coalesce(worldcover, -1) AS wc, count(*) AS n, avg(score) AS m FROM criteria GROUP BY 1) SELECT (SELECT count(*) FROM criteria) AS n, round(sum(c.n * (c.m - t.m) * (c.m - t.m)) / (SELECT var_pop(score) * count(*) FROM criteria), 6) AS eta_squared FROM c, t", ("criteria",))
def eta(spark, sf):
    return A.between_share(T.criteria(spark, sf).withColumn("wc", F.coalesce("worldcover", F.lit(-1))), "wc", "score")


@query("a17_class_profile", "SELECT worldcover, count(*) AS n, round(quantile_cont(score, 0.5), 6) AS median, round(avg(score), 6) AS mean FROM criteria WHERE worldcover IS NOT NULL GROUP BY worldcover", ("criteria",))
def class_profile(spark, sf):
    c = T.criteria(spark, sf).filter("worldcover IS NOT NULL")
    n = c.groupBy("worldcover").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score"), "mean"))
    return n.join(R.quantiles(c, ["worldcover"], "score", {"median": 0.5}, (0.0, 1.0)).withColumn("median", F.round("median", 6)), "worldcover")


@query("a21_importance_rollup", "SELECT regexp_replace(name, '_[0-9]+$', '') AS parent, round(sum(v), 6) AS importance FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'worldcover_' || (l_partkey % 11 * 10) ELSE 'slope' END AS name, l_discount AS v FROM lineitem) GROUP BY 1")
def importance_rollup(spark, sf):
    l = T.read(spark, sf, "lineitem")
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("worldcover_"), (F.col("l_partkey") % 11 * 10).cast("string"))).otherwise(F.lit("slope"))
    return l.groupBy(F.regexp_replace(name, "_[0-9]+$", "").alias("parent")).agg(r6(F.sum("l_discount"), "importance"))


@query("w9_within_group_z", """WITH s AS (SELECT pv_id, country, power / area_m2 AS y FROM generation), g AS (SELECT country, count(*) AS n, avg(y) AS m, stddev_pop(y) AS sd FROM s GROUP BY country) SELECT country, count(*) AS n, round(max(CASE WHEN g.n > 2 AND sd > 0 THEN (y - m) / sd END), 5) AS z_max, round(min(CASE WHEN g.n > 2 AND sd > 0 THEN (y - m) / sd END), 5) AS z_min FROM s JOIN g USING (country) GROUP BY country""", ("generation",))
def z_scores(spark, sf):
    from heliograde.operators.gates import group_z

    z = group_z(T.generation(spark, sf).withColumn("y", F.col("power") / F.col("area_m2")), "country", "y", "z")
    return z.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("z"), 5).alias("z_max"), F.round(F.min("z"), 5).alias("z_min"))


@query("m18_log_log_slope", "SELECT country, round(regr_slope(ln(power), ln(area_m2)), 6) AS slope, round(regr_intercept(ln(power), ln(area_m2)), 6) AS intercept, round(regr_r2(ln(power), ln(area_m2)), 6) AS r2 FROM generation WHERE power > 0 AND area_m2 > 0 GROUP BY country", ("generation",))
def log_log(spark, sf):
    g = T.generation(spark, sf).filter("power > 0 AND area_m2 > 0")
    y, x = F.ln("power"), F.ln("area_m2")
    return g.groupBy("country").agg(r6(F.regr_slope(y, x), "slope"), r6(F.regr_intercept(y, x), "intercept"), r6(F.regr_r2(y, x), "r2"))


# --- top lists and set operations --------------------------------------------------------------
@query("l1_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf):
    return T.read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("l2_best_feasible", """WITH s AS (SELECT pool, config AS tag, round(avg(value), 6) AS val_roc, count(*) % 3 <> 0 AS feasible FROM results_log GROUP BY ALL), b AS (SELECT pool, tag, val_roc, 'best' AS pick FROM s WHERE feasible QUALIFY row_number() OVER (PARTITION BY pool ORDER BY val_roc DESC, tag DESC) = 1),
    u AS (SELECT * FROM b UNION ALL SELECT pool, tag, val_roc, 'incumbent' FROM s WHERE tag = 0) SELECT pool, tag, val_roc, min(pick) AS pick FROM u GROUP BY ALL""", ("results_log",))
def best_feasible(spark, sf):
    s = T.results_log(spark, sf).groupBy("pool", F.col("config").alias("tag")).agg(r6(F.avg("value"), "val_roc"), (F.count(F.lit(1)) % 3 != 0).alias("feasible"))
    return A.best_feasible(s, "pool", "val_roc", "tag", F.col("feasible"), F.col("tag") == 0)


CHIPS = """WITH c AS (SELECT site AS chip, country, count(*) AS n, avg(label) AS mfrac, avg(s) FILTER (WHERE label = 1) AS pin, avg(s) FILTER (WHERE label = 0) AS pbg, stddev_pop(s) AS pstd, avg((s > 0.6)::INTEGER) AS phi
    FROM (SELECT *, ((l_partkey * 31 + l_suppkey) % 1000) / 1000.0::DOUBLE AS s FROM pool) GROUP BY ALL), k AS (SELECT *, round(pin - pbg, 6) AS contrast FROM c WHERE mfrac BETWEEN 0.2 AND 0.5)"""


def chip_stats(spark, sf):
    from heliograde.operators.gates import chip_contrast

    p = T.pool(spark, sf).withColumn("s", ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % 1000) / 1000.0)
    return chip_contrast(p, ["site", "country"], "s", "label", 0.2, 0.5).withColumnRenamed("site", "chip")


@query("l5_top_contrast", CHIPS + " SELECT chip, country, contrast, n FROM k ORDER BY contrast DESC, chip, country LIMIT 9", ("pool",))
def top_contrast(spark, sf):
    return chip_stats(spark, sf).select("chip", "country", "contrast", "n").filter("contrast IS NOT NULL").orderBy(F.desc("contrast"), "chip", "country").limit(9)


@query("l6_diversified_top_k", CHIPS + """, r AS (SELECT chip, country, round(pin - pbg + 1.3 * pstd + 0.4 * phi, 6) AS rank FROM k WHERE contrast IS NOT NULL), d AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY rank DESC, chip) AS rn FROM r)
    SELECT chip, country, rank FROM d WHERE rn <= 3 ORDER BY rank DESC, chip LIMIT 24""", ("pool",))
def diversified(spark, sf):
    c = chip_stats(spark, sf).filter("contrast IS NOT NULL")
    r = c.select("chip", "country", F.round(F.col("pin") - F.col("pbg") + 1.3 * F.col("pstd") + 0.4 * F.col("phi"), 6).alias("rank"))
    return A.diversified_top(r, "country", "chip", "rank", 3, 24)


@query("u1_union_with_source", "SELECT 'pvfac' AS source, count(*) AS n FROM sites UNION ALL SELECT 'tz', count(*) FROM detectors UNION ALL SELECT 'neg', count(*) FROM dense_sites", ("sites", "detectors", "dense_sites"))
def union_sources(spark, sf):
    tag = lambda d, s: d.select(F.lit(s).alias("source"), "lon", "lat")
    u = tag(T.sites(spark, sf), "pvfac").unionByName(tag(T.detectors(spark, sf), "tz")).unionByName(tag(T.dense_sites(spark, sf), "neg"))
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("u2_overlapping_subsets", "SELECT u.set, count(*) AS n, sum(label)::BIGINT AS n_pos FROM scores, (VALUES ('inventory'), ('tzsam'), ('combined')) u(set) WHERE u.set = 'combined' OR (u.set = 'inventory' AND source <> 'tz') OR (u.set = 'tzsam' AND source <> 'pvfac') GROUP BY u.set", ("scores",))
def subsets(spark, sf):
    from heliograde.operators.evaluate import in_subsets

    return in_subsets(T.scores(spark, sf)).groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"))


@query("u3_missing_countries", "SELECT DISTINCT country FROM sites WHERE country NOT IN (SELECT country FROM detectors WHERE capacity_mw > 98)", ("sites", "detectors"))
def missing(spark, sf):
    d = T.detectors(spark, sf).filter("capacity_mw > 98").select("country")
    return T.sites(spark, sf).select("country").distinct().join(d, "country", "left_anti")


@query("u4_in_all_pools", "SELECT scope FROM results_log WHERE value > 120 GROUP BY scope HAVING count(DISTINCT pool) = 3", ("results_log",))
def in_all(spark, sf):
    return T.results_log(spark, sf).filter("value > 120").groupBy("scope").agg(F.countDistinct("pool").alias("k")).filter("k = 3").select("scope")


@query("u5_supplement", "SELECT dense_id AS id, 'own' AS origin, lon, lat FROM dense_sites UNION ALL SELECT det_id, 'new', lon, lat FROM detectors WHERE nn_m > 1000", ("dense_sites", "detectors"))
def supplement(spark, sf):
    own = T.dense_sites(spark, sf).select(F.col("dense_id").alias("id"), F.lit("own").alias("origin"), "lon", "lat")
    return own.unionByName(T.detectors(spark, sf).filter("nn_m > 1000").select(F.col("det_id").alias("id"), F.lit("new").alias("origin"), "lon", "lat"))


# --- records of earlier runs --------------------------------------------------------------------
@query("e29_reproduction_check", """WITH a AS (SELECT experiment, scope, round(avg(value), 5) AS recorded FROM results_log WHERE value <= 90 GROUP BY ALL), b AS (SELECT experiment, scope, round(avg(value), 5) AS recomputed FROM results_log GROUP BY ALL)
    SELECT experiment, scope, recorded, recomputed, round(recomputed - recorded, 5) AS diff, abs(recomputed - recorded) < 0.5 AS matches FROM a JOIN b USING (experiment, scope)""", ("results_log",))
def reproduction(spark, sf):
    log = T.results_log(spark, sf)
    avg = lambda d, n: d.groupBy("experiment", "scope").agg(F.round(F.avg("value"), 5).alias(n))
    j = avg(log.filter("value <= 90"), "recorded").join(avg(log, "recomputed"), ["experiment", "scope"])
    d = F.col("recomputed") - F.col("recorded")
    return j.select("*", F.round(d, 5).alias("diff"), (F.abs(d) < 0.5).alias("matches"))


@query("e30_inferred_row", """WITH t AS (SELECT scope, pool, config % 2 AS lag, max(value) AS v FROM results_log GROUP BY ALL), b AS (SELECT scope, v FROM t WHERE pool = 1 AND lag = 0), x AS (SELECT scope, max(v) FILTER (WHERE lag = 1) - max(v) FILTER (WHERE lag = 0) AS d FROM t WHERE pool = 0 GROUP BY scope)
    SELECT scope, 'measured' AS kind, v FROM b UNION ALL SELECT scope, 'inferred', round(b.v + d, 4) FROM b JOIN x USING (scope)""", ("results_log",))
def inferred(spark, sf):
    t = T.results_log(spark, sf).groupBy("scope", "pool", (F.col("config") % 2).alias("lag")).agg(F.max("value").alias("v"))
    at = lambda p, l: F.max(F.when((F.col("pool") == p) & (F.col("lag") == l), F.col("v")))
    w = t.groupBy("scope").agg(at(1, 0).alias("b"), (at(0, 1) - at(0, 0)).alias("d"))
    rows = F.array(F.struct(F.lit("measured").alias("kind"), F.col("b").alias("v")), F.struct(F.lit("inferred").alias("kind"), F.round(F.col("b") + F.col("d"), 4).alias("v")))
    return w.select("scope", F.inline(rows)).filter("v IS NOT NULL")


@query("e32_score_equivalence", "SELECT count(*) AS n, round(max(abs(score - score_b)), 6) AS max_abs, round(avg(abs(score - score_b)), 6) AS mean_abs, round(corr(score, score_b), 6) AS correlation FROM scores WHERE score IS NOT NULL", ("scores",))
def equivalence(spark, sf):
    d = F.abs(F.col("score") - F.col("score_b"))
    return T.scores(spark, sf).filter("score IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), r6(F.max(d), "max_abs"), r6(F.avg(d), "mean_abs"), r6(F.corr("score", "score_b"), "correlation"))


@query("e33_shortlist_vs_incumbent", f"""WITH {METRIC}, inc AS (SELECT country, roc AS published FROM m WHERE config = 0) SELECT config, round(sum(n * (roc - published)) / sum(n), 6) AS weighted_delta, count(*) FILTER (WHERE roc > published) AS wins FROM m JOIN inc USING (country) WHERE config <> 0 GROUP BY config""")
def shortlist(spark, sf):
    m = config_metrics(spark, sf)
    inc = m.filter("config = 0").select("country", F.col("roc").alias("published"))
    j = m.filter("config <> 0").join(inc, "country")
    return j.groupBy("config").agg(r6(F.sum(F.col("n") * (F.col("roc") - F.col("published"))) / F.sum("n"), "weighted_delta"), F.count_if(F.col("roc") > F.col("published")).alias("wins"))
