"""The workflow's tables as views over the benchmark star schema, once as DataFrames, once as SQL.

Both definitions use the same integer and double arithmetic so that results can be compared
row by row between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Site inventory: one row per order."""
    o, c, n = (read(spark, sf, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .select(
            k.alias("site_id"), F.col("n_name").alias("country"), (F.year("o_orderdate") + 22).alias("year"),
            F.col("o_totalprice").alias("area_m2"),
            (((k * 7919) % 36000) / 100.0 - 180).alias("lon"), (((k * 104729) % 12800) / 100.0 - 56).alias("lat"),
        )
    )


def detectors(spark: SparkSession, sf: str) -> DataFrame:
    """External detector sites in a dense 2 x 2 degree box: one row per customer."""
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    k = F.col("c_custkey")
    date = lambda shift: F.concat_ws(
        "-", (F.lit(2017) + k % 7 + shift).cast("string"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("15T00:00:00")
    )
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        k.alias("det_id"), F.col("n_name").alias("country"),
        (F.lit(10) + ((k * 6007) % 2000) / 1000.0).alias("lon"), (F.lit(40) + ((k * 15013) % 2000) / 1000.0).alias("lat"),
        (F.abs("c_acctbal") / 100).alias("capacity_mw"),
        F.when(k % 41 == 0, None).when(k % 43 == 0, F.lit("unknown")).otherwise(date(F.lit(0))).alias("constructed_after"),
        F.when(k % 37 == 0, None).otherwise(date(k % 3)).alias("constructed_before"),
        ((k * 37) % 5000).cast("double").alias("nn_m"),
    )


def dense_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Inventory sites in the same dense box: one row per supplier."""
    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(
        k.alias("dense_id"), F.col("s_nationkey").alias("nation"),
        (F.lit(10) + ((k * 7919) % 2000) / 1000.0).alias("lon"), (F.lit(40) + ((k * 104729) % 2000) / 1000.0).alias("lat"),
        (F.lit(2017) + k % 7).cast("int").alias("year"),
    )


def scattered(spark: SparkSession, sf: str) -> DataFrame:
    """Irregularly spread sites in the dense box: one row per customer."""
    k = F.col("c_custkey")
    return read(spark, sf, "customer").select(
        k.alias("site_id"), (F.lit(10) + ((k * k * 31 + k * 17) % 1999) / 1000.0).alias("lon"), (F.lit(40) + ((k * k * 57 + k * 91) % 1997) / 1000.0).alias("lat")
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scored points: sites of two sources and random land, many tied scores, some NULL."""
    l = read(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    return l.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.concat(F.lit("C"), (F.col("l_suppkey") % 13).cast("string")).alias("country"),
        F.when(k % 97 == 0, None).otherwise((F.floor("l_extendedprice") % 1000) / 1000.0).alias("score"),
        ((F.floor("l_extendedprice") * 7 + F.col("l_partkey")) % 1000 / 1000.0).alias("score_b"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when(F.col("l_returnflag") != "R", F.lit("neg")).when(F.col("l_linenumber") % 2 == 0, F.lit("tz")).otherwise(F.lit("pvfac")).alias("source"),
        (F.year("l_shipdate") + 22).alias("year"), F.col("l_quantity").alias("capacity"),
    )


def criteria(spark: SparkSession, sf: str) -> DataFrame:
    """Points with MCDA criteria; road is missing on some rows, popdens on a whole country."""
    l = read(spark, sf, "lineitem")
    k, c = F.col("l_orderkey"), F.col("l_suppkey") % 13
    return l.select(
        k, "l_partkey", "l_suppkey", "l_linenumber", F.concat(F.lit("C"), c.cast("string")).alias("country"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when(F.col("l_returnflag") != "R", F.lit("neg")).when(F.col("l_linenumber") % 2 == 0, F.lit("tz")).otherwise(F.lit("pvfac")).alias("source"),
        ((F.floor("l_extendedprice") % 1000) / 1000.0).alias("score"),
        F.col("l_extendedprice").alias("ghi"), (F.col("l_partkey") % 701).cast("double").alias("pvout"),
        (F.col("l_suppkey") * 1.5).alias("gti"), (k % 41).cast("double").alias("temp"), F.col("l_quantity").alias("slope"),
        (F.col("l_partkey") * 1.25).alias("elevation"), (F.col("l_linenumber") / 8.0 - 0.5).alias("aspect"),
        F.when(k % 37 == 0, None).otherwise((k % 9973).cast("double")).alias("road"),
        (F.col("l_discount") * 100000).alias("grid"),
        F.when(c == 5, None).otherwise((F.col("l_partkey") % 359).cast("double")).alias("popdens"),
        F.when(F.col("l_partkey") % 53 == 0, None).otherwise((F.col("l_partkey") % 11) * 10).cast("int").alias("worldcover"),
        (F.col("l_tax") * 10).alias("wdpa"),
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding pixels."""
    k = F.col("vec_id")
    return read(spark, sf, "embeddings").select(
        k.alias("px_id"), F.floor(k / 25).cast("bigint").alias("chip"), F.concat(F.lit("C"), (F.col("label") % 5).cast("string")).alias("iso3"),
        (F.lit(2017) + k % 6).cast("int").alias("year"), F.when(F.col("label") < 5, 1).otherwise(0).alias("label"),
        F.col("embedding").alias("emb"),
    )


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """Large pixel-like pool for caps, budgets and splits."""
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_suppkey") % 20).alias("country"),
        (F.col("l_partkey") % 50).alias("cell"), (F.col("l_orderkey") % 500).alias("site"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), F.col("l_quantity").alias("area"),
        (F.year("l_shipdate") + 22).alias("year"),
    )


def generation(spark: SparkSession, sf: str) -> DataFrame:
    """Generation facts by facility and year."""
    return read(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("pv_id"), (F.col("l_suppkey") % 13).alias("country"), (F.year("l_shipdate") + 22).alias("gen_year"),
        F.col("l_quantity").alias("area_m2"), F.col("l_extendedprice").alias("power"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("clean"),
        F.when(F.col("l_orderkey") % 3 == 0, None).otherwise(F.col("l_extendedprice") * F.col("l_tax")).alias("aerosol_loss"),
        "l_orderkey", "l_linenumber",
    )


def chip_names(spark: SparkSession, sf: str) -> DataFrame:
    """Chip file names, a few malformed."""
    k = F.col("p_partkey")
    good = F.concat(
        F.when(k % 4 == 3, F.lit("NEG_")).otherwise(F.lit("POS_")), F.upper(F.substring("p_name", 1, 3)), F.lit("_"), (k / 3).cast("bigint").cast("string"),
        F.lit("_"), (F.lit(2017) + F.col("p_size") % 6).cast("string"), F.lit("_"), F.col("p_size").cast("string"), F.lit(".tif"),
    )
    return read(spark, sf, "part").select(k.alias("chip_id"), F.when(k % 50 == 0, F.concat(F.lit("bad_"), k.cast("string"))).otherwise(good).alias("chip"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """A raster as a table, 100 columns wide, as many rows as the orders fill."""
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        F.floor(k / 100).cast("bigint").alias("ri"), (k % 100).alias("ci"), (F.floor("o_totalprice") % 1000 / 1000.0).alias("value"),
        ((F.floor("o_totalprice") * 3) % 1000 / 1000.0).alias("value_b"),
    )


def results_log(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows derived from the event table."""
    return read(spark, sf, "events").select(
        F.col("event_type").alias("experiment"), (F.col("user_id") % 50).alias("scope"), (F.col("event_id") % 7).alias("config"),
        (F.col("event_id") % 3).alias("pool"), "value", "ts", F.col("event_id"), F.col("props"),
    )


SQL = {
    "sites": """SELECT o_orderkey AS site_id, n_name AS country, (year(o_orderdate) + 22)::INTEGER AS year, o_totalprice AS area_m2,
        ((o_orderkey * 7919) % 36000) / 100.0::DOUBLE - 180 AS lon, ((o_orderkey * 104729) % 12800) / 100.0::DOUBLE - 56 AS lat
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "detectors": """SELECT c_custkey AS det_id, n_name AS country, 10 + ((c_custkey * 6007) % 2000) / 1000.0::DOUBLE AS lon,
        40 + ((c_custkey * 15013) % 2000) / 1000.0::DOUBLE AS lat, abs(c_acctbal) / 100 AS capacity_mw,
        CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 43 = 0 THEN 'unknown' ELSE
          (2017 + c_custkey % 7)::VARCHAR || '-' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || '-15T00:00:00' END AS constructed_after,
        CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE
          (2017 + c_custkey % 7 + c_custkey % 3)::VARCHAR || '-' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || '-15T00:00:00' END AS constructed_before,
        ((c_custkey * 37) % 5000)::DOUBLE AS nn_m FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "dense_sites": """SELECT s_suppkey AS dense_id, s_nationkey AS nation, 10 + ((s_suppkey * 7919) % 2000) / 1000.0::DOUBLE AS lon,
        40 + ((s_suppkey * 104729) % 2000) / 1000.0::DOUBLE AS lat, (2017 + s_suppkey % 7)::INTEGER AS year FROM supplier""",
    "scattered": """SELECT c_custkey AS site_id, 10 + ((c_custkey * c_custkey * 31 + c_custkey * 17) % 1999) / 1000.0::DOUBLE AS lon,
        40 + ((c_custkey * c_custkey * 57 + c_custkey * 91) % 1997) / 1000.0::DOUBLE AS lat FROM customer""",
    "scores": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'C' || (l_suppkey % 13)::VARCHAR AS country,
        CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE (floor(l_extendedprice)::BIGINT % 1000) / 1000.0::DOUBLE END AS score,
        ((floor(l_extendedprice)::BIGINT * 7 + l_partkey) % 1000) / 1000.0::DOUBLE AS score_b,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
        CASE WHEN l_returnflag <> 'R' THEN 'neg' WHEN l_linenumber % 2 = 0 THEN 'tz' ELSE 'pvfac' END AS source,
        (year(l_shipdate) + 22)::INTEGER AS year, l_quantity AS capacity FROM lineitem""",
    "criteria": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'C' || (l_suppkey % 13)::VARCHAR AS country,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
        CASE WHEN l_returnflag <> 'R' THEN 'neg' WHEN l_linenumber % 2 = 0 THEN 'tz' ELSE 'pvfac' END AS source,
        (floor(l_extendedprice)::BIGINT % 1000) / 1000.0::DOUBLE AS score,
        l_extendedprice AS ghi, (l_partkey % 701)::DOUBLE AS pvout, l_suppkey * 1.5::DOUBLE AS gti, (l_orderkey % 41)::DOUBLE AS temp,
        l_quantity AS slope, l_partkey * 1.25::DOUBLE AS elevation, l_linenumber / 8.0::DOUBLE - 0.5::DOUBLE AS aspect,
        CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE (l_orderkey % 9973)::DOUBLE END AS road, l_discount * 100000 AS grid,
        CASE WHEN l_suppkey % 13 = 5 THEN NULL ELSE (l_partkey % 359)::DOUBLE END AS popdens,
        CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE ((l_partkey % 11) * 10)::INTEGER END AS worldcover, l_tax * 10 AS wdpa FROM lineitem""",
    "pixels": """SELECT vec_id AS px_id, vec_id // 25 AS chip, 'C' || (label % 5)::VARCHAR AS iso3, (2017 + vec_id % 6)::INTEGER AS year,
        CASE WHEN label < 5 THEN 1 ELSE 0 END AS label, embedding::DOUBLE[] AS emb FROM embeddings""",
    "pool": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_suppkey % 20 AS country, l_partkey % 50 AS cell, l_orderkey % 500 AS site,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_quantity AS area, (year(l_shipdate) + 22)::INTEGER AS year FROM lineitem""",
    "generation": """SELECT l_partkey AS pv_id, l_suppkey % 13 AS country, (year(l_shipdate) + 22)::INTEGER AS gen_year, l_quantity AS area_m2,
        l_extendedprice AS power, l_extendedprice * (1 + l_tax) AS clean,
        CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_extendedprice * l_tax END AS aerosol_loss, l_orderkey, l_linenumber FROM lineitem""",
    "chip_names": """SELECT p_partkey AS chip_id, CASE WHEN p_partkey % 50 = 0 THEN 'bad_' || p_partkey::VARCHAR ELSE
        (CASE WHEN p_partkey % 4 = 3 THEN 'NEG_' ELSE 'POS_' END) || upper(substring(p_name, 1, 3)) || '_' || (p_partkey // 3)::VARCHAR || '_'
        || (2017 + p_size % 6)::VARCHAR || '_' || p_size::VARCHAR || '.tif' END AS chip FROM part""",
    "grid": """SELECT o_orderkey // 100 AS ri, o_orderkey % 100 AS ci, (floor(o_totalprice)::BIGINT % 1000) / 1000.0::DOUBLE AS value,
        ((floor(o_totalprice)::BIGINT * 3) % 1000) / 1000.0::DOUBLE AS value_b FROM orders""",
    "results_log": """SELECT event_type AS experiment, user_id % 50 AS scope, event_id % 7 AS config, event_id % 3 AS pool, value, ts, event_id, props FROM events""",
}


def sql(body: str, *names: str) -> str:
    """``body`` with the named views as leading CTEs."""
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    if not names:
        return body
    b = body.strip()
    return f"WITH {ctes}, {b[5:]}" if b.upper().startswith("WITH ") else f"WITH {ctes} {b}"
