"""Readers and writers: CSV by year, name tables, JSON reports, metric and stage logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograde.functions.scalars import parse_chip_name

# Fixed format of the generation files, one per year.
GENERATION_SCHEMA = T.StructType([
    T.StructField("PV_ID", T.LongType()), T.StructField("country", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("year", T.IntegerType()), T.StructField("area_m2", T.DoubleType()),
    T.StructField("power_POA (kWh)", T.DoubleType()), T.StructField("power_POA_clr (kWh)", T.DoubleType()),
    T.StructField("power_POA_cln (kWh)", T.DoubleType()), T.StructField("aerosol_loss (kWh)", T.DoubleType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: list[str] | None = None) -> DataFrame:
    """CSV with header; only ``columns`` are parsed when given."""
    df = spark.read.csv(path, header=True, schema=schema)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def read_yearly(spark: SparkSession, pattern: str, schema: T.StructType | str, columns: list[str] | None = None) -> DataFrame:
    """Files whose names, or whose folders' names, end in a year, read together with that year as ``gen_year`` (null without one)."""
    df = read_csv(spark, pattern, schema, None)
    year = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4})(?:\.csv)?(?:/part-[^/]*)?$", 1)
    kept = [f"`{c}`" for c in columns] if columns else ["*"]
    return df.select(*kept, F.nullif(year, F.lit("")).cast("int").alias("gen_year"))


def read_names(names: DataFrame, column: str) -> DataFrame:
    """Parsed chip names next to the raw one; malformed names stay, with NULL parts and ``ok`` false."""
    return names.select(column, parse_chip_name(column).alias("p")).select(
        column, "p.*", F.col("p.kind").isNotNull().alias("ok")
    )


BAD = "_corrupt_record"


def read_json_reports(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = False) -> DataFrame:
    """One row for each JSON document: one document a file, or one a line. A document that cannot be read has nulls and its text in ``_corrupt_record``."""
    df = spark.read.option("columnNameOfCorruptRecord", BAD).option("multiLine", str(not lines).lower())
    kind = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.schema(f"{kind}, {BAD} string").json(path)


def roll_up(reports: DataFrame, ident: str, entries: str, aggs: list) -> DataFrame:
    """One row for each report: its id and aggregates over its array of structs; a report with a missing or empty array has one row of nulls."""
    return reports.select(ident, F.inline_outer(entries)).groupBy(ident).agg(*aggs)


def write_rows_csv(df: DataFrame, path: str) -> None:
    """CSV with header, a file for each task."""
    df.write.option("header", "true").csv(path)


def write_sorted_csv(df: DataFrame, path: str, order: list) -> None:
    """Globally sorted CSV: range partitioned by the order, sorted inside each file."""
    df.orderBy(*order).write.mode("overwrite").option("header", "true").csv(path)


def site_feature(name: str = "name", country: str = "country", year: str = "year", box: str = "box"):
    """GeoJSON feature text of a site with its box as bounds and ring."""
    b = F.col(box)
    corner = lambda x, y: F.array(b[x], b[y])
    ring = F.array(
        corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny")
    )
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.concat(F.col(name), F.lit(".tif")).alias("old_filename"), F.concat(F.col(name), F.lit(".tif")).alias("new_filename"),
            F.col(country).alias("country"), F.col(year).cast("int").alias("target_year"),
            F.array(b["minx"], b["miny"], b["maxx"], b["maxy"]).alias("bounds"),
        ).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    ))
