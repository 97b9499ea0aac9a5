"""Scalar rules of the suitability workflow, each a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres per degree of latitude, first imagery year, nodata markers.
METRES_PER_DEGREE = 111320.0
FIRST_IMAGERY_YEAR = 2017
LAST_IMAGERY_YEAR = 2022
NODATA_CODES = (-999.0, -1.0)
NODATA_FLOOR = -1e30

# Land-cover class -> suitability; anything else, and no class, gets the default.
LAND_SUITABILITY = {
    10: 0.3, 20: 0.8, 30: 0.9, 40: 0.6, 50: 0.1, 60: 1.0, 70: 0.2, 80: 0.0, 90: 0.0, 95: 0.0, 100: 0.5,
}
LAND_DEFAULT = 0.3
EXCLUDED_LAND = (80, 90)

CHIP_NAME = r"^(POS|NEG)_([A-Z]{3})_(\d+)_(\d{4})(?:_(\d+))?\.tif$"


def _c(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def imagery_year(install_year: Column | str, lag: int = 2) -> Column:
    """Imagery ``lag`` years before installation, never before the first imagery year."""
    return F.greatest(_c(install_year) - lag, F.lit(FIRST_IMAGERY_YEAR))


def redraw_year(year: Column | str, draw: Column) -> Column:
    """Keep a year inside the imagery range; redraw it from ``draw`` (an integer hash) otherwise."""
    span = LAST_IMAGERY_YEAR - FIRST_IMAGERY_YEAR + 1
    y = _c(year)
    return F.when(y.between(FIRST_IMAGERY_YEAR, LAST_IMAGERY_YEAR), y).otherwise(
        (F.pmod(draw, F.lit(span)) + FIRST_IMAGERY_YEAR).cast("int")
    )


def chip_name(prefix: str, country: Column, ident: Column, year: Column) -> Column:
    """``POS_XYZ_<id>_<year>.tif`` with a three-letter country part free of spaces."""
    code = F.replace(F.upper(F.substring(country, 1, 3)), F.lit(" "), F.lit(""))
    return F.concat_ws("_", F.lit(prefix), code, ident.cast("string"), F.concat(year.cast("string"), F.lit(".tif")))


def parse_chip_name(name: Column | str) -> Column:
    """Struct of name parts; every field NULL when the name does not follow the format."""
    n = _c(name)
    ok = n.rlike(CHIP_NAME)
    part = lambda i: F.when(ok, F.nullif(F.regexp_extract(n, CHIP_NAME, i), F.lit("")))
    return F.struct(
        part(1).alias("kind"),
        part(2).alias("iso3"),
        part(3).cast("bigint").alias("scene"),
        part(4).cast("int").alias("year"),
        part(5).cast("int").alias("tile"),
    )


def slug(name: Column | str) -> Column:
    return F.replace(F.lower(_c(name)), F.lit(" "), F.lit("_"))


def parse_id_list(text: Column | str) -> Column:
    """Every run of digits in a stringified list, tuple or delimited text, as array<bigint>."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(r"(\d+)"), F.lit(1)), lambda s: s.cast("bigint"))


def iso_date(text: Column | str) -> Column:
    """The date in the first ten characters, NULL where they are no date."""
    return F.expr("try_to_timestamp(substring({0}, 1, 10), 'yyyy-MM-dd')".format(text)).cast("date") if isinstance(
        text, str
    ) else F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def date_year(text: Column | str) -> Column:
    return F.year(iso_date(text))


def utm_epsg(lon: Column | str, lat: Column | str) -> Column:
    """EPSG code of the UTM zone, zone clamped to 1..60."""
    zone = F.least(F.greatest(F.floor((_c(lon) + 180.0) / 6.0).cast("int") + 1, F.lit(1)), F.lit(60))
    return zone + F.when(_c(lat) >= 0, 32600).otherwise(32700)


def degree_cell(lon: Column | str, lat: Column | str) -> Column:
    """Id of the 1 x 1 degree cell."""
    return ((F.floor(_c(lat)) + 90) * 360 + F.floor(_c(lon)) + 180).cast("bigint")


def pad_box(lon: Column, lat: Column, half_metres: float | Column) -> Column:
    """Box of +-half_metres around a point, in degrees."""
    m = half_metres if isinstance(half_metres, Column) else F.lit(float(half_metres))
    dlat = m / METRES_PER_DEGREE
    dlon = m / (F.cos(F.radians(lat)) * METRES_PER_DEGREE)
    return F.struct(
        (lon - dlon).alias("minx"), (lat - dlat).alias("miny"), (lon + dlon).alias("maxx"), (lat + dlat).alias("maxy")
    )


def without_nodata(v: Column | str, codes: tuple[float, ...] = NODATA_CODES) -> Column:
    """NULL for nodata codes, very low fill values and NaN."""
    x = _c(v)
    return F.when(x.isin(*codes) | (x < NODATA_FLOOR) | F.isnan(x), None).otherwise(x)


def land_suitability(cover: Column | str) -> Column:
    """Suitability of a land-cover class."""
    c = F.coalesce(_c(cover).cast("int"), F.lit(-1))
    out = None
    for code, value in LAND_SUITABILITY.items():
        out = F.when(c == code, value) if out is None else out.when(c == code, value)
    return out.otherwise(LAND_DEFAULT)


def excluded_land(cover: Column | str, protected: Column | str) -> Column:
    """Protected or water/wetland ground."""
    return (F.coalesce(_c(protected), F.lit(0.0)) >= 0.5) | F.coalesce(_c(cover).cast("int"), F.lit(-1)).isin(
        *EXCLUDED_LAND
    )


def pack_score(score: Column | str) -> Column:
    """Score as a short in ten-thousandths, -1 where there is none."""
    s = _c(score)
    return F.coalesce(F.round(F.nanvl(s, F.lit(None).cast("double")) * 10000).cast("smallint"), F.lit(-1).cast("smallint"))


def unpack_score(packed: Column | str) -> Column:
    p = _c(packed)
    return F.when(p >= 0, p / 10000.0)


def folded_aspect(aspect_deg: Column, slope_deg: Column, lat: Column) -> Column:
    """Equatorwardness, eastness and their slope interaction; hemisphere aware."""
    a = F.radians(aspect_deg)
    facing = F.when(lat >= 0, F.pi()).otherwise(0.0)
    equ = F.cos(a - facing)
    return F.struct(
        equ.alias("equatorwardness"),
        F.sin(a).alias("eastness"),
        (F.sin(F.radians(slope_deg)) * equ).alias("slope_x_equatorward"),
    )


def northness01(aspect_deg: Column) -> Column:
    """The map variant of the aspect score: [0, 1], the same in both hemispheres."""
    return (1.0 - F.cos(F.radians(aspect_deg))) / 2.0


def top_flags(df, pct: str):
    """Site flags from its land percentile: inside the top 20, 10 and 5 % of land."""
    return df.withColumns({"top20": F.col(pct) >= 0.80, "top10": F.col(pct) >= 0.90, "top5": F.col(pct) >= 0.95})
