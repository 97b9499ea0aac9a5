"""Embedding arithmetic on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def all_finite(vec: Column | str) -> Column:
    """True iff every component is present and finite."""
    return F.forall(_c(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(v: Column | str) -> Column:
    """The vector at length one (NULL for a zero vector)."""
    n = F.nullif(l2_norm(v), F.lit(0.0))
    return F.transform(_c(v), lambda x: x.cast("double") / n)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0))


def literal_vector(values) -> Column:
    """A fixed-size vector held by the driver (a prototype, a projection row) as a literal."""
    return F.array(*[F.lit(float(x)) for x in values])
