"""Ordered running sums that no hot group can pin to one task.

Rank statistics need "how much weight lies below this value in its group". A plain window
partitioned by group sorts the whole group in one task; with a third of all rows in one
country that task never ends. Here rows are first collapsed to distinct values, each group
is cut into value-ordered *cells*, and only the per-cell totals (a few hundred rows per
group) are summed over the whole group. Row-level sorting happens inside one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograde.functions.hashing import SPAN, hash_order
from heliograde.session import durable

CELL = "__cell"
CELLS = 256
SPLIT_ABOVE = 500_000  # groups with fewer distinct values stay in one cell
SAMPLE_PER_GROUP = 4096
GLOBAL = "__all"


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (totals of an ungrouped aggregate) to every row.

    One row is all that is ever broadcast here.
    """
    return df.join(F.broadcast(row))


def clean_scores(df: DataFrame, score: str) -> DataFrame:
    """Rows whose score is present and a number."""
    return df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score)))


def value_counts(df: DataFrame, group: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """Collapse rows to distinct (group, value); ``sums`` are the weights added up per value."""
    return df.groupBy(*group, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def with_cells(dist: DataFrame, group: list[str], value: str, domain: tuple[float, float] | None) -> DataFrame:
    """Add a cell number that never decreases with ``value`` inside a group.

    With a known ``domain`` the cells are equal slices of it. Otherwise big groups are cut at
    exact quantiles of a hash sample: the sample depends on the values alone, not on row
    order or task layout, so every branch of a plan and every retry sees the same cells.
    """
    if domain is not None:
        lo, hi = domain
        slot = F.floor((F.col(value) - F.lit(float(lo))) / F.lit(float(hi - lo)) * F.lit(CELLS))
        return dist.withColumn(CELL, F.greatest(F.least(slot, F.lit(CELLS - 1)), F.lit(0)).cast("int"))
    large = dist.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > SPLIT_ABOVE)
    if large.isEmpty():
        return dist.withColumn(CELL, F.lit(0))
    cuts = [i / CELLS for i in range(1, CELLS)]
    bounds = (
        dist.select(*group, value)
        .join(F.broadcast(large), group)
        .filter(F.pmod(F.xxhash64(F.col(value)), (F.col("__n") / SAMPLE_PER_GROUP).cast("bigint")) == 0)
        .groupBy(*group)
        .agg(F.percentile(F.col(value).cast("double"), F.array(*[F.lit(c) for c in cuts])).alias("__bounds"))
    )
    # A large group is one row here, so cut points reach its rows without dealing them out by group.
    return dist.join(F.broadcast(bounds), group, "left").withColumn(
        CELL, F.when(F.col("__bounds").isNull(), 0).otherwise(_not_above(F.col(value))).cast("int")
    ).drop("__bounds")


def _not_above(value: Column) -> Column:
    """How many of the ``CELLS`` - 1 sorted numbers in ``__bounds`` are at most ``value``, by halving."""
    steps = F.array(*[F.lit(CELLS >> k) for k in range(1, CELLS.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, k: at + F.when(F.get("__bounds", at + k - 1) <= value, k).otherwise(0))


def running_sums(
    dist: DataFrame, group: list[str], value: str, sums: list[str], domain: tuple[float, float] | None = None
) -> DataFrame:
    """Add ``below_<s>`` (sum over strictly smaller values) and ``total_<s>`` for each weight.

    ``dist`` holds one row per (group, value). An empty ``group`` means the whole table. With
    no known domain the collapsed table is written once, since cutting cells reads it again.
    """
    keys = group or [GLOBAL]
    if not group:
        dist = dist.withColumn(GLOBAL, F.lit(0))
    if domain is None:
        dist = durable(dist)
    celled = with_cells(dist, keys, value, domain)
    totals = celled.groupBy(*keys, CELL).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    earlier = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        CELL,
        *[F.coalesce(F.sum(f"__t_{s}").over(earlier), F.lit(0)).alias(f"__o_{s}") for s in sums],
        *[F.sum(f"__t_{s}").over(whole).alias(f"total_{s}") for s in sums],
    )
    inside = Window.partitionBy(*keys, CELL).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = celled.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"__i_{s}") for s in sums])
    kept = [c for c in dist.columns if c != GLOBAL]
    return out.join(offsets, [*keys, CELL]).select(
        *kept,
        *[(F.col(f"__i_{s}") + F.col(f"__o_{s}")).alias(f"below_{s}") for s in sums],
        *[f"total_{s}" for s in sums],
    )


def quantile_exprs(value: str, n: str, probs: dict[str, float | Column]) -> list[Column]:
    """Aggregates over rows of ``running_sums`` giving linearly interpolated quantiles.

    A row with value v and count n covers sorted positions [below, below + n). Each quantile
    is read off at the two neighbouring positions of (N - 1) * p.
    """
    first, size, total = F.col(f"below_{n}"), F.col(n), F.col(f"total_{n}")
    out = []
    for name, p in probs.items():
        pos = (total - 1) * (p if isinstance(p, Column) else F.lit(float(p)))
        lo, hi = F.floor(pos), F.ceil(pos)
        covers = lambda k: (first <= k) & (k < first + size)
        low = F.max(F.when(covers(lo), F.col(value)))
        high = F.max(F.when(covers(hi), F.col(value)))
        frac = F.max(pos - lo)
        out.append((low + (high - low) * frac).alias(name))
    return out


def quantiles(
    df: DataFrame, group: list[str], value: str, probs: dict[str, float], domain: tuple[float, float] | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, without holding a group in memory."""
    dist = value_counts(clean_scores(df, value), group, value, {"n": F.lit(1)})
    ranked = running_sums(dist, group, value, ["n"], domain)
    exprs = quantile_exprs(value, "n", probs)
    return ranked.groupBy(*group).agg(*exprs) if group else ranked.agg(*exprs)


def average_rank(n: str = "n") -> Column:
    """1-based average rank of a value, ties sharing their mean position."""
    return F.col(f"below_{n}") + (F.col(n) + 1) / 2.0


def with_rank(df: DataFrame, group: list[str], value: str, out: str, domain=None, descending: bool = False) -> DataFrame:
    """Attach the average rank of ``value`` in its group (rows without a value get NULL)."""
    dist = value_counts(clean_scores(df, value), group, value, {"n": F.lit(1)})
    ranks = running_sums(dist, group, value, ["n"], domain)
    r = average_rank() if not descending else F.col("total_n") + 1 - average_rank()
    return df.join(ranks.select(*group, value, r.alias(out)), [*group, value], "left")


def hash_positions(df: DataFrame, group: list[str], key: Column, ties: list[str], seed: int, out: str,
                   upto: Column | None = None) -> DataFrame:
    """1-based position of each row in the hash order of its group.

    Hash values are uniform, so equal slices of the hash range are balanced cells however
    large one group is. With ``upto`` (a column of the row) slices that start beyond it are
    dropped before any sort.
    """
    keys = group or [GLOBAL]
    base = df.withColumn("__h", hash_order(key, seed))
    if not group:
        base = base.withColumn(GLOBAL, F.lit(0))
    base = base.withColumn(CELL, F.floor(F.col("__h") / F.lit(SPAN // CELLS)).cast("int"))
    totals = base.groupBy(*keys, CELL).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, CELL, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__o"))
    joined = base.join(offsets, [*keys, CELL])
    if upto is not None:
        joined = joined.filter(F.col("__o") < upto)
    inside = Window.partitionBy(*keys, CELL).orderBy("__h", *ties)
    drop = [CELL, "__h", "__o"] + ([] if group else [GLOBAL])
    return joined.withColumn(out, F.row_number().over(inside) + F.col("__o")).drop(*drop)
