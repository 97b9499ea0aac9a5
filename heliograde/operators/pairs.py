"""Rank statistics of many columns at once, past sorted streams of whole numbers.

Two passes of Arrow batches serve all groups and columns together. The first counts rows by the leading bits of their values; the second
looks at values inside some of those buckets. So a quantile moves just the values of the bucket it lies in, and ROC areas move each distinct
value of a cell once. Results are exact: buckets decide how the work is dealt out, not what is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograde.operators import ranking as R
from heliograde.session import durable

LOW_BITS = 46  # of a value that its bucket leaves out: sign, exponent and 6 bits of the fraction stay
CELLS = 64  # value-ordered parts of a group and column
ROWS = 400_000  # rows that a task collapses together
CODE = "__g"


def finite(c: str) -> Column:
    """The column as double, NULL where it is no number."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v + 0.0)  # -0.0 is 0.0


def coded(df: DataFrame, group: list[str]) -> DataFrame:
    """One stored row for each group with ``CODE``, which numbers groups from 0."""
    return durable(df.select(*group).distinct().withColumn(CODE, F.row_number().over(Window.orderBy(*group)) - 1))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about ``ROWS`` rows."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table, k: int) -> np.ndarray:
    return table.column(k).to_numpy()


def sortable(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    i = x.view(np.int64)
    return i ^ ((i >> 63) & np.int64(2**63 - 1))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, n): the order that sorts rows by ``keys``, and where in it each distinct key starts and how often it is there."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(max(len(order) - 1, 0), dtype=bool)
    for k in keys:
        change |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(np.append(True, change))[: len(order)]
    return order, first, np.diff(np.append(first, len(order)))


def _buckets(marked: DataFrame, columns: int, skip: int) -> DataFrame:
    """(CODE, i, bucket, n, below, total) stored: rows in each bucket of each column, and in smaller ones. ``skip`` columns lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            g = _numbers(table, 0).astype(np.int64)
            for i in range(columns):
                x = _numbers(table, i + skip).astype(np.float64)
                there = ~np.isnan(x)
                both = (g[there] << (64 - LOW_BITS)) + (sortable(x[there]) >> LOW_BITS) + (1 << (63 - LOW_BITS))
                got, n = np.unique(both, return_counts=True)
                bucket = (got & ((1 << (64 - LOW_BITS)) - 1)) - (1 << (63 - LOW_BITS))
                whole = [pa.array(v.astype(np.int32)) for v in (got >> (64 - LOW_BITS), np.full(len(got), i), bucket)]
                yield pa.RecordBatch.from_arrays([*whole, pa.array(n.astype(np.int64))], names=[CODE, "i", "bucket", "n"])

    counts = marked.mapInArrow(run, f"{CODE} int, i int, bucket int, n long").groupBy(CODE, "i", "bucket").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy(CODE, "i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 2^18 rows at most
    return durable(counts.select("*", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("below"), F.sum("n").over(Window.partitionBy(CODE, "i")).alias("total")))


def quantiles(df: DataFrame, group: list[str], values: list[str], probs: dict[str, float]) -> DataFrame:
    """(group..., criterion, n, one column for each of ``probs``): exact linearly interpolated quantiles of every column."""
    base = df.select(*group, *[finite(v).alias(f"__v{i}") for i, v in enumerate(values)])
    codes = coded(base, group)
    marked = base.join(codes, group).select(CODE, *[f"__v{i}" for i in range(len(values))])
    hist = _buckets(marked, len(values), 1)
    ranks = F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("total") - 1) * F.lit(float(p))).alias("pos")) for k, p in enumerate(probs.values())])
    asked = hist.select("*", F.inline(ranks))
    covers = lambda r: (F.col("below") <= r) & (r < F.col("below") + F.col("n"))
    low, high = covers(F.floor("pos")), covers(F.ceil("pos"))
    marks = asked.filter(low | high).groupBy(CODE, "i", "k").agg(
        F.min("bucket").alias("lo"), F.max("bucket").alias("hi"), F.min("below").alias("base"), F.max("total").alias("total_n")
    )
    marks = durable(marks)
    got = marks.collect()  # groups x columns x probs
    bounds = np.zeros((max([r[CODE] for r in got], default=0) + 1, len(values), len(probs), 2), dtype=np.int64)
    bounds[..., 1] = -1
    for r in got:
        bounds[r[CODE], r.i, r.k] = r.lo, r.hi + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            g = _numbers(table, 0)
            for i in range(len(values)):
                x = _numbers(table, i + 1).astype(np.float64)
                bucket = sortable(x) >> LOW_BITS
                for k in range(len(probs)):
                    inside = ~np.isnan(x) & (bucket >= bounds[g, i, k, 0]) & (bucket < bounds[g, i, k, 1])
                    gi, xi = g[inside], x[inside]
                    order, first, n = _runs(gi, xi)
                    at = order[first]
                    whole = [pa.array(v.astype(np.int32)) for v in (gi[at], np.full(len(at), i), np.full(len(at), k))]
                    yield pa.RecordBatch.from_arrays([*whole, pa.array(xi[at]), pa.array(n.astype(np.int64))], names=[CODE, "i", "k", "value", "n"])

    keys = [CODE, "i", "k"]
    found = marked.mapInArrow(run, f"{CODE} int, i int, k int, value double, n long").groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    inner = found.withColumn("__in", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(marks, keys)
    p = F.element_at(F.array(*[F.lit(float(x)) for x in probs.values()]), F.col("k") + 1)
    each = inner.withColumn("below_n", F.col("__in") + F.col("base")).groupBy(*keys).agg(F.max("total_n").alias("n"), *R.quantile_exprs("value", "n", {"q": p}))
    wide = each.groupBy(CODE, "i").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("k") == k, F.col("q"))).alias(name) for k, name in enumerate(probs)])
    names = F.array(*[F.lit(v) for v in values])
    return wide.join(codes, CODE).select(*group, F.element_at(names, F.col("i") + 1).alias("criterion"), "n", *probs)


def _won(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, value, pos, neg) sorted by cell and value -> (cell, pos, neg, won): ``won`` is twice the pairs of the cell that positives win,
    ties a half. The state is one value and the negatives of its cell so far."""
    rest = np.zeros((4, 0), dtype=np.int64)
    at, below = None, 0

    def run(rows: np.ndarray) -> pa.RecordBatch:
        nonlocal at, below
        cell, value = rows[:2]
        new = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (value[1:] != value[:-1])))
        c, p, q = cell[new], np.add.reduceat(rows[2], new), np.add.reduceat(rows[3], new)
        heads = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        under = np.cumsum(q) - q
        start = under[heads]
        if at == c[0]:
            start[0] -= below
        under -= np.repeat(start, np.diff(np.append(heads, len(c))))
        at, below = c[-1], int(under[-1] + q[-1])
        sums = [np.add.reduceat(x, heads) for x in (p, q, p * (2 * under + q))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (c[heads], *sums)], names=["cell", "pos", "neg", "won"])

    for b in batches:
        rows = np.concatenate([rest, np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(4)])], axis=1)
        if not rows.shape[1]:
            continue
        other = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
        keep = int(other[-1]) + 1 if len(other) else 0
        rest = np.append(rows[:2, -1], rows[2:, keep:].sum(axis=1)).reshape(4, 1)  # the last value may go on in the next batch
        if keep:
            yield run(rows[:, :keep])
    if rest.shape[1]:
        yield run(rest)


COUNTS = "cell long, value long, pos long, neg long"


def collapsed(cell: np.ndarray, value: np.ndarray, positive: np.ndarray) -> pa.RecordBatch:
    """(cell, value, pos, neg), one row for each cell and value."""
    order, first, n = _runs(cell, value)
    at = order[first]
    pos = np.add.reduceat(positive[order].astype(np.int64), first) if len(first) else n
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (cell[at], value[at], pos, n - pos)], names=["cell", "value", "pos", "neg"])


def areas(counts: DataFrame, per_group: int) -> DataFrame:
    """(grp, n_pos, n_neg, auc) from rows of ``COUNTS``; cells grow with the value, ``per_group`` of them to a group. No group is sorted as a whole."""
    laid = counts.repartition("cell").sortWithinPartitions("cell", "value")
    sums = laid.mapInArrow(_won, "cell long, pos long, neg long, won long").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "won")])
    sums = sums.withColumn("grp", F.floor(F.col("cell") / F.lit(per_group)).cast("int"))
    ahead = Window.partitionBy("grp").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(ahead), F.lit(0))
    won = sums.withColumn("won", F.col("won") + 2 * F.col("pos") * below)
    out = won.groupBy("grp").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("won").alias("won"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return out.select("grp", "n_pos", "n_neg", (F.col("won").cast("double") / 2 / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def column_areas(df: DataFrame, group: list[str], values: list[str], label: str = "label") -> DataFrame:
    """(group..., criterion, n_pos, n_neg, auc) of every column against the label, missing values left out."""
    base = df.filter(F.col(label).isNotNull()).select(*group, (F.col(label) == 1).alias("__l"), *[finite(v).alias(f"__v{i}") for i, v in enumerate(values)])
    codes = coded(base, group)
    marked = base.join(codes, group).select(CODE, "__l", *[f"__v{i}" for i in range(len(values))])
    hist = _buckets(marked, len(values), 2)
    slots = hist.groupBy(CODE, "i", F.floor(F.col("below") * CELLS / F.col("total")).cast("int").alias("slot")).agg(F.min("bucket").alias("bucket"))
    bounds: dict[tuple[int, int], list[int]] = {}
    for r in slots.orderBy("bucket").collect():  # groups x columns x cells
        bounds.setdefault((r[CODE], r.i), []).append(r.bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            g, positive = _numbers(table, 0).astype(np.int64), _numbers(table, 1)
            for i in range(len(values)):
                x = _numbers(table, i + 2).astype(np.float64)
                there = ~np.isnan(x)
                gi, xi = g[there], x[there]
                slot = np.zeros(len(gi), dtype=np.int64)
                for k in np.unique(gi):
                    own = gi == k
                    slot[own] = np.searchsorted(bounds[int(k), i][1:], sortable(xi[own]) >> LOW_BITS, side="right")
                yield collapsed((gi * len(values) + i) * CELLS + slot, sortable(xi), positive[there])

    found = areas(marked.mapInArrow(run, COUNTS), CELLS)
    names = F.array(*[F.lit(v) for v in values])
    n = len(values)
    named = found.select(F.floor(F.col("grp") / n).cast("int").alias(CODE), F.element_at(names, F.col("grp") % n + 1).alias("criterion"), "n_pos", "n_neg", "auc")
    return named.join(codes, CODE).select(*group, "criterion", "n_pos", "n_neg", "auc")
