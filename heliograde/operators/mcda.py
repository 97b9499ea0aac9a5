"""Multi-criteria weighting baselines: normalise criteria per country, weight, aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograde.functions.scalars import excluded_land, land_suitability
from heliograde.operators import pairs as P
from heliograde.session import durable

# Direction of each criterion (benefit or cost) and published weight vectors.
DIRECTION = {
    "ghi": "b", "pvout": "b", "gti": "b", "temp": "c", "slope": "c", "elevation": "b",
    "aspect": "b", "road": "c", "grid": "c", "popdens": "b",
}
RICHARDS = {
    "road": 0.5401, "grid": 0.1392, "slope": 0.0605, "elevation": 0.0225, "ghi": 0.0352,
    "pvout": 0.0253, "gti": 0.0169, "aspect": 0.0759, "temp": 0.0844,
}
CHEN = {"ghi": 0.1924, "temp": 0.1701, "slope": 0.1576, "elevation": 0.1594, "grid": 0.1661, "popdens": 0.1544}
# Fixed values of the earlier three-vector benchmark.
BALANCED = {"ghi": 0.35, "slope": 0.20, "grid": 0.15, "road": 0.10, "land": 0.20}
IRRADIANCE = {"ghi": 0.45, "slope": 0.20, "grid": 0.15, "road": 0.10, "land": 0.10}
INFRASTRUCTURE = {"ghi": 0.30, "slope": 0.15, "grid": 0.25, "road": 0.15, "land": 0.15}
# Expert reclassification, lower bound of each class from most (3) to marginally (1) suitable.
BREAKPOINTS = {
    "road": [(100.0, 4000.0, 3), (4000.0, 6000.0, 2), (6000.0, 8000.0, 1), (8000.0, 10000.0, 0)],
    "grid": [(0.0, 4000.0, 3), (4000.0, 6000.0, 2), (6000.0, 8000.0, 1), (8000.0, 10000.0, 0)],
    "slope": [(0.0, 5.5, 3), (5.5, 7.5, 2), (7.5, 10.5, 1), (10.5, 21.91, 0)],
    "elevation": [(30.0, 300.0, 3), (300.0, 500.0, 2), (500.0, 800.0, 1), (800.0, 2126.0, 0)],
}
EPS = 1e-12
MIN_FINITE_LAND = 100


def config_vectors() -> dict[str, dict[str, float]]:
    """The four weight vectors of the benchmark."""
    equal = lambda w: {c: 1.0 / len(w) for c in w}
    return {"richards": RICHARDS, "chen": CHEN, "equal_richards": equal(RICHARDS), "equal_chen": equal(CHEN)}


def criterion_ranges(points: DataFrame, country: str, criteria: list[str], label: str = "label",
                     lo: float = 0.02, hi: float = 0.98, minimum: int = MIN_FINITE_LAND) -> DataFrame:
    """(country, criterion, lo, hi) from finite land values; criteria with too few are left out."""
    out = P.quantiles(points.filter(F.col(label) == 0), [country], criteria, {"lo": lo, "hi": hi}).withColumnRenamed("n", "n_finite")
    return out.filter(F.col("n_finite") >= minimum)


def normalise(points: DataFrame, country: str, criteria: list[str], ranges: DataFrame, directions: dict[str, str] = DIRECTION) -> DataFrame:
    """Add ``n_<criterion>`` in [0, 1], higher is better; NULL where the country skips the criterion."""
    one = lambda c, f: F.max(F.when(F.col("criterion") == c, F.col(f))).alias(f"__{f}_{c}")
    wide = ranges.groupBy(country).agg(*[one(c, f) for c in criteria for f in ("lo", "hi")])
    out = points.join(wide, country, "left")
    cols = []
    for c in criteria:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        x = F.col(c).cast("double")
        # NaN counts as missing; clipping must not turn a missing value into a bound.
        v = F.when(x.isNotNull() & ~F.isnan(x) & lo.isNotNull(), F.least(F.greatest((x - lo) / (hi - lo + EPS), F.lit(0.0)), F.lit(1.0)))
        cols.append((v if directions[c] == "b" else 1.0 - v).alias(f"n_{c}"))
        cols.append(lo.isNotNull().alias(f"has_{c}"))
    return out.select(*points.columns, *cols)


def config_weights(ranges: DataFrame, country: str, vectors: dict[str, dict[str, float]], modes: tuple[str, ...], order: list[str]) -> DataFrame:
    """One row per (country, config, land mode) with a column ``w_<criterion>`` for each of ``order``.

    Weights cover the criteria the country has and sum to one; land joins with the mean of the
    full vector where the mode asks for it. The table is as long as there are countries, times configs.
    """
    have = ranges.groupBy(country).agg(F.collect_set("criterion").alias("__have"))
    rows = []
    for name, vector in vectors.items():
        for mode in modes:
            full = dict(vector)
            if mode == "weighted" and "land" not in vector:
                full["land"] = sum(vector.values()) / len(vector)
            raw = [
                F.lit(full.get(c, 0.0)) if c == "land" or c not in full else F.when(F.array_contains("__have", c), full[c]).otherwise(0.0) for c in order
            ]
            rows.append(F.struct(F.lit(name).alias("config"), F.lit(mode).alias("land"), *[r.alias(f"r_{c}") for r, c in zip(raw, order)]))
    total = F.nullif(sum((F.col(f"r_{c}") for c in order), F.lit(0.0)), F.lit(0.0))
    return have.select(country, F.inline(F.array(*rows))).select(country, "config", "land", *[(F.col(f"r_{c}") / total).alias(f"w_{c}") for c in order])


def _terms(order: list[str], weights: dict[str, np.ndarray], f) -> np.ndarray:
    """Sum of f(weight, value) over criteria; a weight of zero never blanks the row."""
    out = 0.0
    for c in order:
        w = weights[c]
        out = out + np.where(w == 0, 0.0, f(w, c))
    return out


def _aggregate(order: list[str], weights: dict[str, np.ndarray], value: dict[str, np.ndarray], aggregator: str) -> np.ndarray:
    """``wlc``: weighted sum. ``topsis``: closeness to the ideal point 1 against the anti-ideal 0, every point on its own."""
    if aggregator == "wlc":
        return _terms(order, weights, lambda k, c: k * value[c])
    plus = np.sqrt(_terms(order, weights, lambda k, c: (k * value[c] - k) * (k * value[c] - k)))
    minus = np.sqrt(_terms(order, weights, lambda k, c: k * value[c] * k * value[c]))
    return minus / (plus + minus + EPS)


class _Scorer:
    """Scores of Arrow batches (code of the country, excluded, land suitability, criteria...) under every config.

    Holds the ranges of countries x criteria and the weights of countries x configs, which come to the driver.
    """

    def __init__(self, points: DataFrame, country: str, vectors: dict, directions: dict[str, str], modes: tuple[str, ...], minimum: int, aggregators: tuple[str, ...]):
        self.criteria = sorted({c for v in vectors.values() for c in v if c != "land"})
        self.order = [*self.criteria, "land"]
        self.benefit = [directions[c] == "b" for c in self.criteria]
        ranges = durable(criterion_ranges(points, country, self.criteria, minimum=minimum))
        self.codes = P.coded(ranges, [country])
        weights = config_weights(ranges, country, vectors, modes, self.order).join(self.codes, country).collect()
        size = self.codes.count()
        self.lo, self.hi = np.full((2, size, len(self.criteria)), np.nan)
        for r in ranges.join(self.codes, country).collect():
            at = r[P.CODE], self.criteria.index(r.criterion)
            self.lo[at], self.hi[at] = r.lo, r.hi
        self.configs = [(n, m, a) for n, m in dict.fromkeys((r.config, r.land) for r in weights) for a in aggregators]
        self.weights = {(n, m): np.full((size, len(self.order)), np.nan) for n, m, _ in self.configs}
        for r in weights:
            w = [r[f"w_{c}"] for c in self.order]
            self.weights[r.config, r.land][r[P.CODE]] = [np.nan if x is None else x for x in w]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "codes"}  # tasks need the numbers alone

    def columns(self, cover: str, protected: str) -> list[Column]:
        ground = [F.coalesce(excluded_land(cover, protected), F.lit(False)).alias("__excl"), land_suitability(cover).cast("double").alias("__land")]
        return [P.CODE, *ground, *[P.finite(c).alias(f"__{c}") for c in self.criteria]]

    def scores(self, b: pa.RecordBatch | pa.Table) -> Iterator[np.ndarray]:
        """One array for each of ``configs``, NaN where the point lacks one of its criteria."""
        g, excluded = (b.column(k).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(k).to_numpy() for k in (0, 1))
        numbers = [np.asarray(b.column(k).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(k).to_numpy(), dtype=np.float64) for k in range(2, 3 + len(self.criteria))]
        value = {"land": numbers[0]}
        for i, c in enumerate(self.criteria):
            lo, hi = self.lo[g, i], self.hi[g, i]
            v = np.minimum(np.maximum((numbers[i + 1] - lo) / (hi - lo + EPS), 0.0), 1.0)
            value[c] = v if self.benefit[i] else 1.0 - v
        for name, mode, aggregator in self.configs:
            w = self.weights[name, mode]
            s = _aggregate(self.order, {c: w[g, i] for i, c in enumerate(self.order)}, value, aggregator)
            yield np.where(excluded & ~np.isnan(s), 0.0, s)


def score_configs(points: DataFrame, country: str, keep: list[str], vectors: dict[str, dict[str, float]] | None = None,
                  directions: dict[str, str] = DIRECTION, cover: str = "worldcover", protected: str = "wdpa",
                  modes: tuple[str, ...] = ("excl", "weighted"), minimum: int = MIN_FINITE_LAND,
                  aggregators: tuple[str, ...] = ("wlc", "topsis"), only: Column | None = None) -> DataFrame:
    """Long table (keep..., config, aggregator, land, mcda): one score per point and config.

    A config scores exactly the points complete for its own criteria; excluded ground gets 0. Ranges come from all points; ``only``
    says which of them are scored. Arithmetic runs on Arrow batches, a column at a time.
    """
    scorer = _Scorer(points, country, vectors or config_vectors(), directions, modes, minimum, aggregators)
    slim = (points if only is None else points.filter(only)).join(scorer.codes, country).select(*scorer.columns(cover, protected), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.select(keep)
            for (name, mode, aggregator), s in zip(scorer.configs, scorer.scores(b), strict=True):
                there = np.flatnonzero(~np.isnan(s))
                rows = kept.take(pa.array(there))
                marks = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(there), dtype=np.int32))) for x in (name, aggregator, mode)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *marks, pa.array(s[there])], names=[*keep, "config", "aggregator", "land", "mcda"])

    kinds = dict(slim.dtypes)
    return slim.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", config string, aggregator string, land string, mcda double")


PLACES = 1e9  # scores are compared in whole billionths
CELL_BITS = 24  # of a score in billionths that do not tell its cell


def config_areas(points: DataFrame, country: str, vectors: dict[str, dict[str, float]] | None = None, directions: dict[str, str] = DIRECTION,
                 cover: str = "worldcover", protected: str = "wdpa", modes: tuple[str, ...] = ("excl", "weighted"), minimum: int = MIN_FINITE_LAND,
                 aggregators: tuple[str, ...] = ("wlc", "topsis"), only: Column | None = None, label: str = "label") -> DataFrame:
    """(country, config, aggregator, land, n_pos, n_neg, roc) of ``score_configs`` at nine places. Scores leave a task as whole numbers, equal
    ones of a block together, so that no point is repeated with its columns for each config."""
    scorer = _Scorer(points, country, vectors or config_vectors(), directions, modes, minimum, aggregators)
    some = (points if only is None else points.filter(only)).filter(F.col(label).isNotNull())
    slim = some.join(scorer.codes, country).select(*scorer.columns(cover, protected), (F.col(label) == 1).alias("__l"))
    n, cells = len(scorer.configs), (int(PLACES) >> CELL_BITS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in P.gathered(batches):
            g, positive = table.column(0).to_numpy().astype(np.int64), table.column("__l").to_numpy()
            for i, s in enumerate(scorer.scores(table)):
                there = ~np.isnan(s)
                x = s[there] * PLACES
                whole = np.floor(x)
                value = (whole + (x - whole >= 0.5)).astype(np.int64)  # halves away from zero, as SQL rounds
                yield P.collapsed((g[there] * n + i) * cells + (value >> CELL_BITS), value, positive[there])

    found = P.areas(slim.mapInArrow(run, P.COUNTS), cells)
    names = F.array(*[F.struct(F.lit(a).alias("config"), F.lit(c).alias("aggregator"), F.lit(b).alias("land")) for a, b, c in scorer.configs])
    named = found.select(F.floor(F.col("grp") / n).cast("int").alias(P.CODE), F.element_at(names, F.col("grp") % n + 1).alias("__c"), "n_pos", "n_neg", F.round("auc", 6).alias("roc"))
    return named.join(scorer.codes, P.CODE).select(country, "__c.*", "n_pos", "n_neg", "roc")


def reclassify(value: Column, criterion: str) -> Column:
    """Expert class 3..0 of a value by published breakpoints ([lo, hi), NULL outside all)."""
    out = None
    for lo, hi, cls in BREAKPOINTS[criterion]:
        inside = (value >= lo) & (value < hi)
        out = F.when(inside, cls) if out is None else out.when(inside, cls)
    return out


def weight_table(ranges: DataFrame, country: str, vectors: dict[str, dict[str, float]]) -> DataFrame:
    """(country, config, criterion, weight): vectors cut to the criteria a country has, plus land, summing to one."""
    rows = [F.struct(F.lit(n).alias("config"), F.lit(c).alias("criterion"), F.lit(v).alias("w")) for n, vec in vectors.items() for c, v in vec.items()]
    have = ranges.select(country, F.col("criterion").alias("__c")).select(country, "__c", F.inline(F.array(*rows))).filter(F.col("__c") == F.col("criterion")).drop("__c")
    land = [F.struct(F.lit(n).alias("config"), F.lit("land").alias("criterion"), F.lit(sum(vec.values()) / len(vec)).alias("w")) for n, vec in vectors.items()]
    full = have.unionByName(ranges.select(country).distinct().select(country, F.inline(F.array(*land))))
    total = full.groupBy(country, "config").agg(F.sum("w").alias("__t"))
    return full.join(total, [country, "config"]).select(country, "config", "criterion", (F.col("w") / F.col("__t")).alias("weight"))
