"""Classifiers and regressions on embeddings and covariates with MLlib.

MLlib has no cap on leaves, so a size budget is met by raising the minimum leaf size until
the node count fits. Weights, splits and permutations are hash based and repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from heliograde.functions.vectors import dot, l2_norm
from heliograde.operators import ranking as R
from heliograde.operators.moments import outer_sums
from heliograde.operators.sampling import balanced_weight

FEATURE_ROWS = 500  # rows whose random features a task holds at once
BYTES_PER_NODE = 40  # fixed estimate for the size of a serialised tree node


def with_features(df: DataFrame, vec: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(vec, lambda x: x.cast("double"))))


def with_balanced_weight(df: DataFrame, label: str = "label", out: str = "cw") -> DataFrame:
    return df.join(balanced_weight(df, label).withColumnRenamed("weight", out), label)


def score_with(model, df: DataFrame, out: str = "score") -> DataFrame:
    """Probability of the positive class as a plain column; the input key columns are kept."""
    keep = [c for c in df.columns if c not in ("features",)]
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(out))


def forest(train: DataFrame, label: str = "label", trees: int = 20, depth: int = 8, min_leaf: int = 5, subsample: float = 0.34,
           weight: str | None = "cw", seed: int = 0):
    rf = RandomForestClassifier(
        labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
        subsamplingRate=subsample, seed=seed,
    )
    if weight:
        rf = rf.setWeightCol(weight)
    return rf.fit(train)


def forest_size(model) -> int:
    return int(model.totalNumNodes) * BYTES_PER_NODE


def forest_within_budget(train: DataFrame, max_bytes: int, min_leaf: int = 5, **kw):
    """Refit with larger leaves until the forest fits the size budget; a budget below one node a tree is an error."""
    if max_bytes < BYTES_PER_NODE * kw.get("trees", 20):
        raise ValueError(f"{max_bytes} bytes are less than one node of each tree")
    while True:
        model = forest(train, min_leaf=min_leaf, **kw)
        size = forest_size(model)
        if size <= max_bytes:
            return model, min_leaf, size
        min_leaf = max(min_leaf + 1, int(min_leaf * size / max_bytes))


def logistic_probe(train: DataFrame, label: str = "label", weight: str = "cw"):
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    lr = LogisticRegression(labelCol=label, featuresCol="scaled", weightCol=weight, maxIter=50, regParam=1e-3)
    return Pipeline(stages=[scale, lr]).fit(train)


def l1_quadratic(train: DataFrame, label: str = "label", weight: str = "cw"):
    """L1 logistic on [x, x^2]; the caller supplies those features."""
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    lr = LogisticRegression(labelCol=label, featuresCol="scaled", weightCol=weight, maxIter=50, regParam=1e-3, elasticNetParam=1.0)
    return Pipeline(stages=[scale, lr]).fit(train)


def squares(df: DataFrame, vec: str, out: str) -> DataFrame:
    return df.withColumn(out, F.concat(F.transform(vec, lambda x: x.cast("double")), F.transform(vec, lambda x: x.cast("double") * x.cast("double"))))


def fourier_features(df: DataFrame, vec: str, out: str, dims: int = 512, gamma: float = 1.0, seed: int = 0, inputs: int = 64) -> DataFrame:
    """Random Fourier features cos(Wx + b) * sqrt(2 / dims), with W drawn once from a seed.

    The projection is inputs x dims numbers, applied to ``FEATURE_ROWS`` rows of an Arrow batch at a time: a task's Python holds the features of these alone.
    """
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2 * gamma), size=(inputs, dims))
    b = rng.uniform(0, 2 * np.pi, size=dims)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FEATURE_ROWS):
                part = batch.slice(start, FEATURE_ROWS)
                x = part.column(part.schema.get_field_index(vec))
                if x.null_count:
                    raise ValueError(f"{vec} holds nulls")
                z = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, inputs) @ w
                z += b
                np.cos(z, out=z)
                z *= np.sqrt(2.0 / dims)
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dims)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], names=[*part.schema.names, out])

    return df.mapInArrow(project, StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))]))


def boosted(train: DataFrame, label: str = "label", seed: int = 0, iters: int = 20):
    return GBTClassifier(labelCol=label, featuresCol="features", maxIter=iters, maxDepth=4, seed=seed, weightCol="cw").fit(train)


def perceptron(train: DataFrame, inputs: int, label: str = "label", seed: int = 0, hidden: tuple[int, ...] = (128, 64)):
    return MultilayerPerceptronClassifier(
        labelCol=label, featuresCol="features", layers=[inputs, *hidden, 2], maxIter=30, seed=seed
    ).fit(train)


def multi_prototype(train: DataFrame, df: DataFrame, vec: str, k: int, keep: list[str], seed: int = 0) -> DataFrame:
    """Best cosine to any of k k-means centres of the positives."""
    centres = KMeans(k=k, seed=seed, featuresCol="features").fit(with_features(train, vec)).clusterCenters()
    # Centres as one constant array of unit vectors: k x d numbers, one expression for any k.
    units = F.lit([[float(x) for x in c / np.linalg.norm(c)] for c in centres])
    best = F.array_max(F.transform(units, lambda c: dot(F.col(vec), c))) / F.nullif(l2_norm(vec), F.lit(0.0))
    return df.select(*keep, best.alias("score"))


def regression_r2(train: DataFrame, test: DataFrame, inputs: list[str], target: str, kind: str = "ridge", seed: int = 0) -> tuple[float, object]:
    """R2 on held-out rows of a ridge or forest regression of ``target`` on ``inputs``."""
    assemble = VectorAssembler(inputCols=inputs, outputCol="features")
    est = (
        LinearRegression(featuresCol="features", labelCol=target, regParam=1e-3, elasticNetParam=0.0) if kind == "ridge"
        else RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=20, maxDepth=6, minInstancesPerNode=20, seed=seed)
    )
    model = Pipeline(stages=[assemble, est]).fit(train)
    r2 = RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="r2").evaluate(model.transform(test))
    return float(r2), model


def grouped_ridge(df: DataFrame, group: str, inputs: list[str], target: str, held: str, alpha: float = 1.0, minimum: int = 500) -> DataFrame:
    """(group, n_train, n_test, r2, novelty): one ridge fit for each group, judged on its held-out rows (``held`` is true).

    Inputs are standardised on the training rows and ``alpha`` weighs the squared coefficients against the sum of squared errors; constant inputs
    get none. Rows with a null or non-finite value take no part, groups of fewer than ``minimum`` others are left out; without training or
    held-out rows, or where the held-out target is constant, R2 is null. Rows go once into products of their columns, summed before the
    shuffle, so a group is one small matrix for each side whatever its size; both the fit and the held-out error read off these.
    Columns are first centred on the whole table's means, so that large offsets cost no digits.
    """
    names = [*inputs, target]
    cols = [F.col(c).cast("double") for c in names]
    finite = F.forall(F.array(*cols), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(finite & F.col(held).isNotNull() & F.col(group).isNotNull())
    means = rows.agg(*[F.avg(c).alias(str(i)) for i, c in enumerate(cols)]).first()  # one row of as many numbers as there are inputs
    centred = [c - F.lit(m or 0.0) for c, m in zip(cols, means, strict=True)]
    kind = df.schema[group].dataType.simpleString()
    # group and side as one text key: the sums are grouped by it
    key = F.to_json(F.struct(F.col(group).alias("g"), F.col(held).cast("boolean").alias("h")))
    sums = outer_sums(rows.select(key.alias("key"), F.array(F.lit(1.0), *centred).alias("x")), "key", "x")
    side = F.from_json("key", f"g {kind}, h boolean")
    cells = sums.select(side["g"].alias(group), side["h"].alias("held"), "i", "j", "s")
    d = len(names) + 1

    def solve(t: pa.Table) -> pa.Table:
        m = {}
        for held_out in (False, True):
            part = t.filter(pc.equal(t["held"], held_out))
            m[held_out] = np.zeros((d, d))
            m[held_out][part["i"].to_numpy(), part["j"].to_numpy()] = part["s"].to_numpy()
        n, n_test = (int(round(m[h][0, 0])) for h in (False, True))
        r2 = None
        if n + n_test < minimum:
            rows_ = []
        else:
            if n and n_test:
                r2 = _ridge_r2(m[False], m[True], alpha)
            rows_ = [(t[group][0].as_py(), n, n_test, r2, None if r2 is None else 1 - r2)]
        kinds = [t[group].type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows_], x) for k, x in enumerate(kinds)], names=[group, "n_train", "n_test", "r2", "novelty"])

    return cells.groupBy(group).applyInArrow(solve, f"`{group}` {kind}, n_train bigint, n_test bigint, r2 double, novelty double")


def _ridge_r2(train: np.ndarray, test: np.ndarray, alpha: float) -> float | None:
    """R2 on one table of sums of products of (1, inputs..., target), fitted on another."""
    n, mean = train[0, 0], train[0, 1:] / train[0, 0]
    cov = train[1:, 1:] - n * np.outer(mean, mean)
    xx, xy, var = cov[:-1, :-1], cov[:-1, -1], np.diag(cov)[:-1]
    moves = var > 1e-12 * np.maximum(1e-12, np.diag(train)[1:-1])
    sd = np.sqrt(var[moves] / n)
    coef = np.zeros(len(var))
    scaled = xx[np.ix_(moves, moves)] / np.outer(sd, sd)
    coef[moves] = np.linalg.solve(scaled + alpha * np.eye(len(sd)), xy[moves] / sd) / sd
    # error of y - b - x.w as a quadratic form in the held-out sums
    form = np.append(np.append(-(mean[-1] - mean[:-1] @ coef), -coef), 1.0)
    spread = test[-1, -1] - test[0, -1] ** 2 / test[0, 0]
    return None if spread <= 1e-12 * max(1e-300, test[-1, -1]) else float(1 - form @ test @ form / spread)


def hash_split(df: DataFrame, key, seed: int = 0, share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    from heliograde.functions.hashing import uniform

    u = uniform(key, seed)
    return df.filter(u >= share), df.filter(u < share)


def permuted_scores(model, df: DataFrame, inputs: list[str], key: str, keep: list[str], repeats: int = 3, seed: int = 0) -> DataFrame:
    """Predictions with one input at a time replaced by another row's value.

    A permutation is a join of two hash orders of the rows. All inputs ride on the same
    permuted row and are swapped in one by one as extra rows, so every feature and repeat is
    scored in a single pass: (feature, rep, keep..., prediction).
    """
    out = None
    for rep in range(repeats):
        a = R.hash_positions(df.select(key, *inputs, *keep), [], F.col(key), [key], 2 * rep + 1 + seed, "__pos")
        b = R.hash_positions(df.select(key, *inputs), [], F.col(key) * 31 + 7, [key], 2 * rep + 2 + seed, "__pos")
        b = b.select("__pos", *[F.col(c).alias(f"__p_{c}") for c in inputs])
        j = a.join(b, "__pos").withColumn("feature", F.explode(F.array(*[F.lit(c) for c in inputs])))
        j = j.select(key, "feature", F.lit(rep).alias("rep"), *keep, *[
            F.when(F.col("feature") == c, F.col(f"__p_{c}")).otherwise(F.col(c)).alias(c) for c in inputs
        ])
        out = j if out is None else out.unionByName(j)
    return model.transform(out).select("feature", "rep", *keep, "prediction")


def one_hot_land(df: DataFrame, cover: str, classes: list[int]) -> tuple[DataFrame, list[str]]:
    names = [f"wc_{c}" for c in classes]
    flags = [F.coalesce((F.col(cover) == c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(classes, names)]
    return df.select("*", *flags), names
