"""First and second moments of embeddings, and the closed-form scores built on them."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograde.functions.vectors import cosine, dot, literal_vector


def component_sums(df: DataFrame, group: list[str], vec: str) -> DataFrame:
    """(group, i, n, s): count and sum of each component."""
    return df.select(*group, F.posexplode(vec).alias("i", "x")).groupBy(*group, "i").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("double")).alias("s")
    )


def outer_sums(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, i, j, n, s): sums of pairwise component products.

    Each task multiplies whole Arrow batches and emits one block per group it saw (d x d
    numbers, whatever the row count); blocks are then added across tasks.
    """
    dtype = df.schema[group].dataType.simpleString()
    arrow_type = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[dtype]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            col = b.column(1)
            x = np.asarray(col.flatten(), dtype=np.float64).reshape(b.num_rows, -1)
            keys = np.array(b.column(0).to_pylist(), dtype=object)
            for k in set(keys.tolist()):
                part = x[keys == k]
                n, m = acc.get(k, (0, 0.0))
                acc[k] = (n + len(part), m + part.T @ part)
        for k, (n, m) in acc.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], arrow_type), pa.array([n], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))],
                names=[group, "n", "m"],
            )

    d = F.sqrt(F.size("m")).cast("int")
    blocks = df.select(group, vec).mapInArrow(partial, f"{group} {dtype}, n bigint, m array<double>")
    return (
        blocks.select(group, "n", d.alias("d"), F.posexplode("m").alias("p", "v"))
        .groupBy(group, F.floor(F.col("p") / F.col("d")).cast("int").alias("i"), F.pmod("p", "d").alias("j"))
        .agg(F.sum("n").alias("n"), F.sum("v").alias("s"))
    )


def fit_moments(df: DataFrame, label: str, vec: str) -> dict:
    """Driver-side mean and covariance per class: d + d^2 numbers each, independent of row count."""
    sums = component_sums(df, [label], vec).collect()
    outer = outer_sums(df, label, vec).collect()
    out = {}
    for k in sorted({r[label] for r in sums}):
        s = {r["i"]: (r["n"], r["s"]) for r in sums if r[label] == k}
        d, n = len(s), s[0][0]
        mean = np.array([s[i][1] / n for i in range(d)])
        second = np.zeros((d, d))
        for r in outer:
            if r[label] == k:
                second[r["i"], r["j"]] = r["s"] / n
        out[k] = {"n": n, "mean": mean, "cov": second - np.outer(mean, mean)}
    return out


def prototype_score(vec: str, mean: np.ndarray) -> Column:
    """Cosine to the class mean."""
    return cosine(F.col(vec), literal_vector(mean / np.linalg.norm(mean)))


def contrast_score(vec: str, pos: np.ndarray, neg: np.ndarray) -> Column:
    """Projection on the unit difference of class means."""
    w = pos - neg
    return dot(F.col(vec), literal_vector(w / np.linalg.norm(w)))




def quadratic_scores(df: DataFrame, vec: str, terms: list[tuple[str, np.ndarray, np.ndarray, float]], keep: list[str]) -> DataFrame:
    """Add ``name = offset - (x - m)' A (x - m)`` per term, evaluated on whole Arrow batches.

    The matrices are d x d and travel in the task closure.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    fields = schema + "".join(f", {name} double" for name, *_ in terms)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            x = np.asarray(b.column(len(keep)).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
            cols = [b.column(i) for i in range(len(keep))]
            for _, m, a, off in terms:
                c = x - m
                cols.append(pa.array(off - np.einsum("ij,jk,ik->i", c, a, c)))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *[t[0] for t in terms]])

    return df.select(*keep, vec).mapInArrow(score, fields)


def ridge_inverse(cov: np.ndarray, scale: float = 1e-3) -> np.ndarray:
    d = cov.shape[0]
    return np.linalg.inv(cov + scale * np.trace(cov) / d * np.eye(d))


def mahalanobis_scores(df: DataFrame, vec: str, keep: list[str], mean: np.ndarray, cov: np.ndarray) -> DataFrame:
    """Negative squared Mahalanobis distance to the positives with a small ridge."""
    return quadratic_scores(df, vec, [("score", mean, ridge_inverse(cov), 0.0)], keep)


def qda_scores(df: DataFrame, vec: str, keep: list[str], moments: dict, ridge: float = 1e-3) -> DataFrame:
    """Log density ratio of two Gaussians with class priors."""
    terms = []
    total = sum(m["n"] for m in moments.values())
    for k in (1, 0):
        m = moments[k]
        inv = ridge_inverse(m["cov"], ridge)
        off = np.linalg.slogdet(inv)[1] + 2 * np.log(m["n"] / total)
        terms.append((f"q{k}", m["mean"], inv, float(off)))
    return quadratic_scores(df, vec, terms, keep).withColumn("score", (F.col("q1") - F.col("q0")) / 2)
