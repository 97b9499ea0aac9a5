"""Toxicity: a word-presence classifier whose score must not change when identity terms are swapped.

The words, and beginnings of words, that tell toxic from other labelled texts are counted by Spark; the most telling ones and the
identity terms are the features. Beginnings carry what is learned over to inflected forms that no labelled text has. Each labelled text that mentions an identity term is paired with its counterfactual, the same text with every term
replaced by the next one of its group. The fit minimises logistic loss plus a penalty on the squared score change of the pairs, so
a group's mention alone moves no score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identity terms by group; a term is swapped for the next one of its group.
IDENTITY_GROUPS = [
    ["women", "men"], ["woman", "man"], ["girl", "boy"], ["female", "male"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"], ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"], ["black", "white", "asian", "latino", "african", "arab"],
    ["deaf", "blind", "disabled"], ["immigrants", "refugees", "natives"], ["femmes", "hommes"], ["frauen", "männer"], ["mujeres", "hombres"],
]
IDENTITY = frozenset(t for g in IDENTITY_GROUPS for t in g)
SAMPLE_ROWS = 20_000  # labelled rows that a model is fitted on, at most about so many
FEATURES = 2_000  # words with a weight, the most telling first
LEAST_Z, LEAST_TEXTS = 3.5, 3  # of a feature: how sure its two rates differ, and texts it occurs in
PENALTY = 4.0  # of the squared change of a counterfactual's score
RIDGE = 2e-3
STEMS = (4, 5, 6)  # letters of the beginnings that count as features of longer words
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def terms_of(words: set[str], whole: frozenset[str] = IDENTITY) -> set[str]:
    """Words, and beginnings of longer words marked by a hyphen; identity terms (``whole``) have no beginnings, so that a swap replaces all they say."""
    return words.union(*({w[:k] + "-" for w in words if len(w) > k and w not in whole} for k in STEMS))


def swapped(words: set[str], groups=IDENTITY_GROUPS) -> set[str] | None:
    """The words after every identity term has become the next one of its group; None without such terms."""
    turn = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    return {turn.get(w, w) for w in words} if words & turn.keys() else None


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    whole: frozenset[str] = IDENTITY

    def score(self, text: str | None) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, sorted(terms_of(words_of(text), self.whole) & self.weights.keys())))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def sample_of(labels: DataFrame, docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of about ``rows`` labelled documents, by a hash of the id, so that the same rows come at every run.

    ``labels`` has (doc_id, toxic). Labels of one document are combined by the largest; null labels and ids are left out.
    The sample is bounded, so it is sent to the documents rather than they to it.
    """
    own = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    total = own.count()
    span = 1 << 30
    cut = span if total <= rows else int(span * rows / total)
    own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < cut).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "toxic")


def _count(whole: frozenset[str]):
    """(text, toxic) -> (word, clean, toxic): how many texts of each kind hold a term, in parts."""
    return lambda batches: _counts(batches, whole)


def _counts(batches: Iterator[pa.RecordBatch], whole: frozenset[str]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        words = list(seen[0].keys() | seen[1].keys())
        cols = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)]
        for c in seen:
            c.clear()
        return pa.RecordBatch.from_arrays(cols, names=["word", "clean", "toxic"])

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen[int(toxic == 1)].update(terms_of(words_of(text), whole))
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield flush()
    yield flush()


def features(sample: DataFrame, limit: int = FEATURES, whole: frozenset[str] = IDENTITY) -> list[str]:
    """The words whose rates in toxic and other texts differ most surely."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        return []
    counts = sample.select("text", "toxic").mapInArrow(_count(whole), "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    p = (F.col("c") + F.col("t") + 1) / F.lit(n0 + n1 + 2.0)
    z = (F.col("t") / F.lit(float(n1)) - F.col("c") / F.lit(float(n0))) / F.sqrt(p * (1 - p) * F.lit(1 / n1 + 1 / n0))
    best = counts.filter(F.col("c") + F.col("t") >= LEAST_TEXTS).select("word", F.abs(z).alias("z")).filter(F.col("z") >= LEAST_Z)
    return [r["word"] for r in best.orderBy(F.desc("z"), "word").limit(limit).collect()]


def _rows(words: list[str], groups):
    """(text, toxic) -> (toxic, own, other): indices of the features of a text and of its counterfactual (null without)."""
    at = {w: i for i, w in enumerate(words)}
    whole = frozenset(t for g in groups for t in g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, other = [], []
            for text in b.column(0).to_pylist():
                have = words_of(text)
                own.append([at[w] for w in terms_of(have, whole) & at.keys()])
                turned = swapped(have, groups)
                other.append(None if turned is None else [at[w] for w in terms_of(turned, whole) & at.keys()])
            yield pa.RecordBatch.from_arrays([pa.array([int(x == 1) for x in b.column(1).to_pylist()], pa.int32()), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], names=["toxic", "own", "other"])

    return run


def _sparse(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], dtype=np.int64)


def fit(sample: DataFrame, limit: int = FEATURES, penalty: float = PENALTY, ridge: float = RIDGE, groups=IDENTITY_GROUPS, rounds: int = 60) -> Model:
    """The model of a bounded sample of (text, toxic). Without both kinds of label it scores every text alike.

    The loss is convex: Newton steps, each found by conjugate gradients and shortened until the loss falls, on the driver over at most about
    SAMPLE_ROWS short index lists. Weights that are not finite are an error.
    """
    sample = sample.cache()
    try:
        whole = frozenset(t for g in groups for t in g)
        words = features(sample, limit, whole)
        words += sorted({t for g in groups for t in g} - set(words))
        rows = sample.select("text", "toxic").mapInArrow(_rows(words, groups), "toxic int, own array<int>, other array<int>").collect()
    finally:
        sample.unpersist()
    y = np.array([r["toxic"] for r in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.01
        return Model(float(np.log(rate / (1 - rate))), {}, whole)
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["toxic"], sorted(rows[i]["own"])))  # sums do not depend on the partitions
    y = y[order]
    row, col = _sparse([sorted(rows[i]["own"]) for i in order])
    pairs = [rows[i] for i in order if rows[i]["other"] is not None]
    prow, pcol = _sparse([sorted(set(r["other"]) - set(r["own"])) for r in pairs])
    mrow, mcol = _sparse([sorted(set(r["own"]) - set(r["other"])) for r in pairs])
    n, d, m = len(y), len(words), len(pairs)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5 / n  # the rare label counts somewhat more
    pull = ridge * np.sqrt(np.bincount(col, minlength=d) / n + 1e-3)

    def change(v: np.ndarray) -> np.ndarray:
        """Score change of every pair."""
        return np.bincount(prow, v[pcol], m) - np.bincount(mrow, v[mcol], m)

    def loss(v: np.ndarray) -> float:
        z = v[d] + np.bincount(row, v[col], n)
        fair = penalty / m * float(change(v) @ change(v)) if m else 0.0
        return float(weight @ (np.logaddexp(0.0, z) - y * z)) + fair + 0.5 * float(pull @ v[:d] ** 2)

    def onto(per_row: np.ndarray, per_pair: np.ndarray | None, v: np.ndarray) -> np.ndarray:
        """Sums of values of rows and of pairs over the features, and the pull of the ridge at ``v``."""
        out = np.append(np.bincount(col, per_row[row], d) + pull * v[:d], per_row.sum())
        if m:
            out[:d] += 2 * penalty / m * (np.bincount(pcol, per_pair[prow], d) - np.bincount(mcol, per_pair[mrow], d))
        return out

    v = np.append(np.zeros(d), np.log(y.mean() / (1 - y.mean())))
    now = loss(v)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(v[d] + np.bincount(row, v[col], n), -500, 500)))
        slope = onto(weight * (p - y), change(v) if m else None, v)
        if np.abs(slope).max() < 1e-7:
            break
        curve = weight * np.maximum(p * (1 - p), 1e-9)
        step = _solve(lambda u, curve=curve: onto(curve * (u[d] + np.bincount(row, u[col], n)), change(u) if m else None, u), -slope)
        size = 1.0
        while (then := loss(v + size * step)) > now + 1e-4 * size * float(slope @ step) and size > 1e-10:
            size /= 2
        if not then < now:
            break
        v, now = v + size * step, then
    if not np.isfinite(v).all():
        raise ArithmeticError("the toxicity model did not converge to finite weights")
    return Model(float(v[d]), {x: float(c) for x, c in zip(words, v[:d], strict=True) if abs(c) > 1e-6}, whole)


def _solve(product, right: np.ndarray, most: int = 200) -> np.ndarray:
    """The positive definite system ``product(x) = right`` by conjugate gradients, to a thousandth of its size."""
    x, r = np.zeros_like(right), right.copy()
    q, size = r.copy(), float(r @ r)
    for _ in range(most):
        image = product(q)
        a = size / float(q @ image)
        x, r = x + a * q, r - a * image
        size, before = float(r @ r), size
        if size < 1e-6 * float(right @ right):
            break
        q = r + size / before * q
    return x


def scores(text: Column | str, model: Model) -> Column:
    """Score column of a text column, between 0 and 1; null and empty texts get the bias alone."""

    @F.arrow_udf(T.DoubleType())
    def run(t: pa.Array) -> pa.Array:
        return pa.array([model.score(x.as_py()) for x in t], pa.float64())

    return run(text)


def held_out(ident: Column | str) -> Column:
    """One id in five by its checksum; a null id is held out."""
    c = F.col(ident) if isinstance(ident, str) else ident
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxic_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, learned from labels of rows that are not held out.

    Null and empty texts get the score of a text without any telling word. Repeated rows are scored one by one; empty
    documents give no rows; without usable labels all scores are the same and low.
    """
    model = fit(sample_of(labels.select("doc_id", "toxic").filter(~held_out("doc_id")), docs, rows))
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), scores("text", model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
