"""Nearest neighbours through a forest of hash prefixes.

Each tree gives every vector a long string of symbols. A symbol is the axis (and its sign) of a random rotation
that the vector is closest to, so near vectors share symbols far more often than others. A tree is the sorted array of these strings. A
query descends in all trees to the longest prefix that it shares with others, then ascends in all trees at once, a symbol
at a time, until the vectors under its prefixes together reach the wanted number; at the root these are all vectors. All of them are compared exactly.

A tree's array is cut at the first symbol, and a crowded part into chunks by a hash of the id, so each task sorts and searches a bounded
piece; queries meet all pieces of their first symbol. Counts of pieces add up, so the ascent is the same however a part is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograde.session import durable

TREES, SYMBOLS, AXES = 32, 5, 32  # trees, symbols of a string, axes of a rotation (2 * AXES symbols)
SHARE, LEAST = 0.4, 2000  # a query ascends until it has this share of all vectors, and so many, counting a vector once in each tree
PIECE = 8192  # vectors of a piece
QUERIES = 2048  # queries that meet a piece at once
SEED = 17


def rotations(dim: int, trees: int, symbols: int, axes: int, seed: int) -> np.ndarray:
    """(dim, trees * symbols * axes): orthonormal axes drawn for each symbol."""
    rng = np.random.default_rng(seed)
    axes = min(axes, dim)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :axes] for _ in range(trees * symbols)], axis=1)


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def _strings(dim: int, kind: str, trees: int, symbols: int, axes: int, seed: int):
    """(id, vector) -> (tree, head, code, id, vec) for each tree: first symbol, all symbols as a number, bytes of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotations(dim, trees, symbols, axes, seed)
        width = turn.shape[1] // (trees * symbols)
        base = 2 * width
        for b in batches:
            for at in range(0, b.num_rows, 512):
                ids, vec = b.column(0).slice(at, 512), b.column(1).slice(at, 512)
                x = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                y = (x.astype(np.float64) @ turn).reshape(len(x), trees, symbols, width)
                k = np.abs(y).argmax(axis=3)
                s = 2 * k + (np.take_along_axis(y, k[..., None], axis=3)[..., 0] > 0)
                code = np.zeros((len(x), trees), dtype=np.int64)
                for j in range(symbols):
                    code = code * base + s[:, :, j]
                raw = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                take = pa.array(np.repeat(np.arange(len(x)), trees))
                cols = [pa.array(np.tile(np.arange(trees, dtype=np.int32), len(x))), pa.array(s[:, :, 0].astype(np.int32).ravel()), pa.array(code.ravel()), ids.take(take), raw.take(take)]
                yield pa.RecordBatch.from_arrays(cols, names=["tree", "head", "code", "id", "vec"])

    return run


def _ranges(codes: np.ndarray, query: np.ndarray, level: int, symbols: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted codes share the first ``level`` symbols with each query."""
    low = base ** (symbols - level)
    start = query // low * low
    return np.searchsorted(codes, start, "left"), np.searchsorted(codes, start + low, "left")


def _count(symbols: int, base: int):
    def run(t: pa.Table) -> pa.Table:
        code, side, ids = t["code"].to_numpy(), t["query"].to_numpy(zero_copy_only=False), t["id"].to_numpy()
        own, q = np.sort(code[~side]), code[side]
        out = []
        for level in range(1, symbols + 1):
            a, z = _ranges(own, q, level, symbols, base)
            out.append(z - a)
        n = np.stack(out, axis=1).astype(np.int64) if len(q) else np.zeros((0, symbols), np.int64)
        return pa.table({"id": pa.array(np.repeat(ids[side], symbols)), "level": pa.array(np.tile(np.arange(1, symbols + 1, dtype=np.int32), len(q))), "n": pa.array(n.ravel())})

    return run


def _search(symbols: int, base: int, kind: str, k: int):
    def run(t: pa.Table) -> pa.Table:
        code, side, ids, level = t["code"].to_numpy(), t["query"].to_numpy(zero_copy_only=False), t["id"].to_numpy(), t["level"].to_numpy(zero_copy_only=False)
        vec = t["vec"].combine_chunks()
        raw = b"".join(x.as_py() for x in vec)
        x = np.frombuffer(raw, dtype=kind).reshape(len(code), -1) if len(code) else np.zeros((0, 1))
        order = np.flatnonzero(~side)[np.argsort(code[~side], kind="stable")]
        own, own_ids, own_x = code[order], ids[order], x[order].astype(np.float64)
        found = []
        for i in np.flatnonzero(side):
            a, z = _ranges(own, code[i : i + 1], int(level[i]), symbols, base)
            other = np.arange(a[0], z[0])
            other = other[own_ids[other] != ids[i]]
            if len(other):
                d = np.sqrt(((own_x[other] - x[i].astype(np.float64)) ** 2).sum(axis=1))
                best = np.lexsort((own_ids[other], d))
                best = best[np.sort(np.unique(own_ids[other][best], return_index=True)[1])][:k] if len(best) else best
                found.append((np.repeat(ids[i], len(best)), own_ids[other][best], d[best]))
        cols = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, (np.int64, np.int64, np.float64)[j]) for j in range(3)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, ident: str = "vec_id", vector: str = "embedding",
    trees: int = TREES, symbols: int = SYMBOLS, axes: int = AXES, share: float = SHARE, least: int = LEAST, seed: int = SEED, piece: int = PIECE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``is_query`` holds for, among all other rows.

    score is the Euclidean distance in double precision; ties go to the smaller id. Vectors that are null, empty, zero, or hold null or
    non-finite parts take no part, nor do null ids or vectors of another length than most. Rows of equal id count as one
    candidate, at its smallest distance, and are never neighbours of each other. An empty table gives an empty result.
    """
    kind = "<f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    rows = vectors.select(F.col(ident).cast("bigint").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, total = sizes["dim"], sizes["n"]
    base = 2 * min(axes, dim)
    rows = rows.filter(F.size("v") == dim)
    text = "tree int, head int, code bigint, id bigint, vec binary"
    strings = _strings(dim, kind, trees, symbols, axes, seed)
    items = durable(rows.select("id", "v").mapInArrow(strings, text))
    asked = durable(rows.filter("query").select("id", "v").mapInArrow(strings, text))
    # trees * 2 * axes rows at most, whatever the table
    parts = items.groupBy("tree", "head").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece)).alias("parts"))
    parts = parts.join(asked.groupBy("tree", "head").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).alias("rows")), ["tree", "head"])
    parts = F.broadcast(durable(parts))
    own, asks = items.join(parts, ["tree", "head"]), asked.join(parts, ["tree", "head"])
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    cell = ["tree", "head", "x", "y"]
    own = own.withColumn("x", part("parts")).withColumn("y", every("rows")).withColumn("query", F.lit(False))
    asks = asks.withColumn("x", every("parts")).withColumn("y", part("rows")).withColumn("query", F.lit(True))
    counts = own.select(*cell, "query", "code", "id").unionByName(asks.select(*cell, "query", "code", "id"))
    counts = counts.groupBy(*cell).applyInArrow(_count(symbols, base), "id bigint, level int, n bigint")
    want = max(least, int(share * total))
    deep = counts.groupBy("id", "level").agg(F.sum("n").alias("n")).groupBy("id").agg(F.coalesce(F.max(F.when(F.col("n") >= want, F.col("level"))), F.lit(0)).alias("level"))
    asks = asks.join(durable(deep.filter("level > 0")), "id")
    own = own.withColumn("level", F.lit(0))
    cols = [*cell, "query", "code", "id", "vec", "level"]
    found = own.select(*cols).unionByName(asks.select(*cols)).groupBy(*cell).applyInArrow(_search(symbols, base, kind, k), "query_id bigint, vec_id bigint, score double")
    found = durable(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    # the root: queries that no symbol gives enough, or k candidates, meet all rows of one tree
    enough = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    weak = durable(asked.filter("tree = 0").join(enough, "id", "left_anti"))
    rows = weak.count()
    if rows:
        size = {"parts": -(-total // piece), "rows": -(-rows // QUERIES)}
        own = items.filter("tree = 0").withColumns({c: F.lit(n).cast("bigint") for c, n in size.items()}).withColumn("query", F.lit(False))
        asks = weak.withColumns({c: F.lit(n).cast("bigint") for c, n in size.items()}).withColumn("query", F.lit(True))
        own, asks = own.withColumn("x", part("parts")).withColumn("y", every("rows")), asks.withColumn("x", every("parts")).withColumn("y", part("rows"))
        all_ = own.withColumn("level", F.lit(0)).withColumn("head", F.lit(0)).select(*cols).unionByName(asks.withColumn("level", F.lit(0)).withColumn("head", F.lit(0)).select(*cols))
        exact = all_.groupBy("x", "y").applyInArrow(_search(symbols, base, kind, k), "query_id bigint, vec_id bigint, score double")
        found = found.unionByName(exact).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
