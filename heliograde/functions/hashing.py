"""Deterministic draws: every 'random' choice is an integer hash of a key.

The same arithmetic runs in any SQL engine on BIGINT, so samples can be compared exactly. Keys are mixed by xor-shifts and
odd multipliers in two rounds with different parts of the seed before each, so orders of two seeds, and draws for neighbouring
keys, are unrelated.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 31
MASK = SPAN - 1
# Odd multipliers below 2^31, so that products of 31-bit values stay within BIGINT.
FIRST, SECOND = 0x7FEB352D, 0x46CA68B5


def _plain(x: int) -> int:
    """The same mixing of one Python integer."""
    x = ((x ^ (x >> 16)) * FIRST) & MASK
    x = ((x ^ (x >> 15)) * SECOND) & MASK
    return x ^ (x >> 16)


def _seed_parts(seed: int) -> tuple[int, int]:
    a = _plain((seed * 2 + 1) & MASK)
    return a, _plain(a ^ 0x2545F491)


def hash_value(key: int, seed: int = 0) -> int:
    """``hash_order`` of one Python integer."""
    a, b = _seed_parts(seed)
    x = ((key ^ (key >> 31)) & MASK) ^ a
    x = (((x ^ (x >> 16)) * FIRST) & MASK) ^ b
    x = ((x ^ (x >> 15)) * SECOND) & MASK
    x = ((x ^ (x >> 16)) * FIRST) & MASK
    return x ^ (x >> 15)


def hash_order(key: Column | str, seed: int = 0) -> Column:
    """Position of ``key`` in a pseudo-random order, a BIGINT in [0, 2^31)."""
    c = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    a, b = _seed_parts(seed)
    long = lambda v: F.lit(v).cast("bigint")
    steps = [F.struct(F.lit(n).alias("n"), long(m).alias("m"), long(x).alias("x")) for n, m, x in ((16, FIRST, b), (15, SECOND, 0), (16, FIRST, 0), (15, 1, 0))]
    start = c.bitwiseXOR(F.shiftright(c, 31)).bitwiseAND(long(MASK)).bitwiseXOR(long(a))
    # a fold over the steps names its input once in each, where nested columns would copy it
    step = lambda v, p: (v.bitwiseXOR(F.call_function("shiftright", v, p["n"])) * p["m"]).bitwiseAND(long(MASK)).bitwiseXOR(p["x"])
    return F.aggregate(F.array(*steps), start, step)


def hash_array(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """``hash_order`` of an array of 64-bit integers, as unsigned 32-bit ones: only the low 31 bits of a product are kept."""
    k = keys.astype(np.int64)
    return mixed(((k ^ (k >> 31)) & MASK).astype(np.uint32), seed)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """``hash_order`` of 31-bit values, which it overwrites: unsigned 32-bit ones, so nothing is made but one array of their size."""
    a, b = _seed_parts(seed)
    x ^= np.uint32(a)
    t = np.empty_like(x)
    for n, m, s in ((16, FIRST, b), (15, SECOND, 0), (16, FIRST, 0)):
        x ^= np.right_shift(x, np.uint32(n), out=t)
        x *= np.uint32(m)
        x &= np.uint32(MASK)
        x ^= np.uint32(s)
    x ^= np.right_shift(x, np.uint32(15), out=t)
    return x


def draw_batches(a: Column | str, b: Column | str, seed: int = 0) -> Column:
    """``draw`` of a pair in Arrow batches: for very many rows, where a fold per row is slow."""

    @F.arrow_udf("bigint")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        left, right = (hash_array(v.cast(pa.int64()).to_numpy(zero_copy_only=False), seed + k) for k, v in ((1, x), (2, y)))
        return pa.array(hash_array(left ^ right, seed).astype(np.int64))

    return run(a, b)


def hash_order_sql(key: str, seed: int = 0) -> str:
    """The same order as SQL text."""
    a, b = _seed_parts(seed)
    fold = lambda x, n: f"xor({x}, {x} >> {n})"
    x = f"xor({fold(f'({key})::BIGINT', 31)} & {MASK}, {a})"
    steps = [(16, FIRST, b), (15, SECOND, 0), (16, FIRST, 0)]
    # each step names its input once, through a one-row list, so that the text stays short
    for n, m, s in steps:
        x = f"list_transform([{x}], lambda v: xor(((xor(v, v >> {n})) * {m}) & {MASK}, {s}))[1]"
    return f"list_transform([{x}], lambda v: xor(v, v >> 15))[1]"


def uniform(key: Column | str, seed: int = 0) -> Column:
    """Hash draw in [0, 1)."""
    return hash_order(key, seed) / F.lit(float(SPAN))


def uniform_sql(key: str, seed: int = 0) -> str:
    return f"({hash_order_sql(key, seed)} / {float(SPAN)}::DOUBLE)"


def draw(a: Column | str, b: Column | str, seed: int = 0) -> Column:
    """Hash draw of a pair in [0, 2^31): each part is mixed on its own before both are mixed together."""
    return hash_order(hash_order(a, seed + 1).bitwiseXOR(hash_order(b, seed + 2)), seed)


def draw_sql(a: str, b: str, seed: int = 0) -> str:
    return hash_order_sql(f"xor({hash_order_sql(a, seed + 1)}, {hash_order_sql(b, seed + 2)})", seed)


def poisson_limits() -> list[int]:
    """Limits on a draw: its Poisson(1) value is how many of them it reaches. They end where none of the 2^31 draws is left."""
    out, cdf, p, k = [], 0.0, math.exp(-1.0), 0
    while True:
        cdf += p
        limit = round(cdf * SPAN)
        if limit >= SPAN:
            return out
        out.append(limit)
        k += 1
        p /= k


def hash_steps_sql(source: str, col: str, seed: int = 0) -> str:
    """``source`` (a SELECT) with its BIGINT column ``col`` hashed, a step in each nested query: for many rows."""
    a, b = _seed_parts(seed)
    q = f"SELECT * REPLACE (xor(xor({col}, {col} >> 31) & {MASK}, {a}) AS {col}) FROM ({source})"
    for n, m, s in ((16, FIRST, b), (15, SECOND, 0), (16, FIRST, 0)):
        q = f"SELECT * REPLACE (xor((xor({col}, {col} >> {n}) * {m}) & {MASK}, {s}) AS {col}) FROM ({q})"
    return f"SELECT * REPLACE (xor({col}, {col} >> 15) AS {col}) FROM ({q})"
