"""SimHash near duplicates through anchor points.

Fingerprints that differ in at most two bits are linked; a document's class is the set of documents
it can reach over links. Anchors are the code words of two binary Golay codes on bits 0-22 and 23-45: every
23-bit word lies within 3 bits of exactly one code word (covering radius 3). A fingerprint is at home at the
anchor nearest to it. A fingerprint linked to it lies within radius + threshold of that anchor; the bits by which it may
exceed the radius are shared between the two halves, so it visits the anchors whose excesses add up to the threshold at
most. Each pair is compared at an anchor where one of the two is at home.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograde.session import durable

SEED = 42
THRESHOLD = 2
RADIUS, HALF = 3, 23
CHUNK = 2000  # rows of one side compared at once; a crowded anchor is split into chunks

_GENERATOR = 0b101011100011  # generator polynomial of the binary Golay code


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit set where more than half of the shingles' XXH64 have it; 0 without words. Signed 64 bits."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 255 * 256):  # sums of at most 255 bits fit a byte
        bits = np.unpackbits(h[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(text: Column | str) -> Column:
    """Fingerprint column of a text column."""

    @F.arrow_udf(T.LongType())
    def run(t: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x.as_py()) for x in t], pa.int64())

    return run(text)


def hex_digits(c: Column | str) -> Column:
    """A signed 64-bit column as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


@lru_cache(maxsize=1)
def _visits() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each 11-bit syndrome: error patterns e (word ^ e is a code word) of weight at most radius + threshold.

    Returns (first, last) into the flat arrays (pattern, excess over the radius). The first pattern of each is the nearest.
    """
    unit = []
    for b in range(HALF):  # x^b modulo the generator
        r = 1 << b
        for s in range(HALF - 1, 10, -1):
            if r >> s & 1:
                r ^= _GENERATOR << (s - 11)
        unit.append(r)
    by: list[list[tuple[int, int]]] = [[] for _ in range(2048)]
    for w in range(RADIUS + THRESHOLD + 1):
        for bits in combinations(range(HALF), w):
            s = e = 0
            for b in bits:
                s ^= unit[b]
                e |= 1 << b
            by[s].append((e, max(0, w - RADIUS)))
    first = np.cumsum([0, *(len(x) for x in by)])
    flat = np.array([p for x in by for p in x], dtype=np.int64)
    return first[:-1], first[1:], flat[:, 0], flat[:, 1]


@lru_cache(maxsize=1)
def _syndromes() -> np.ndarray:
    """Syndrome of every 23-bit word, by linearity from its two parts."""
    out = np.zeros(1, dtype=np.int16)
    for b in range(HALF):
        r = 1 << b
        for s in range(HALF - 1, 10, -1):
            if r >> s & 1:
                r ^= _GENERATOR << (s - 11)
        out = np.concatenate([out, out ^ r])
    return out


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) -> (anchor): the anchor where each fingerprint is at home."""
    first, _, pattern, _ = _visits()
    syn = _syndromes()
    mask = (1 << HALF) - 1
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        lo, hi = fp & mask, (fp >> HALF) & mask
        yield pa.RecordBatch.from_arrays([pa.array((lo ^ pattern[first[syn[lo]]]) | ((hi ^ pattern[first[syn[hi]]]) << HALF))], names=["anchor"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) -> (anchor, fp, home): one row for each anchor visited, the one at home among them."""
    first, last, pattern, excess = _visits()
    syn = _syndromes()
    mask = (1 << HALF) - 1
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 4096):
            fp = fps[at : at + 4096]
            halves = [(fp >> shift) & mask for shift in (0, HALF)]
            sides = []
            for x in halves:
                s = syn[x]
                n = last[s] - first[s]
                row = np.repeat(np.arange(len(fp)), n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[s], n)
                sides.append((row, x[row] ^ pattern[k], excess[k], k == first[s][row]))
            (r1, c1, e1, h1), (r2, c2, e2, h2) = sides
            # join the two halves of a row: few patterns have an excess, so pair each kind with what is left of the threshold
            out = []
            for spare in range(THRESHOLD + 1):
                a, z = np.flatnonzero(e1 == spare), np.flatnonzero(e2 <= THRESHOLD - spare)
                start = np.searchsorted(r2[z], r1[a], "left")
                n = np.searchsorted(r2[z], r1[a], "right") - start
                i = np.repeat(a, n)
                j = z[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)]
                out.append((c1[i] | (c2[j] << HALF), fp[r1[i]], h1[i] & h2[j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], names=["anchor", "fp", "home"])


def _forest(a: np.ndarray, b: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest linked node) for the nodes of links between a and b: a spanning forest, so never more rows than nodes."""
    if not links:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    x, y = np.concatenate([a[i] for i, _ in links]), np.concatenate([b[j] for _, j in links])
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


_POP = np.array([bin(i).count("1") for i in range(65536)], dtype=np.uint8)


def _compare(home: np.ndarray, all_: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, any) of different fingerprints within the threshold, block by block."""
    out = []
    for at in range(0, len(home), 256):
        d = home[at : at + 256, None] ^ all_[None, :]
        far = np.zeros(d.shape, dtype=np.uint8)
        for shift in (0, 16, 32, 48):
            far += _POP[(d >> shift) & 0xFFFF]
        i, j = np.nonzero((far <= THRESHOLD) & (d != 0))
        if len(i):
            out.append((i + at, j))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell (an anchor, or a pair of chunks of a crowded one) -> links of a spanning forest of each cell."""
    rest = np.zeros((0, 3), dtype=np.int64)

    def run(rows: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(rows[:, 0])) + 1
        a, b = [], []
        for part in np.split(rows, cut):
            at_home = part[:, 2] == 1
            if len(part) > 1 and at_home.any():
                fp = part[:, 1]
                x, y = _forest(fp[at_home], fp[~at_home], _compare(fp[at_home], fp[~at_home]))
                a.append(x)
                b.append(y)
        none = np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], names=["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
        rows = np.concatenate([rest, rows])
        if not len(rows):
            continue
        keep = np.searchsorted(rows[:, 0], rows[-1, 0]) if (np.diff(rows[:, 0]) >= 0).all() else int(np.flatnonzero(np.diff(rows[:, 0]))[-1]) + 1
        rest = rows[keep:]  # the last cell may go on in the next batch
        if keep:
            yield run(rows[:keep])
    if len(rest):
        yield run(rest)


def near_links(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect exactly what links of at most two bits connect, for a column ``fp`` of distinct fingerprints.

    Only anchors where someone is at home count, and those are few among all: the join drops most visits. An anchor with at
    most ``chunk`` rows at home is one cell. In a more crowded one, home rows and all rows are cut into parts and every pair of
    parts is a cell: the same comparisons, spread over tasks.
    """
    homes = fps.select("fp").mapInArrow(_homes, "anchor bigint").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    homes = durable(homes.select("anchor", F.ceil(F.col("n") / F.lit(chunk)).alias("parts")))
    both = fps.select("fp").mapInArrow(_anchors, "anchor bigint, fp bigint, home boolean").join(homes, "anchor")
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    sides = F.explode(F.when(F.col("home"), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0))))
    rows = both.select("anchor", "fp", "parts", own.alias("own"), sides.alias("side"))
    # a home row goes to every part of all rows, any row goes to every part of the home rows
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    first, second = F.when(F.col("side") == 1, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 1, F.col("other")).otherwise(F.col("own"))
    cells = rows.select(F.xxhash64("anchor", first, second).alias("cell"), "fp", F.col("side").cast("bigint").alias("home"))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links, "a bigint, b bigint").distinct()


def reachable(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches.

    Alternates two steps until the links stop changing: hang all larger neighbours of a node on its smallest one, then
    all smaller neighbours likewise. The count of links never grows and no row holds a node's whole neighbourhood.
    """
    edges = durable(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))  # node, neighbour
        low = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(low, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = large.filter("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = small.unionByName(least.select("hi", F.col("m").alias("lo"))).filter("hi <> lo").distinct()
        edges = durable(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
        state = now


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, fp, component_id) for every row; component_id is the smallest ident reachable over links of at most two bits.

    Null and empty texts have fingerprint 0 and are linked like any other. Equal fingerprints share a class. A null ident keeps
    its row and its class, and counts as smallest only where a class has no other. Repeated rows stay; an empty table gives none.
    """
    base = durable(docs.select(F.col(ident).alias("ident"), fingerprints(F.col(text)).alias("fp")))
    least = durable(base.groupBy("fp").agg(F.min("ident").alias("least")))
    label = durable(reachable(near_links(least)))
    group = F.coalesce("label", "fp")
    classed = least.join(label, least.fp == label.node, "left").select("fp", "least", group.alias("grp"))
    first = classed.groupBy("grp").agg(F.min("least").alias("component_id"))
    named = durable(classed.join(first, "grp").select("fp", "component_id"))
    return base.join(named, "fp").select(F.col("ident").alias(ident), "fp", "component_id")
