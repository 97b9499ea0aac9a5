"""Near copies: texts whose sets of word shingles overlap by a given Jaccard similarity, linked into classes.

Candidates share a class of SimHash fingerprints, found at anchor points (``simhash``), or a band of MinHash values, for pairs whose
fingerprints differ in more bits than anchors carry: a pair at the default similarity of 0.8 shares none of the 40 bands of 6 with a
probability of 5e-6. Every candidate is then counted exactly on its shingles. Texts with one set of shingles are one node. In a bucket
all nodes meet one of its nodes first. Nodes of buckets that links do not connect then go, with their shingles, to cells: a cell holds the
nodes of a group of buckets that overlap, or two parts of a large group, and compares them inside a task. So most of a
large group of copies is connected at linear cost, no bucket is cut and no table of pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograde.llm.simhash import SEED, fingerprint, near_links, reachable
from heliograde.session import discard, durable

SHINGLE, SIMILARITY = 5, 0.8
BANDS, WIDTH = 40, 6
PART = 1000  # nodes of a part of a group; a cell holds two at most
ROWS = 500  # rows whose sets leave a task at once


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of lower-case words; a shorter text is one shingle, none has no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8"))


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = rng.integers(0, 2**64, (2, BANDS * WIDTH), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def bands(grams: np.ndarray) -> list[int]:
    """One hash for each band of MinHash values; the band's number is part of it."""
    a, b = _permutations()
    low = np.full(BANDS * WIDTH, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(grams), 256):
        np.minimum(low, (grams[at : at + 256, None] * a + b).min(axis=0), out=low)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - 2**63 for k, row in enumerate(low.reshape(BANDS, WIDTH))]


def digest(text: Column | str) -> Column:
    """Tells texts apart; null is a text of its own."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles reach the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")

    n = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("c"))
    return n.filter(F.col("c") >= F.lit(similarity - 1e-12) * (F.col("n") - F.col("c"))).select("a", "b")


def _joined(sizes: np.ndarray, side: np.ndarray, own: np.ndarray, grams: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Index pairs that connect what links between the sides of a cell (or inside its only one) connect; ``grams`` holds the sets one after the other.

    Nodes go by size, so those that can be similar follow at once, and one pass over their shingles counts what they share with a node.
    """
    order = np.argsort(sizes, kind="stable")
    ends = np.cumsum(sizes)
    shingle = np.unique(grams, return_inverse=True)[1]
    flat = np.concatenate([shingle[ends[i] - sizes[i] : ends[i]] for i in order.tolist()])
    size, side = sizes[order], side[order]
    last = np.cumsum(size)
    first = last - size
    label = np.unique(own[order], return_inverse=True)[1]
    crossed = side.min() != side.max()
    mark = np.zeros(len(flat), dtype=bool)
    upto = np.searchsorted(size, size / (similarity - 1e-12), side="right")
    out = []
    for i in range(len(order) - 1):
        near = slice(i + 1, upto[i])
        meets = label[near] != label[i]
        if crossed:
            meets &= side[near] != side[i]
        if not meets.any():
            continue
        mark[flat[first[i] : last[i]]] = True
        shared = np.append(0, np.cumsum(mark[flat[last[i] : last[upto[i] - 1]]]))
        mark[flat[first[i] : last[i]]] = False
        c = shared[last[near] - last[i]] - shared[first[near] - last[i]]
        hits = np.flatnonzero(meets & (c >= (similarity - 1e-12) * (size[i] + size[near] - c)))
        for j in (hits + i + 1).tolist():
            if label[j] != label[i]:
                out.append((order[i], order[j]))
                label[label == label[j]] = label[i]
    return out


def _cell_links(similarity: float):
    """Rows (cell, side, node, own, grams) sorted by cell -> (a, b)."""

    def run(table: pa.Table) -> pa.RecordBatch:
        cell, side, node, own = (table[c].to_numpy() for c in ("cell", "side", "node", "own"))
        sets = table["grams"].combine_chunks()
        ends = np.append(0, np.cumsum(sets.value_lengths().to_numpy()))
        grams = sets.flatten().to_numpy()
        a, b = [], []
        starts = np.append(0, np.flatnonzero(np.diff(cell)) + 1)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
            for i, j in _joined(np.diff(ends[lo : hi + 1]), side[lo:hi], own[lo:hi], grams[ends[lo] : ends[hi]], similarity):
                a.append(min(node[lo + i], node[lo + j]))
                b.append(max(node[lo + i], node[lo + j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            keep = int(np.flatnonzero(np.append(True, np.diff(table["cell"].to_numpy())))[-1])  # the last cell may go on in the next batch
            rest = table.slice(keep)
            if keep:
                yield run(table.slice(0, keep))
        if rest is not None:
            yield run(rest)

    return cells


def _settled(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between nodes of open buckets (key, node, own) that connect all that such links connect.

    Buckets that share nodes are one group, so a node goes out once, or once for each part of a group of more than ``PART`` nodes.
    """
    hub = open_.groupBy("key").agg(F.min("node").alias("b"))
    group = durable(reachable(open_.join(hub, "key").select(F.col("node").alias("a"), "b")))
    nodes = durable(open_.select("node", "own").distinct().join(group, "node", "left").select("node", "own", F.coalesce("label", "node").alias("grp")))
    parts = nodes.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).alias("parts"))
    own, other = F.pmod(F.xxhash64("node"), F.col("parts")), F.col("other")
    laid = nodes.join(parts, "grp").select("*", own.alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"))
    cell = F.xxhash64("grp", F.least("part", other), F.greatest("part", other))
    laid = laid.select(cell.alias("cell"), (F.col("part") > other).cast("bigint").alias("side"), "node", "own").join(sets, "node")
    rows = laid.select("cell", "side", "node", "own", "grams").repartition("cell").sortWithinPartitions("cell")
    return rows.mapInArrow(_cell_links(similarity), "a bigint, b bigint")


def near_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(ident, digest, component) for every row: ``component`` is the class of the text, ``digest`` tells texts of one ident apart.

    Fingerprints are those of ``simhash``; their classes bring candidates, which count only where the shingles are similar.
    Null and empty texts are one class. Nodes are named by 64-bit hashes of their shingles. Bands are made for similarities of about 0.8
    and more; below that a share of the pairs meets in none.
    """

    kind = docs.schema[ident].dataType.simpleString()

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                yield some(b.slice(at, ROWS))

    def some(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x.as_py(), shingle) for x in b.column(2)]
        node = pa.array([xxhash.xxh64_intdigest(g.tobytes(), SEED) - 2**63 for g in sets], pa.int64())
        grams = pa.array([g.view("<i8") for g in sets], pa.list_(pa.int64()))
        keys = pa.array([bands(g) if len(g) else [] for g in sets], pa.list_(pa.int64()))
        fp = pa.array([fingerprint(x.as_py()) for x in b.column(2)], pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, grams, keys, fp], names=["ident", "digest", "node", "grams", "bands", "fp"])

    named = docs.select(F.col(ident).alias("ident"), digest(text).alias("digest"), F.col(text).alias("text"))
    base = durable(named.mapInArrow(signs, f"ident {kind}, digest string, node bigint, grams array<bigint>, bands array<bigint>, fp bigint"))
    alike = durable(reachable(near_links(base.select("fp").distinct()))).select(F.col("node").alias("fp"), "label")
    prints = base.select("node", F.size("grams").alias("size"), "fp").distinct().join(alike, "fp", "left")
    prints = prints.select("node", "size", F.xxhash64(F.lit("fp"), F.coalesce("label", "fp")).alias("key"))
    nodes = base.select("node", F.size("grams").alias("size"), "bands").dropDuplicates(["node"])
    keyed = durable(nodes.select("node", "size", F.explode("bands").alias("key")).unionByName(prints.distinct()))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    met = durable(keyed.join(shared, "key"))
    discard(keyed)  # large tables go as soon as the next one is written
    close = F.least("size", "size_b") >= F.lit(similarity - 1e-12) * F.greatest("size", "size_b")
    sets = durable(base.select("node", "grams").join(met.select("node").distinct(), "node").dropDuplicates(["node"]))
    rows = durable(base.select("ident", "digest", "node"))
    discard(base)
    hub = met.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node", "size")).alias("f"))
    hub = hub.select("key", F.col("f.node").alias("b"), F.col("f.size").alias("size_b"))
    pairs = met.join(hub, "key").filter("node <> b").filter(close).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    pairs = durable(pairs)
    links = durable(_links(pairs, sets, similarity))
    label = durable(reachable(links))
    placed = durable(met.join(label, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("own")))
    mixed = placed.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo < hi").select("key")
    open_ = durable(placed.join(mixed, "key"))  # buckets whose nodes are not all connected yet
    more = durable(_settled(open_, sets, similarity))
    label = durable(reachable(links.unionByName(more)))
    for table in (met, sets, pairs, links, placed, open_, more):
        discard(table)
    return rows.join(label, "node", "left").select(F.col("ident").alias(ident), "digest", F.coalesce("label", "node").alias("component"))
