"""Near copies compared inside tasks, and candidates from SimHash classes."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from heliograde.llm import copies
from test_near_copies import plain_classes, plain_shingles


def variants(n, seed=5):
    """Texts of one origin of which most pairs share a band but are not similar enough, some in chains."""
    rng = random.Random(seed)
    base = [f"word{k}" for k in range(100)]
    out = []
    for k in range(n):
        words = list(base if k % 5 else (out[-1].split() if out else base))
        for _ in range(3 if k % 5 else 1):
            words[rng.randrange(100)] = f"other{k}x{rng.randrange(9)}"
        out.append(" ".join(words))
    return out


def test_no_table_of_pairs(spark, monkeypatch):
    texts = variants(400)
    rows, links, stored = [], [], copies.durable

    def seen(df):
        table = stored(df)
        (links if table.columns == ["a", "b"] else rows).append(table.count())
        return table

    monkeypatch.setattr(copies, "durable", seen)
    monkeypatch.setattr(copies, "PART", 90, raising=False)  # several parts
    got = {r.doc_id: r.component for r in copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert max(links) <= len(texts) * copies.BANDS  # 400 texts make about 50,000 pairs in buckets
    label = plain_classes([plain_shingles(t) for t in texts])
    assert len({(got[i], label[i]) for i in got}) == len(set(label)) == len(set(got.values()))


def test_cells_connect_what_pairs_connect():
    sets = [copies.shingles(t) for t in variants(120, 9)]
    own = np.array([k // 2 if k < 20 else k for k in range(120)])
    for side in (np.zeros(120, dtype=int), np.arange(120) % 2):
        links = [(i, j) for i in range(120) for j in range(i) if own[i] == own[j]]
        found = copies._joined(np.array([len(s) for s in sets]), side, own, np.concatenate(sets), 0.8)
        inside = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
        assert found and all(inside(i, j) and (side.max() == 0 or side[i] != side[j]) for i, j in found)
        want = links + [(i, j) for i in range(120) for j in range(i) if inside(i, j) and (side.max() == 0 or side[i] != side[j])]
        assert classes(120, links + found) == classes(120, want)


def classes(n, links):
    label = list(range(n))
    for i, j in links:
        lo, hi = sorted((label[i], label[j]))
        label = [lo if x == hi else x for x in label]
    return label


def test_batches_may_cut_a_cell():
    texts = variants(40, 2)
    sets = [copies.shingles(t).view("<i8") for t in texts]
    cell = [k // 20 for k in range(40)]
    table = pa.table({"cell": pa.array(cell, pa.int64()), "side": pa.array([0] * 40, pa.int64()), "node": pa.array(range(40), pa.int64()), "own": pa.array(range(40), pa.int64()), "grams": pa.array(sets, pa.list_(pa.int64()))})
    run = copies._cell_links(0.8)
    whole, cut = (sorted(x for b in run(table.to_batches(max_chunksize=m)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) for m in (40, 7))
    assert whole and whole == cut


def test_fingerprint_classes_bring_candidates(spark):
    """Fingerprints that a repeated line settles are alike at anchors, while no band of so small a similarity is shared."""
    line = " ".join(f"line{k}" for k in range(7))
    texts = [" ".join([line] * 60 + [f"{c}{k}" for k in range(6)]) for c in "pq"]
    grams = [copies.shingles(t) for t in texts]
    assert (copies.fingerprint(texts[0]) ^ copies.fingerprint(texts[1])).bit_count() <= 2 and not set(copies.bands(grams[0])) & set(copies.bands(grams[1]))
    got = copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), similarity=0.2).collect()
    assert len({r.component for r in got}) == 1
