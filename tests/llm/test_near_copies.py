"""Near copies of the pipeline against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline as cp
from heliograde.llm import copies

SF = "/root/testdata/sf0.01"


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} - {b""}


def plain_classes(sets):
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


def test_near_copies_equal_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 500").select("doc_id", "text").collect()
    rng = random.Random(3)
    table = [(r.doc_id, r.text) for r in rows]
    for r in rows[:60]:  # planted near copies, some in chains
        words, ident = r.text.split(), 10_000 + 10 * r.doc_id
        for k in range(3):
            words[rng.randrange(len(words))] = f"other{k}"
            table.append((ident + k, " ".join(words)))
    table += [(90_000, None), (90_001, ""), (90_002, "a b"), (90_003, "A  b")]
    got = {r.doc_id: r.component for r in copies.near_copies(spark.createDataFrame(table, "doc_id bigint, text string")).collect()}
    label = plain_classes([plain_shingles(t) for _, t in table])
    assert len(set(zip((got[i] for i, _ in table), label, strict=True))) == len(set(label)) == len(set(got.values()))


def test_stage_drops_planted_near_copies_and_keeps_texts_of_one_id(spark):
    text = " ".join(f"word{k}" for k in range(80))
    near, other = text.replace("word40", "else"), " ".join(f"thing{k}" for k in range(80))
    rows = [(2, near, "en", "s", 1), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (1, other, "en", "s", 1), (3, other, "en", "s", 1), (None, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = cp.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", text), ("1", other), ("None", text)])
