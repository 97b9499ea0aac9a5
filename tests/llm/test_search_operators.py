"""Near duplicates, repeated passages, nearest neighbours and tokens against brute force; the pipeline as a whole."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from heliograde.llm import forest, pieces, quality, queries, simhash, substrings

SF = "/root/testdata/sf0.001"
TEXTS = "doc_id bigint, text string"


# --- simhash -----------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps, ids):
    label = {i: i for i in ids}
    change = True
    while change:
        change = False
        for a, x in zip(ids, fps, strict=True):
            for b, y in zip(ids, fps, strict=True):
                if (x ^ y).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    change = True
    return label


def test_fingerprints_match_the_rule():
    rng = random.Random(2)
    texts = ["", None, "One", "one two", "A B C", " ".join(rng.choice("abcdefg") for _ in range(1000)), "É é ABC", "x y z"]
    texts += [" ".join(str(rng.randrange(9)) for _ in range(rng.randrange(1, 400))) for _ in range(30)]
    for t in texts:
        assert simhash.fingerprint(t) & (2**64 - 1) == plain_fingerprint(t)


def test_long_text_sums_do_not_overflow():
    text = " ".join(str(k % 7919) for k in range(140_000))
    assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def test_golay_anchors_cover():
    """Every word has one anchor within 3 bits in each half, and linked words visit each other's anchor."""
    first, last, pattern, excess = simhash._visits()
    assert len(first) == 2048 and (excess[first] == 0).all()
    rng = np.random.default_rng(0)
    fp = rng.integers(-(2**63), 2**63 - 1, 300)
    home = next(iter(simhash._homes(iter([pa.RecordBatch.from_arrays([pa.array(fp)], names=["fp"])])))).column(0).to_numpy()
    for bits in (0, 1, 2):
        flip = np.array([sum(1 << int(b) for b in rng.choice(63, bits, replace=False)) for _ in fp], dtype=np.int64)
        seen = pa.Table.from_batches(list(simhash._anchors(iter([pa.RecordBatch.from_arrays([pa.array(fp ^ flip)], names=["fp"])])))).to_pandas()
        visits = set(zip(seen.fp, seen.anchor, strict=True))
        assert all((x, a) in visits for x, a in zip(fp ^ flip, home, strict=True))


@pytest.mark.parametrize("chunk", [2000, 5])
def test_links_connect_what_brute_force_connects(spark, chunk):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:6]:  # crowded neighbourhoods and chains
        x = base
        for _ in range(25):
            x ^= 1 << rng.randrange(64)
            fps.add(x)
        fps |= {base ^ (1 << a) ^ (1 << b) for a, b in [(rng.randrange(64), rng.randrange(64)) for _ in range(30)]}
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), chunk)
    label = {r.node: r.label for r in simhash.reachable(links).collect()}
    want = plain_classes([x & (2**64 - 1) for x in signed], signed)
    assert {x: label.get(x, x) for x in signed} == want


def test_near_duplicates_on_documents(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = base.collect()
    got = {r.doc_id: r for r in simhash.near_duplicates(base).collect()}
    fps = [plain_fingerprint(r.text) for r in rows]
    want = plain_classes(fps, [r.doc_id for r in rows])
    for r, f in zip(rows, fps, strict=True):
        assert got[r.doc_id].fp & (2**64 - 1) == f and got[r.doc_id].component_id == want[r.doc_id]


def test_near_duplicate_edges(spark):
    rows = [(5, None), (2, ""), (9, " \n"), (7, "a b c"), (7, "a b c"), (None, "a b c"), (8, "A  B\tc"), (None, "z " * 50_000)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, TEXTS).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.fp == 0} == {2} and {r.component_id for r in got if r.doc_id in (7, 8)} == {7}
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["7", "None"]
    assert simhash.near_duplicates(spark.createDataFrame([], TEXTS)).count() == 0


def test_chain_of_links(spark):
    """A long path needs many steps; its label still arrives."""
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    assert {r.label for r in simhash.reachable(links).collect()} == {0}


# --- repeated passages -------------------------------------------------------------------


def plain_removal(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removal(spark, rows, window):
    got = substrings.remove_repeats(spark.createDataFrame(rows, TEXTS), window=window).collect()
    for r in got:
        assert r.kept is None or hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str)


@pytest.mark.parametrize("together", [20, 200_000])  # windows of equal words meet in a group, or in a task
@pytest.mark.parametrize(("window", "words"), [(50, 5000), (5, 3), (8, 2), (50, 1), (3, 40)])
def test_removal_equals_brute_force(spark, monkeypatch, window, words, together):
    parts = substrings._window_rows
    def patched(w):
        inner = parts(w)
        def run(batches):
            substrings.TOGETHER = together  # in the Python worker
            yield from inner(batches)
        return run
    monkeypatch.setattr(substrings, "_window_rows", patched)
    rng = random.Random(window * 1000 + words)
    word = lambda: f"w{rng.randrange(words)}"
    shared = [[word() for _ in range(rng.randrange(window, 3 * window))] for _ in range(4)]
    rows = []
    for i in range(40):
        t = [word() for _ in range(rng.randrange(0, 3 * window))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t[at:at] = rng.choice(shared)
        rows.append((rng.randrange(60), "  ".join(t)))
    rows += rows[:3] + [(99, rows[0][1]), (100, rows[1][1]), (None, rows[0][1]), (101, None), (102, "")]
    assert removal(spark, rows, window) == plain_removal(rows, window)


def test_removal_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert removal(spark, rows, 50) == plain_removal(rows, 50)


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(4)
    for _ in range(60):
        window, voc = rng.choice([3, 6, 50]), rng.choice([1, 2, 4, 30])
        passage = [b"p%d" % rng.randrange(voc) for _ in range(2 * window)]
        texts = [[b"p%d" % rng.randrange(voc) for _ in range(rng.randrange(80))] + passage + [b"p%d" % rng.randrange(voc) for _ in range(rng.randrange(80))] for _ in range(3)]
        flat = [w for t in texts for w in t]
        p, name, place = substrings.anchors(substrings.word_hashes(flat), np.array([len(t) for t in texts]), window)
        seen = {}
        for at, n, where in zip(p, name, place, strict=True):
            assert seen.setdefault(tuple(flat[at : at + window]), (n, where - at)) == (n, where - at)


def test_removal_edges(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], TEXTS)).count() == 0
    long = "same " * 30_000
    rows = [(1, long), (2, long), (3, "x " + long), (4, "short one"), (5, "short one")]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(rows, TEXTS).withColumn("sha", F.lit("clash")).withColumn("kept", F.lit(1))).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed, got[3].kept, got[4].n_removed, got[5].n_removed) == (0, 30_000, 30_000, "x", 0, 0)


# --- nearest neighbours ------------------------------------------------------------------


def plain_nearest(ids, x, k):
    out = {}
    for q in range(len(ids)):
        if ids[q] % 100 == 0:
            d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
            out[ids[q]] = [(int(ids[j]), d[j]) for j in order]
    return out


def test_recall_on_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = table.toPandas()
    want = plain_nearest(rows.vec_id.values, np.stack(rows.embedding).astype(np.float64), 10)
    got = forest.search(table, F.col("vec_id") % 100 == 0).toPandas()
    hits = 0
    for q, near in want.items():
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and mine.score.is_monotonic_increasing
        hits += len({v for v, _ in near} & set(mine.vec_id))
        exact = dict(near)
        assert all(exact.get(v, s) == pytest.approx(s, abs=1e-12) for v, s in zip(mine.vec_id, mine.score, strict=True))
    assert hits / (10 * len(want)) >= 0.9


def test_full_ascent_in_small_pieces_is_exact(spark):
    """With every vector wanted and one symbol of two axes' worth, pieces and query chunks change nothing."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    x[50:150] = x[7]  # a group of equal vectors
    ids = np.arange(400) * 25
    table = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")
    got = forest.search(table, F.col("vec_id") % 100 == 0, trees=60, symbols=2, axes=1, share=1.0, piece=37).toPandas()
    for q, near in plain_nearest(ids, x, 10).items():
        mine = got[got.query_id == q].sort_values("rank")
        assert [int(v) for v in mine.vec_id] == [v for v, _ in near]


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (100, [0.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("tree", F.lit("clash"))
    got = forest.search(table, F.col("vec_id") % 100 == 0, trees=40).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(0, 1, 8), (0, 2, 100), (100, 1, 8), (100, 2, 0)}
    assert forest.search(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert forest.search(table.filter("vec_id > 0 AND vec_id < 9"), F.col("vec_id") % 100 == 0).count() == 0


# --- tokens ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path(queries.MODEL))


@pytest.fixture(scope="module")
def own():
    return pieces.load(pieces.model_path(queries.MODEL))


def test_tokens_equal_the_library(own, library):
    rng = random.Random(11)
    parts = ["a", "b", " ", "  ", "     ", "\n", "\t", "é", "ﬁ", "▁", "😀", ".", "the ", "ing", "1", "23", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "　", "q", "日", "本", "\r", "‍", "T", "!!!", "...", "$$$"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    texts += [" " * n + "a" for n in (*range(1, 70), 5000)] + ["a" * 3000, "\n" * 500, "é" * 999]
    for t in texts:
        ids = own.encode(t)
        assert list(ids) == library.encode(t) and own.decode(ids) == library.decode(library.encode(t)), repr(t)


def test_decoding_any_ids(own, library):
    rng = random.Random(12)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(0, 3), rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 6))]
        if 0 not in ids:
            assert own.decode(ids) == library.decode(ids), ids


def test_tokens_of_documents(spark, library):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text for r in base.collect()}
    for r in pieces.digests(pieces.encode_decode(base, queries.MODEL)).collect():
        ids = library.encode(text[r.doc_id])
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_token_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "word " * 40_000)]
    got = pieces.encode_decode(spark.createDataFrame(rows, TEXTS).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit("clash")), queries.MODEL).collect()
    assert len(got) == len(rows) and {(r.doc_id, tuple(r.ids), r.decoded) for r in got if r.doc_id in (1, 2)} == {(1, (), ""), (2, (), "")}
    assert [r.decoded for r in got if r.doc_id == 3] == ["word " * 40_000]
    none = pieces.digests(pieces.encode_decode(spark.createDataFrame([], TEXTS), queries.MODEL))
    assert none.count() == 0 and none.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


# --- the pipeline ------------------------------------------------------------------------


def first_of_near_copies(texts):
    """The smallest id of each class linked by a Jaccard similarity of 0.8 or more of five-word shingles, by comparing all pairs that share one."""
    grams = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    least = {i: i for i in texts}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    at = defaultdict(list)
    for i, g in grams.items():
        for x in g:
            at[x].append(i)
    for a, b in {(a, b) for own in at.values() for a in own for b in own if a < b}:
        both = len(grams[a] & grams[b])
        if both >= 0.8 * (len(grams[a]) + len(grams[b]) - both) - 1e-9:
            x, y = sorted((root(a), root(b)))
            least[y] = x
    return {i for i in texts if root(i) == i}


def test_pipeline_stages(spark, library):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(cp.STAGES)
    out, frames = docs, []
    for name in stages:
        out = spark.createDataFrame(stages[name](spark, out, SF).collect(), stages[name](spark, out, SF).schema)
        frames.append({r.doc_id: r for r in out.collect()})
    after_rules, after_near, after_cut, mixed, tokens = frames
    assert all(f and list(next(iter(f.values())).asDict()) == cp.COLUMNS for f in frames[:4])
    judged = {r.doc_id: r.kept for r in quality.with_quality(docs, "q").select("doc_id", "q.kept").collect()}
    assert set(after_rules) == {i for i, k in judged.items() if k}
    ids = sorted(after_rules)
    assert set(after_near) == first_of_near_copies({i: after_rules[i].text for i in ids})
    want = {i: (w, n, s) for i, w, n, s in plain_removal([(i, r.text) for i, r in after_near.items()], 50)}
    assert set(after_cut) == {i for i, (w, n, _) in want.items() if n < w}
    for i, r in after_cut.items():
        assert r.text == after_near[i].text if not want[i][1] else hashlib.sha256(r.text.encode()).hexdigest() == want[i][2]
        assert r.n_chars == len(r.text)
    words = {i: len(r.text.encode().split()) for i, r in after_cut.items()}
    taken = sum(words[i] for i in mixed)
    assert set(mixed) <= set(after_cut) and taken <= cp.PART * sum(words.values()) and all(mixed[i] == after_cut[i] for i in mixed)
    assert set(tokens) == set(mixed)
    for i, r in tokens.items():
        assert list(r.ids) == library.encode(mixed[i].text) and r.n_tokens == len(r.ids)


def test_pipeline_takes_empty_and_odd_tables(spark):
    import corpus_pipeline as cp

    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
    text = " ".join(f"word{k}" for k in range(80))
    odd = [(1, text, None, None, None, "x"), (1, text, "en", "src0", 5, "x"), (None, text, "en", "src0", 5, "x"), (2, None, None, None, None, None), (3, "", "en", "src1", 0, None)]
    for rows in ([], odd):
        out = spark.createDataFrame(rows, kind)
        for _, stage in cp.STAGES:
            df = stage(spark, out, SF)
            out = spark.createDataFrame(df.collect(), df.schema)
        assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"]
