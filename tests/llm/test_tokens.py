"""Byte pairs, tokenizer alignment and importance resampling against the libraries and plain loops."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from heliograde.llm import alignment as A
from heliograde.llm import bytepairs as B
from heliograde.llm import queries as Q
from heliograde.llm import resampling as R
from heliograde.session import durable

P = pytest.importorskip("public_tokenizers")
ODD = ["", None, " ", "a", "\n\n  x", "<|endoftext|> x", "don't  we'll", "▁x ▁", "a\u0000b", "日本語 テキスト", "🙂🙂 é é", "x" * 5000, "ab" * 3000, " " * 999 + "y"]


def some_texts(n=3000):
    rng = random.Random(5)
    parts = ["the", "The", "ing", "12", "3.5", "é", "ß", "'s", " ", "  ", "\n", "日", "🙂", "zq", "aaa", "abab", ",", "—", "\t"]
    return ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 30))) for _ in range(n)] + ODD


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(some_texts())], "doc_id long, text string").repartition(3)


def tiktoken_encoding():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs_equal_the_library(spark, frame):
    enc = tiktoken_encoding()
    got = {r.doc_id: r for r in B.encode_decode(frame, "byte_bpe_multi_50k.tiktoken").collect()}
    for i, t in enumerate(some_texts()):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == enc.encode_ordinary(t or ""), ascii(t)
        assert got[i].decoded == (t or "").encode()


def test_byte_pairs_of_a_merge_list_equal_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    texts = [t or "" for t in some_texts()]
    got = B.load(P.path("byte_bpe_50k.json")).encode_block(texts)
    for t, a, b in zip(texts, got, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(a, "<u4").tolist() == b.ids, ascii(t)


def lowest_rank_first(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_replay_with_ranks_in_any_order():
    """Vocabularies whose merges come up late (a pair of lower rank appears after a higher one) are encoded as the plain rule says."""
    rng = random.Random(2)
    for _ in range(15):
        longer = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(60)})
        rng.shuffle(longer)
        raw = [bytes([b]) for b in range(256)] + longer
        pairs = B.BytePairs(raw, None, False)
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
        ranks = {b: i for i, b in enumerate(raw)}
        for w, got in zip(words, pairs.replay(words), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == lowest_rank_first(w, ranks)


def test_byte_pair_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert B.digests(B.encode_decode(none, "byte_bpe_multi_50k.tiktoken")).count() == 0
    odd = spark.createDataFrame([(1, "same", 1), (1, "same", 2), (None, None, 3)], "doc_id long, text string, ids int")
    got = B.digests(B.encode_decode(odd, "byte_bpe_multi_50k.tiktoken")).collect()
    n = len(tiktoken_encoding().encode_ordinary("same"))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (1, n), (1, n)]
    assert {r.decoded_sha256 for r in got} == {hashlib.sha256(x).hexdigest() for x in (b"same", b"")}


def test_gustavson_products():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = (rng.random((rng.integers(0, 7), 6)) < 0.4).astype(int), (rng.random((6, rng.integers(1, 7))) < 0.4).astype(int)
        sparse = lambda m: A.Sparse(np.concatenate([[0], np.cumsum(m.sum(axis=1))]).astype(np.int64), np.nonzero(m)[1], m.shape[1])
        got = sparse(a).times(sparse(b))
        dense = np.zeros((a.shape[0], b.shape[1]), dtype=int)
        dense[got.rows, got.columns] = got.values
        assert (dense == a @ b).all()
        assert (sparse(b).transposed().rows == np.nonzero(b.T)[0]).all() and (sparse(b).transposed().columns == np.nonzero(b.T)[1]).all()


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    to_byte = {c: b for b, c in enumerate(B.byte_letters())}
    a_raw = lambda i: bytes(to_byte[c] for c in lib.id_to_token(i))
    b_raw = lambda i: bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    rows, links = [], []
    for t in texts:
        spelt = (" " + t).encode() if t else b""
        a, b = (lib.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        if b"".join(map(a_raw, a)) != spelt or b"".join(map(b_raw, b)) != spelt:
            a, b = [], []
        ends_a, ends_b = ({e: k for k, e in enumerate(np.cumsum([len(raw(i)) for i in ids]).tolist())} for ids, raw in ((a, a_raw), (b, b_raw)))
        cuts = sorted(ends_a.keys() & ends_b.keys())
        own = [(a[ends_a[c]], b[ends_b[c]]) for c in cuts]
        written, fa, fb = [], 0, 0
        for c in cuts:
            written.append(",".join(map(str, a[fa : ends_a[c] + 1])) + "|" + ",".join(map(str, b[fb : ends_b[c] + 1])))
            fa, fb = ends_a[c] + 1, ends_b[c] + 1
        rows.append((len(a), len(b), len(cuts), ";".join(written)))
        links.append(own)
    counts = Counter(x for own in links for x in own)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(*r, len(own), sum(counts[x] == top[x[1]] for x in own), sum(counts[x] for x in own)) for r, own in zip(rows, links, strict=True)]


def test_alignment_against_a_plain_one(spark, frame, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_CHARS", 3000)
    blocks = durable(A.aligned_blocks(frame, "byte_bpe_50k.json", "piece_bpe_32k.model"))
    got = {r.doc_id: r for r in A.with_link_counts(blocks).collect()}
    want = plain_alignment(some_texts())
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.groups, r.n_links, r.n_best, r.count_sum) == w, ascii(some_texts()[i])
    assert got[some_texts().index("▁x ▁")].n_a == 0  # its pieces spell blanks


def test_overlap_and_group_links():
    a, b, n = np.array([2, 5, 6, 9]), np.array([1, 2, 6, 8, 9]), 9
    over = A.overlap_links(a, b, n)
    starts = lambda e: [0, *e[:-1].tolist()]
    want = {(i, j): min(x, y) - max(p, q) for i, (p, x) in enumerate(zip(starts(a), a.tolist(), strict=True)) for j, (q, y) in enumerate(zip(starts(b), b.tolist(), strict=True)) if min(x, y) > max(p, q)}
    assert dict(zip(zip(over.rows.tolist(), over.columns.tolist(), strict=True), over.values.tolist(), strict=True)) == want
    shared = A.shared_group_links(a, b, np.array([2, 6, 9]))
    assert list(zip(shared.rows.tolist(), shared.columns.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 2), (2, 2), (3, 3), (3, 4)]


def test_alignment_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert A.with_link_counts(durable(A.aligned_blocks(none, "byte_bpe_50k.json", "piece_bpe_32k.model"))).count() == 0
    odd = spark.createDataFrame([("k", "same", 1), ("k", "same", 2), (None, None, 3)], "doc_id string, text string, block int")
    got = A.with_link_counts(durable(A.aligned_blocks(odd, "byte_bpe_50k.json", "piece_bpe_32k.model"))).collect()
    assert sorted((r.doc_id or "", r.n_links, r.n_best, r.groups == "") for r in got) == [("", 0, 0, True), ("k", 1, 1, False), ("k", 1, 1, False)]
    assert {r.count_sum for r in got} == {0, 2}


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_resample(docs, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    buckets = lambda w: [zlib.crc32(x.encode()) % R.BUCKETS for x in w + [a + " " + b for a, b in zip(w, w[1:], strict=False)]]
    s, t = (Counter(x for text in side for x in buckets(words(text))) for side in ([t for _, t in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda x: math.floor(1000 * math.log((t[x] + 1) * (all_s + 10000) / ((s[x] + 1) * (all_t + 10000))))
    rows = []
    for i, text in docs:
        w, f = words(text), buckets(words(text))
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    place = {r[0]: k for k, r in enumerate(able[: 25 * len(able) // 100], 1)}
    return {r[0]: (*r[1:], place.get(r[0])) for r in rows}


def test_resampling_against_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_BYTES", 2000)
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "é", "ÉA", "x1", "日本", "the", "of", "zz" * 40] + [f"w{k}" for k in range(300)]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(1500)]
    docs += [(9000, None), (9001, ""), (9002, "..."), (9003, "lone"), (9004, "ab " * 30_000)]
    target = ["the of alpha beta", "w1 w2 w3 the of", None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = R.resample(frame, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got} == plain_resample(docs, target)


def test_resampling_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([("a b",)], "text string")
    assert R.resample(none, target).count() == 0
    text = "one two three four " * 6
    same = spark.createDataFrame([(5, text, 1)] * 8 + [(None, text, 2)], "doc_id long, text string, score int")
    got = R.resample(same, none.select("text")).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2] and len(got) == 9  # repeated rows are drawn one by one
    assert {r.rank for r in R.resample(same, target).collect() if r.doc_id is None} <= {None, 1, 2}


def test_crc_of_joined_words():
    rng = random.Random(4)
    pairs = [(rng.randbytes(rng.randrange(0, 9)), rng.randbytes(rng.randrange(0, 300))) for _ in range(500)]
    crc = lambda side: np.array([zlib.crc32(p[side]) for p in pairs], dtype=np.uint32)
    assert R.joined_crc(crc(0), crc(1), np.array([len(b) for _, b in pairs])).tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("name", ["op11_byte_bpe", "op12_importance_resampling", "op13_tokenizer_alignment"])
def test_queries_have_a_row_for_each_document(spark, name):
    sf = "/root/testdata/sf0.001"
    assert Q.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
