"""Removal of passages repeated across documents, found by recompression.

Words are level-0 symbols. Each round first names runs of equal symbols, then splits all symbols into left and right
ones by a bit of their name and names every pair (left, right). A name is a 64-bit hash of what it stands for, so all tasks give
equal strings equal names without asking each other. For a window, the symbols at its two ends that could have
been merged with what lies outside are dropped in each round; what is left inside is the same wherever the window stands.
At the highest level with at least ``FEW`` symbols left, the one whose name hashes lowest is the window's anchor, so that
windows side by side mostly share one.

1. Spark groups documents by their anchors: only windows whose anchor occurs in two different documents can repeat.
2. Those windows get a hash of their words. Grouped by (anchor, hash), each learns the smallest document it starts in. A task first
   compares its own: a window that starts in a smaller document of the same task is decided there and goes to no group, so a
   group has at most one document of each block of windows, however common the passage is.
3. Words covered by a window that starts in a smaller document go.
Documents with the same words as a smaller one are decided as a whole before step 1, so big groups of copies stay one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograde.session import discard, durable

WINDOW = 50
FEW = 2  # symbols that the level of an anchor has at least, if any level has
BLOCK = 150_000  # words parsed at once; a longer document is a block of its own
REMEMBERED = 500_000  # word hashes kept by a task
TOGETHER = 200_000  # windows that a task compares before it sends them on

_M1, _M2, _RUN, _EDGE = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_B = 0x5851F42D4C957F2D  # odd base of the word hash of windows
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _named(a: np.ndarray, b: np.ndarray, kind: np.uint64) -> np.ndarray:
    """The name of (a, b), in this order."""
    return _mix(_mix(a + kind) * np.uint64(3) + _mix(b ^ kind))


class _Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_HASHES = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def anchors(sym: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, anchor name, anchor position) of every window of documents laid end to end.

    ``sym``: word hashes of all documents, ``sizes``: their word counts.
    """
    n = len(sym)
    ends = np.cumsum(sizes)
    first = np.zeros(n + 1, dtype=bool)  # a document starts here
    first[0] = first[ends] = True
    many = np.maximum(sizes - window + 1, 0)
    p = np.arange(many.sum()) + np.repeat(ends - sizes - (np.cumsum(many) - many), many)
    name, place = np.zeros(len(p), dtype=np.uint64), np.zeros(len(p), dtype=np.int64)
    if not len(p):
        return p, name, place
    start = np.arange(n + 1)
    live = np.arange(len(p))
    lo, hi = p.copy(), p + window
    # a window of one or two runs has no complete run inside: its anchor is the first run, as far as it lies in the window
    run_at = np.flatnonzero(np.concatenate([[True], (sym[1:] != sym[:-1]) | first[1:n]]))
    until = np.append(run_at, n)[np.searchsorted(run_at, p, "right")]
    name[:] = _named(sym[p], np.minimum(until - p, window).astype(np.uint64), _EDGE)
    place[:] = p
    chosen = np.zeros(len(p), dtype=bool)  # has an anchor of a level with enough symbols
    level = 0
    while len(live):
        level += 1
        n = len(sym)
        # runs
        head = np.ones(n, dtype=bool)
        head[1:] = (sym[1:] != sym[:-1]) | first[1:n]
        at = np.flatnonzero(head)
        run = np.cumsum(head) - 1
        size = np.diff(np.append(at, n))
        sym = sym[at]
        long = size > 1
        sym[long] = _named(sym[long], size[long].astype(np.uint64), _RUN)
        start, first = np.append(start[at], start[n]), np.append(first[at], True)
        left = np.append(run + 1, len(at))  # the first run after the one that an index lies in
        right = np.concatenate([[0], run])  # by the exclusive end: the run that the last symbol lies in
        # pairs
        n = len(sym)
        is_right = (_mix(sym + _mix(np.array([level], dtype=np.uint64))) >> np.uint64(17)) & np.uint64(1) == 1
        second = np.zeros(n + 1, dtype=bool)
        second[1:n] = ~is_right[:-1] & is_right[1:] & ~first[1:n]
        keep = ~second[:n]
        new = np.append(np.cumsum(keep) - 1, keep.sum())
        pl = np.append(np.where(is_right, new[1:], new[:n]), new[n])  # a right one at the left end is dropped
        pr = np.concatenate([[0], np.where(is_right, new[:n] + 1, new[:n])])  # a left one at the right end is dropped
        joined = second[1:] & keep  # heads of pairs
        at = np.flatnonzero(keep)
        both = joined[at]
        pair_of = at[both]
        sym2 = sym[at]
        sym2[both] = _named(sym[pair_of], sym[pair_of + 1], _M2)
        sym, start, first = sym2, np.append(start[at], start[n]), np.append(first[at], True)
        lo, hi = pl[left[lo]], pr[right[hi]]
        inside = lo < hi
        live, lo, hi = live[inside], lo[inside], hi[inside]
        better = (hi - lo >= FEW) | ~chosen[live]
        at = _lowest(_mix(sym ^ _EDGE), lo[better], hi[better])
        who = live[better]
        name[who], place[who] = _mix(sym[at] + np.uint64(level)), start[at]
        chosen[who[(hi - lo)[better] >= FEW]] = True
    return p, name, place


def _lowest(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the smallest rank in each [lo, hi), by tables of minima over powers of two."""
    out = np.zeros(len(lo), dtype=np.int64)
    depth = np.frexp((hi - lo).astype(np.float64))[1] - 1
    best = np.arange(len(rank))
    for d in range(int(depth.max()) + 1 if len(lo) else 0):
        mine = depth == d
        if mine.any():
            a, b = best[lo[mine]], best[hi[mine] - (1 << d)]
            out[mine] = np.where(rank[b] < rank[a], b, a)
        step = 1 << d
        if len(best) > step:
            a, b = best[:-step], best[step:]
            best = np.where(rank[b] < rank[a], b, a)
    return out


def _parse(window: int):
    """(ident, text, raw) -> (ident, raw, n_words, sha, keys, pos, n): anchors of the windows, equal neighbours as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, texts = [], b.column(1)
            at = 0
            size = 0
            for k in range(b.num_rows):
                words = (texts[k].as_py() or "").encode().split()
                held.append((hashlib.sha256(b" ".join(words)).hexdigest(), word_hashes(words)))
                size += len(words)
                if size >= BLOCK or k == b.num_rows - 1:
                    yield block(b.column(0).slice(at, len(held)), b.column(2).slice(at, len(held)), held)
                    held, at, size = [], k + 1, 0

    def block(ident: pa.Array, raw: pa.Array, held: list) -> pa.RecordBatch:
        sizes = np.array([len(h) for _, h in held], dtype=np.int64)
        sym = np.concatenate([h for _, h in held])
        p, name, place = anchors(sym, sizes, window) if len(sym) else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        begin = np.cumsum(sizes) - sizes
        doc = np.searchsorted(begin, p, "right") - 1
        # an empty document begins where the next one does; the last of them is the one with words
        new = np.ones(len(p), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        ends = np.searchsorted(doc[at], np.arange(len(sizes) + 1)).astype(np.int32)
        lists = [name[at].view(np.int64), (p - begin[doc])[at].astype(np.int32), np.diff(np.append(at, len(p))).astype(np.int32)]
        cols = [ident, raw, pa.array(sizes), pa.array([s for s, _ in held], pa.string()), *(pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in lists)]
        return pa.RecordBatch.from_arrays(cols, names=["ident", "raw", "n_words", "sha", "keys", "pos", "n"])

    return run


def _window_rows(window: int):
    """(ident, slot, text, spans) -> (key, win, ident, slot, at, decided): the words' hash of every window of the spans.

    decided: a window with these words starts in a smaller ident of the same block; such rows have a key and hash of no meaning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size, rows = [], 0, b.num_rows
            order = pc.rank(b.column(0), tiebreaker="dense").to_numpy()
            for k in range(rows):
                words = b.column(2)[k].as_py().encode().split()
                spans = b.column(3)[k].values
                key, pos, n = (spans.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                n = n.astype(np.int64)
                at = np.repeat(pos - (np.cumsum(n) - n), n) + np.arange(n.sum())
                here = at + window <= len(words)  # spans of all texts of an ident come together
                at, key = at[here], np.repeat(key, n)[here]
                power = np.full(len(words), _B, dtype=np.uint64)
                power[0] = 1
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hashes(words) * np.multiply.accumulate(power))])
                win = _mix((total[at + window] - total[at]) * _inverse(at))
                out.append(((key >> 32).astype(np.int32), win, np.repeat(k, len(at)), at.astype(np.int32)))
                size += len(at)
                if size > TOGETHER or k == rows - 1:
                    key, win, row, at = (np.concatenate([o[i] for o in out]) for i in range(4))
                    decided = _not_least(key, win, order[row])
                    spread = _mix(np.arange(len(win), dtype=np.uint64) ^ win)
                    key, win = np.where(decided, at, key), np.where(decided, spread, win)
                    take = pa.array(row)
                    cols = [pa.array(key), pa.array(win.view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array(at), pa.array(decided)]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "win", "ident", "slot", "at", "decided"])
                    out, size = [], 0

    return run


def _not_least(key: np.ndarray, win: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which rows have a row of equal key and win but smaller order beside them."""
    by = np.lexsort((order, key, win))
    key, win, order = key[by], win[by], order[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (win[1:] != win[:-1]) | (key[1:] != key[:-1])
    out = np.zeros(len(by), dtype=bool)
    if len(by):
        out[by] = order > order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


_INVERSES = np.ones(1, dtype=np.uint64)


def _inverse(at: np.ndarray) -> np.ndarray:
    """B^-i modulo 2^64 for each i."""
    global _INVERSES
    most = int(at.max(initial=0))
    if most >= len(_INVERSES):
        x = np.full(2 * (most + 1), pow(_B, -1, 1 << 64), dtype=np.uint64)
        x[0] = 1
        _INVERSES = np.multiply.accumulate(x)
    return _INVERSES[at]


def _cut(window: int):
    """(ident, slot, text, starts) -> (ident, slot, n_removed, kept): the words that no removed window covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, size, counts, kept, rows = 0, 0, [], [], b.num_rows
            for k in range(rows):
                words = b.column(2)[k].as_py().encode().split()
                starts = b.column(3)[k].values.to_numpy(zero_copy_only=False)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                counts.append(int(gone.sum()))
                kept.append(b" ".join(words[i] for i in np.flatnonzero(~gone)).decode())
                size += len(kept[-1])
                if size > 8_000_000 or k == rows - 1:
                    n = len(counts)
                    cols = [b.column(0).slice(done, n), b.column(1).slice(done, n), pa.array(counts, pa.int64()), pa.array(kept, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=["ident", "slot", "n_removed", "kept"])
                    done, size, counts, kept = k + 1, 0, [], []

    return run


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(ident, n_words, n_removed, kept, kept_sha256, words_sha256) for every row; kept is null where nothing was removed.

    A word goes if a window of ``window`` words that covers it also starts in a row of smaller ident, judged on the input.
    kept has the other words joined by one blank, kept_sha256 the digest of all that stay, words_sha256 that of all words before. Null and empty texts have no words. A
    row of null ident neither loses words nor makes others lose them. Rows of equal ident never take words from each
    other. Repeated rows all come back; an empty table gives an empty result.
    """
    kind = docs.schema[ident].dataType.simpleString()
    base = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text"), F.xxhash64(text).alias("raw"))  # raw tells texts of one ident apart
    parsed = durable(base.mapInArrow(_parse(window), f"ident {kind}, raw bigint, n_words bigint, sha string, keys array<bigint>, pos array<int>, n array<int>"))
    heads = durable(parsed.select("ident", "raw", "sha", "n_words"))
    long = heads.filter(F.col("ident").isNotNull() & (F.col("n_words") >= window))
    least = durable(long.groupBy("sha").agg(F.min(F.struct("ident", "raw")).alias("first")).select("sha", F.col("first.ident").alias("least"), "first.raw"))
    # the smallest document of each different text; slot numbers the texts of one ident
    slot = F.row_number().over(W.partitionBy("ident").orderBy("sha")).alias("slot")
    texts = durable(least.withColumnRenamed("least", "ident").select("ident", "sha", "raw", slot))
    least = least.drop("raw")
    mark = F.xxhash64("sha").alias("mark")
    rows = parsed.filter(F.col("ident").isNotNull()).select("ident", mark, F.explode(F.arrays_zip("keys", "pos", "n")).alias("s")).select("ident", "mark", "s.*")
    shared = rows.groupBy("keys").agg(F.min("mark").alias("a"), F.max("mark").alias("z")).filter("a < z").select("keys")  # in different texts
    spans = rows.drop("mark").join(durable(shared), "keys").groupBy("ident").agg(F.collect_set(F.struct("keys", "pos", "n")).alias("spans"))
    spans = durable(spans.join(texts.drop("sha"), "ident"))
    discard(parsed)  # large tables go as soon as the next one is written
    found = durable(base.join(spans, ["ident", "raw"]).drop("raw"))
    discard(spans)
    windows = found.select("ident", "slot", "text", "spans").mapInArrow(_window_rows(window), f"key int, win bigint, ident {kind}, slot int, at int, decided boolean")
    least_here = F.min(F.when(~F.col("decided"), F.col("ident"))).over(W.partitionBy("key", "win"))
    later = windows.withColumn("a", least_here).filter("decided OR ident > a")
    gone = durable(later.groupBy("ident", "slot").agg(F.collect_set("at").alias("starts")))
    cut = found.drop("spans").join(gone, ["ident", "slot"]).select("ident", "slot", "text", "starts").mapInArrow(_cut(window), f"ident {kind}, slot int, n_removed bigint, kept string")
    cut = durable(cut.join(texts.drop("raw"), ["ident", "slot"]).drop("slot").dropDuplicates(["ident", "sha"]))
    discard(found)
    out = heads.drop("raw").join(least, "sha", "left").join(cut, ["ident", "sha"], "left")
    copy = F.coalesce((F.col("ident") > F.col("least")) & (F.col("n_words") >= window), F.lit(False))
    kept = F.when(copy, "").otherwise(F.col("kept"))
    sha = F.when(copy, _EMPTY_SHA).when(F.col("kept").isNotNull(), F.sha2(F.col("kept"), 256)).otherwise(F.col("sha"))
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint")))
    return out.select(F.col("ident").alias(ident), "n_words", removed.alias("n_removed"), kept.alias("kept"), sha.alias("kept_sha256"), F.col("sha").alias("words_sha256"))
