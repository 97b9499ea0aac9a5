"""Importance resampling towards a target: documents are drawn by how much likelier their word runs are in a target corpus than in their own.

Arrow kernels do the text work. ``ascii_lower`` and ``split_pattern_regex`` give words, ``list_flatten`` and ``dictionary_encode`` turn them
into indices; indices shifted by one place form pairs, and each distinct pair of a block is hashed once. The CRC of a pair is put together
from the CRCs of its words, so no text is joined. ``take`` brings gains back to the words of the block, and segments of them are summed
per document. Feature counts are sums over all rows; gains are one number for each of ``BUCKETS`` buckets, whatever the size of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 10_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, after lower-casing
LEAST_WORDS = 20  # of a document that may be drawn
PERCENT = 25  # of those documents
SEED = 7
BLOCK_BYTES = 8 << 20  # text that is encoded together


@lru_cache(maxsize=4096)
def _shift(n: int) -> np.ndarray:
    """4 x 256 table that carries a CRC over ``n`` further bytes: crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""
    zeros = bytes(n)
    base = zlib.crc32(zeros)
    bits = [zlib.crc32(zeros, 1 << k) ^ base for k in range(32)]
    table = np.zeros((4, 256), dtype=np.uint32)
    for part in range(4):
        for k in range(8):
            table[part, 1 << k : 2 << k] = table[part, : 1 << k] ^ np.uint32(bits[8 * part + k])
    return table


def joined_crc(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRCs of a + b from those of a and of b and the sizes of b."""
    out = second.copy()
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        t, c = _shift(int(sizes[part[0]])), first[part]
        out[part] ^= t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return out


class Block:
    """Features of some texts: ``bucket`` of each distinct feature, and for each text which features it holds.

    ``word``, ``pair``: feature number of each word, and of each word with the one after it (-1 at the end of a text).
    ``words``: number of words of each text.
    """

    def __init__(self, texts: pa.Array):
        whole = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))  # ascii_lower misreads a slice: copy it
        lists = pc.split_pattern_regex(pc.ascii_lower(whole), SEPARATORS)
        flat = pc.list_flatten(lists)
        real = pc.not_equal(flat, "")
        owner = pc.list_parent_indices(lists).filter(real).to_numpy()
        encoded = flat.filter(real).dictionary_encode()
        index, names = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.cast(pa.large_binary())
        self.words = np.bincount(owner, minlength=len(texts))
        crc = np.fromiter((zlib.crc32(w.as_buffer()) for w in names), dtype=np.uint32, count=len(names))
        sizes = pc.binary_length(names).to_numpy().astype(np.int64)
        spaced = joined_crc(crc, np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), np.ones(len(crc), dtype=np.int64))
        inner = owner[1:] == owner[:-1]
        couples = pa.array(index[:-1][inner] * max(len(names), 1) + index[1:][inner]).dictionary_encode()
        left, right = np.divmod(couples.dictionary.to_numpy(), max(len(names), 1))
        self.bucket = np.concatenate([crc, joined_crc(spaced[left], crc[right], sizes[right])]).astype(np.int64) % BUCKETS
        self.word = index
        self.pair = np.full(len(index), -1, dtype=np.int64)
        if len(index):
            self.pair[:-1][inner] = couples.indices.to_numpy().astype(np.int64) + len(names)

    def counts(self) -> np.ndarray:
        """Features in each bucket."""
        number = np.concatenate([self.word, self.pair[self.pair >= 0]])
        return np.bincount(self.bucket.take(number), minlength=BUCKETS)

    def features(self) -> np.ndarray:
        """Number of features of each text."""
        return np.where(self.words > 0, 2 * self.words - 1, 0)

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """Floored mean of the gains of each text's features; 0 where it has none."""
        gain = np.append(gains.take(self.bucket), 0)  # the last one is for -1
        per_word = gain.take(self.word) + gain.take(self.pair)
        filled = np.flatnonzero(self.words)
        out = np.zeros(len(self.words), dtype=np.int64)
        if len(filled):
            starts = np.concatenate([[0], np.cumsum(self.words[filled])[:-1]])
            out[filled] = np.add.reduceat(per_word, starts) // (2 * self.words[filled] - 1)
        return out


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``BLOCK_BYTES`` of text, one row at least."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
            yield b.slice(at, end - at)
            at = end


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n) of all features of the column ``text``; buckets without features are left out. A task sends one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for part in _slices(batches, 0):
            total += Block(part.column(0)).counts()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text") -> np.ndarray:
    """Gain of each bucket: floor(1000 ln((t+1)(S+BUCKETS) / ((s+1)(T+BUCKETS)))). ``BUCKETS`` rows at most come to the driver, whatever the tables hold."""
    table = np.zeros((2, BUCKETS))
    both = bucket_counts(docs, text).withColumn("side", F.lit(0)).unionByName(bucket_counts(target, text).withColumn("side", F.lit(1)))
    for row in both.collect():
        table[row.side, row.bucket] = row.n
    (s, t), (all_s, all_t) = table, table.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_words, n_features, weight) of every row."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 1):
            block = Block(part.column(1))
            numbers = [pa.array(x.astype(np.int64)) for x in (block.words, block.features(), block.weights(gains))]
            yield pa.RecordBatch.from_arrays([part.column(0), *numbers], names=["ident", "n_words", "n_features", "weight"])

    out = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text")).mapInArrow(run, f"ident {kind}, n_words long, n_features long, weight long")
    return out.withColumnRenamed("ident", ident)


def with_scores(rows: DataFrame, ident: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Adds ``score``: the weight plus a Gumbel draw in thousandths, from a hash of the seed and the id (null: the empty text)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def drawn(scored: DataFrame, ident: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank``: 1, 2, 3... by score from the highest, ties to the smaller id, for the drawn percentage of rows with enough words; null for others.

    ``scored`` is read three times, so hand in a stored table. A score is a whole number of thousandths whose draw alone spreads over 26,000
    values, so counts per score are a table of bounded size and no score holds more than 0.04 % of the ids: a score is ordered on its own.
    """
    able = F.col("n_words") >= least_words
    counts = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("__n"))
    falling = Window.orderBy(F.desc("score"))
    bars = counts.select("score", (F.sum("__n").over(falling) - F.col("__n")).alias("__above"), F.floor(F.sum("__n").over(Window.partitionBy()) * percent / 100).alias("__draw"))
    bars = bars.filter("__above < __draw")  # one row for each score that has drawn rows
    rows = scored.withColumn("__able", able).join(bars, "score", "left")
    near = F.col("__able") & F.col("__above").isNotNull()
    ties = [F.col(ident).asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    place = F.col("__above") + F.row_number().over(Window.partitionBy("score").orderBy(*ties))
    ranked = rows.filter(near).withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= F.col("__draw"), F.col("rank")))
    rest = rows.filter(F.coalesce(~near, F.lit(True))).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).drop("__able", "__above", "__draw")


def resample(docs: DataFrame, target: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(ident, n_words, n_features, weight, score, rank) of every row of ``docs``, drawn towards the texts of ``target``.

    Null and empty texts have no features and weight 0. Repeated rows are counted and drawn one by one; rows of one id and score follow
    by weight, then by number of features. An empty table gives an empty result, an empty target the same gains from no
    counts. Other columns are not read.
    """
    from heliograde.session import durable

    gains = bucket_gains(docs, target, text)
    return drawn(durable(with_scores(weighted(docs, gains, ident, text), ident, seed)), ident, percent)
