"""Aligning two tokenizers over one text: which tokens overlap, end together, and fall into one group.

Tokens of a block of texts are the rows of an incidence matrix over the bytes of the block, in compressed sparse rows made by hand. The product
A B^T, row by row after Gustavson, links the tokens of A to those of B that share bytes. Linked tokens that end together cut both sequences into
groups; the product of the token-group incidences links every token of A to all tokens of B in its group. Texts stand behind one
another, so no product reaches across two of them.

How often two ids are linked is counted over the whole corpus. A block sends each of its id pairs once, with a number, so an id pair that
stands in every text is one row for each block; counts come back to the block and its links read them off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograde.llm import bytepairs, pieces
from heliograde.session import durable

BLOCK_CHARS = 1_000_000  # characters of the texts that are aligned together
REMEMBERED = 400_000  # words of A that a task keeps


@dataclass
class Sparse:
    """Compressed sparse rows: row r holds ``columns[starts[r] : starts[r + 1]]``, all entries 1 or ``values``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int
    values: np.ndarray | None = None

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> Sparse:
        """Columns as rows, by counting; entries of a row stay in order."""
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Sparse(starts, self.rows[order], len(self.starts) - 1)

    def times(self, other: Sparse) -> Sparse:
        """Gustavson's product of 0-1 matrices: row r is the sum of the rows of ``other`` that row r names. Entries of a row are in column order."""
        sizes = np.diff(other.starts)[self.columns]
        shift = np.cumsum(sizes) - sizes - other.starts[self.columns]
        take = np.arange(int(sizes.sum()))
        take -= np.repeat(shift, sizes)
        key = np.repeat(self.rows, sizes)
        key *= max(other.width, 1)
        key += other.columns[take]
        del take, shift, sizes
        if len(key) > 1 and not (key[1:] >= key[:-1]).all():
            key = np.sort(key)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        rows, columns = np.divmod(key[first], max(other.width, 1))
        values = np.diff(np.append(first, len(key)))
        starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(self.starts) - 1))])
        return Sparse(starts, columns, other.width, values)


def token_bytes(ends: np.ndarray, n: int) -> Sparse:
    """Tokens that cover ``n`` bytes without gaps, given by where they end: the bytes of each."""
    return Sparse(np.concatenate([[0], ends]), np.arange(n), n)


def overlap_links(a_ends: np.ndarray, b_ends: np.ndarray, n: int) -> Sparse:
    """A B^T: for each token of A the tokens of B that share bytes with it; values are the numbers of bytes."""
    return token_bytes(a_ends, n).times(token_bytes(b_ends, n).transposed())


def token_groups(ends: np.ndarray, cuts: np.ndarray) -> Sparse:
    """The group of each token; groups end at ``cuts``."""
    return Sparse(np.arange(len(ends) + 1), np.searchsorted(cuts, ends), len(cuts))


def shared_group_links(a_ends: np.ndarray, b_ends: np.ndarray, cuts: np.ndarray) -> Sparse:
    """For each token of A all tokens of B in its group: as many links as the sizes of the groups multiply to."""
    return token_groups(a_ends, cuts).times(token_groups(b_ends, cuts).transposed())


@lru_cache(maxsize=4)
def _pieces(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


class Aligner:
    """The two vocabularies, with the bytes of every token."""

    def __init__(self, byte_model: str, piece_model: str):
        self.a = bytepairs.load(pieces.model_path(byte_model))
        self.b = _pieces(pieces.model_path(piece_model))
        self.a.remembered = REMEMBERED
        self.a_raw = self.a.raw
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_raw = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(pieces.BLANK, " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array(list(map(len, raw)), dtype=np.int64) for raw in (self.a_raw, self.b_raw))
        # how a group is written: ids of A with commas, a bar, ids of B with commas, a semicolon
        self.names = pa.array([f"{i}{end}" for n, ends in ((len(self.a_raw), ",|"), (len(self.b_raw), ",;")) for end in ends for i in range(n)], pa.string())

    def block(self, texts: list[str]) -> _Block:
        """All texts aligned as one sequence of bytes. A text whose tokens do not spell it has none."""
        a = [np.frombuffer(x, dtype="<u4").astype(np.int64) for x in self.a.encode_block([" " + t if t else "" for t in texts])]
        b = [np.array(x, dtype=np.int64) for x in self.b.encode(texts, num_threads=1)]
        for k, t in enumerate(texts):
            # bytes of A spell every text; pieces of B spell blanks where the text has the letter that stands for them
            if pieces.BLANK in t or self.b_size[b[k]].sum() != self.a_size[a[k]].sum():
                a[k], b[k] = a[k][:0], b[k][:0]
        none = np.zeros(0, dtype=np.int64)
        return _Block(self, np.concatenate([none, *a]), np.concatenate([none, *b]), np.array(list(map(len, a)), dtype=np.int64), np.array(list(map(len, b)), dtype=np.int64))


class _Block:
    def __init__(self, by: Aligner, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.by, self.a, self.b, self.n_a, self.n_b = by, a, b, n_a, n_b
        self.a_ends, self.b_ends = np.cumsum(by.a_size[a]), np.cumsum(by.b_size[b])
        self.n = int(self.a_ends[-1]) if len(a) else 0
        over = overlap_links(self.a_ends, self.b_ends, self.n)
        rows = over.rows
        both = self.a_ends[rows] == self.b_ends[over.columns]
        self.link_a, self.link_b = rows[both], over.columns[both]  # positions in the block of tokens that end together
        self.n_overlaps = np.bincount(np.searchsorted(np.cumsum(n_a), rows, side="right"), minlength=len(n_a))
        self.cuts = self.a_ends[self.link_a]
        self.text_of_link = np.searchsorted(np.cumsum(n_a), self.link_a, side="right")
        self.n_links = np.bincount(self.text_of_link, minlength=len(n_a))
        self.n_groups = np.bincount(np.searchsorted(self._text_ends(), self.cuts), minlength=len(n_a))

    def _text_ends(self) -> np.ndarray:
        """The byte at which each text ends."""
        ends = np.cumsum(self.n_a)
        return np.where(ends > 0, self.a_ends[np.maximum(ends, 1) - 1] if self.n else 0, 0)

    def written(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each text: the ids of every group in order."""
        n_a, n_b = len(self.by.a_raw), len(self.by.b_raw)
        ga, gb = token_groups(self.a_ends, self.cuts).columns, token_groups(self.b_ends, self.cuts).columns
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, dtype=bool)
        name = np.concatenate([self.a + n_a * last(ga), 2 * n_a + self.b + n_b * last(gb)])
        order = np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")
        text = self.by.names.take(pa.array(name[order]))
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int32, count=len(text) + 1) if len(text) else np.zeros(1, dtype=np.int32)
        data = text.buffers()[2]
        ends = offsets[np.cumsum(self.n_a + self.n_b)].tolist()
        return [data.slice(x, y - x - 1).to_pybytes() if y > x else b"" for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    def shared(self) -> np.ndarray:
        """Number of shared-group links of each text, from the column sums of both incidences; none of them is made."""
        size = lambda ends: np.bincount(token_groups(ends, self.cuts).columns, minlength=len(self.cuts))
        of = np.searchsorted(self._text_ends(), self.cuts)
        out = np.zeros(len(self.n_a), dtype=np.int64)
        np.add.at(out, of, size(self.a_ends) * size(self.b_ends))
        return out


TEXT = "n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_shared long, groups string"


def aligned_blocks(docs: DataFrame, byte_model: str, piece_model: str, ident: str = "doc_id", text: str = "text", write: Callable[[bytes], str] = bytes.decode) -> DataFrame:
    """One row for each block of texts: (block, pairs, times, links, texts).

    ``pairs`` are the distinct id pairs (A id << 32 | B id) whose tokens end together in the block, ``times`` how often; ``links`` has for every link,
    text after text, the place of its pair in ``pairs`` (packed 32-bit integers). ``texts`` is an array of (ident, n_a, n_b, n_groups, n_links,
    n_overlaps, n_shared, groups): numbers of tokens, groups, links that end together, links that share bytes, links that share a
    group, and the groups as ``a1,a2|b1;a3|b2,b3`` (ids in order).

    ``write`` turns the groups as written into what is returned, a digest for instance, inside the task.
    A reads a space and the text, B the text. Null and empty texts, and those that the bytes of the tokens of A or B do not spell, have zeros and
    an empty string. Repeated rows are aligned one by one; an empty table gives an empty result. Other columns are not
    read. The numbers of blocks hold for one run, so store the result before using it twice.
    """
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        by = Aligner(byte_model, piece_model)
        number = TaskContext.get().partitionId() << 32
        for part, texts in bytepairs.blocks(batches, 1, BLOCK_CHARS):
            b = by.block(texts)
            pairs, links, times = np.unique(b.a[b.link_a] << 32 | b.b[b.link_b], return_inverse=True, return_counts=True)
            columns = [part.column(0), *map(pa.array, (b.n_a, b.n_b, b.n_groups, b.n_links, b.n_overlaps, b.shared(), list(map(write, b.written()))))]
            rows = pa.StructArray.from_arrays(columns, names=["ident", *(x.split()[0] for x in TEXT.split(", "))])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x) if isinstance(x, np.ndarray) else x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), one(pairs), one(times), pa.array([links.astype("<i4").tobytes()], pa.binary()), one(rows)], names=["block", "pairs", "times", "links", "texts"]
            )
            number += 1

    schema = f"block long, pairs array<long>, times array<long>, links binary, texts array<struct<ident: {kind}, {TEXT.replace(' ', ': ').replace(',:', ',')}>>"
    return docs.select(F.col(ident).alias("ident"), F.col(text).alias("text")).mapInArrow(run, schema)


def alignments(blocks: DataFrame, ident: str = "doc_id") -> DataFrame:
    """One row for each text of ``aligned_blocks``."""
    return blocks.select(F.inline("texts")).withColumnRenamed("ident", ident)


def link_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of the corpus hold the id pair, and whether that is the most of all pairs of its B id."""
    counts = durable(blocks.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy("pairs").agg(F.sum("times").alias("count")).withColumnRenamed("pairs", "pair"))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    top = counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("top"))
    return counts.withColumn("b_id", b_id).join(top, "b_id").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def with_link_counts(blocks: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(ident, n_best, count_sum, and what ``texts`` holds): links that are the most frequent of their B id, and the sum of the counts of all links.

    ``blocks`` is a stored table of ``aligned_blocks``; ``groups`` may be left out of its texts.
    """
    pairs = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    back = pairs.join(link_counts(blocks), "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("f"))
    joined = blocks.select("block", "links", "texts").join(back, "block", "left")
    joined = joined.select("links", F.col("texts.n_links").alias("sizes"), F.col("f.count").alias("count"), F.col("f.best").alias("best"), "texts")
    texts = blocks.schema["texts"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                links = np.frombuffer(b.column(0)[k].as_py(), dtype="<i4")
                sizes = b.column(1)[k].values.to_numpy()
                sums = np.zeros((2, len(sizes)), dtype=np.int64)
                if len(links):
                    filled = np.flatnonzero(sizes)
                    starts = np.cumsum(sizes[filled]) - sizes[filled]
                    for row, column in ((0, 3), (1, 2)):
                        value = b.column(column)[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
                        sums[row, filled] = np.add.reduceat(value.take(links), starts)
                found = b.column(4)[k].values
                yield pa.RecordBatch.from_arrays([*found.flatten(), *map(pa.array, sums)], names=[*(f.name for f in found.type), "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.elementType.fields)
    return joined.mapInArrow(run, f"{schema}, n_best long, count_sum long").withColumnRenamed("ident", ident)
