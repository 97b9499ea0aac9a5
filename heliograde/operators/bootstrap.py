"""Bootstrap intervals whose draws are integer hashes, so that every run repeats.

``replicate_auc`` gives every row an independent Poisson(1) multiplicity in each replicate, a hash of (row key, replicate), which is what
drawing n of n with replacement tends to as n grows; replicates are arrays of sums, so no row is repeated for them.
``draw_multiplicities`` draws exactly n of n, for groups so small that the difference shows: draw j of replicate b lands
on row hash(b, j) mod n. ``exact_auc`` gives the ROC areas of those draws, which are made where they are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograde.functions.hashing import draw, draw_batches, hash_array, mixed, poisson_limits
from heliograde.operators import ranking as R
from heliograde.session import durable

REPS = 2000


def _group_sizes(df: DataFrame, group: list[str], label: str) -> DataFrame:
    return df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("__size"))


def draw_multiplicities(rows: DataFrame, group: list[str], label: str, index: str, reps: int = REPS, seed: int = 0) -> DataFrame:
    """(group, label, rep, index) -> times drawn. ``index`` numbers the rows of a class from 0."""
    sized = rows.select(*group, label, index).join(_group_sizes(rows, group, label), [*group, label])
    draws = sized.select(*group, label, "__size", index, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    pick = F.pmod(draw_batches(F.col(index) * 2 + F.col(label), F.col("rep"), seed), F.col("__size"))
    return draws.select(*group, label, "rep", pick.alias(index)).groupBy(*group, label, "rep", index).agg(F.count(F.lit(1)).alias("times"))


def poisson_times(key: Column | str, rep: Column | str, seed: int = 0) -> Column:
    """Poisson(1) multiplicity of a row in a replicate."""
    reached = lambda h: sum(((h >= x).cast("int") for x in poisson_limits()[1:]), (h >= poisson_limits()[0]).cast("int"))
    return F.transform(F.array(draw(key, rep, seed)), reached)[0]  # the draw is computed once


def resampled(rows: DataFrame, key: Column | str, reps: int = REPS, seed: int = 0) -> DataFrame:
    """Rows once for each replicate that takes them, with ``rep`` and ``times``: for statistics that ``replicate_auc`` does not give."""
    every = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return every.withColumn("times", poisson_times(key, "rep", seed)).filter("times > 0")


CELLS = 64  # value-ordered parts of a group and score
ROWS = 256  # rows whose draws are made at once
TILE = 16  # rows whose draws are mixed at once, while they are in the cache


def _draws(keys: np.ndarray, marks: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) multiplicity of every row (by key) in every replicate (by the hash of its number): what ``poisson_times`` gives."""
    limits = np.array(poisson_limits(), dtype=np.uint32)
    own = hash_array(keys, seed + 1)
    times = np.empty((len(own), len(marks)), dtype=np.uint8)  # there are far fewer limits
    for at in range(0, len(own), TILE):
        h = mixed(own[at : at + TILE, None] ^ marks[None, :], seed)
        part = times[at : at + TILE]
        np.greater_equal(h, limits[0], out=part.view(bool))
        for x in limits[1:]:
            part += (h >= x).view(np.uint8)
    return times


def _hashed(reps: int, seed: int):
    """Column of row keys -> multiplicities of its rows from one place to another."""
    marks = hash_array(np.arange(reps), seed + 2)

    def column(keys: pa.Array):
        keys = keys.to_numpy(zero_copy_only=False)
        return lambda at, end: _draws(keys[at:end], marks, seed)

    return column


def _accumulate(n_keys: int, reps: int, drawn):
    """Rows sorted by (keys..., score) -> for each keys (keys..., pos, neg, won): per replicate the drawn positives and negatives, and twice the
    pairs that positives win inside. The state is a few arrays of one number a replicate, however many rows a cell has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, names, sums = None, None, None

        def close(value_pos, value_neg):  # one value is complete
            pos, neg, won = sums
            won += value_pos * (2 * neg + value_neg)
            pos += value_pos
            neg += value_neg

        def out():
            close(*open_)
            cols = [pa.array([v], t) for v, t in zip(cell, names, strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array([0, reps], pa.int32()), pa.array(x)) for x in sums]
            return pa.RecordBatch.from_arrays([*cols, *lists], names=[*(f"k{i}" for i in range(n_keys)), "pos", "neg", "won"])

        open_, last = None, None
        for b in batches:
            names = [b.column(i).type for i in range(n_keys)]
            keys = list(zip(*(b.column(i).to_pylist() for i in range(n_keys)), strict=True))
            score, label = (b.column(n_keys + i).to_numpy(zero_copy_only=False) for i in range(2))
            take = drawn(b.column(n_keys + 2))
            new_cell = np.array([True, *(x != y for x, y in zip(keys[1:], keys, strict=False))])[: b.num_rows]
            runs = np.flatnonzero(new_cell | np.append(True, score[1:] != score[:-1])[: b.num_rows])
            at = 0
            while at < b.num_rows:
                end = min(b.num_rows, at + ROWS)
                times = take(at, end)
                starts = np.unique(np.append(at, runs[(runs > at) & (runs < end)]))
                pos = np.add.reduceat(times * (label[at:end] == 1)[:, None], starts - at, axis=0, dtype=np.int64)
                neg = np.add.reduceat(times * (label[at:end] == 0)[:, None], starts - at, axis=0, dtype=np.int64)
                for i, s in enumerate(starts.tolist()):
                    if keys[s] != cell:
                        if cell is not None:
                            yield out()
                        cell, sums = keys[s], tuple(np.zeros(reps, dtype=np.int64) for _ in range(3))
                        open_, last = (pos[i], neg[i]), score[s]
                    elif score[s] == last:
                        open_ = (open_[0] + pos[i], open_[1] + neg[i])
                    else:
                        close(*open_)
                        open_, last = (pos[i], neg[i]), score[s]
                at = end
        if cell is not None:
            yield out()

    return run


def replicate_auc(
    rows: DataFrame, group: list[str], scores: list[str], key: str, label: str = "label", reps: int = REPS, seed: int = 0, domain=(0.0, 1.0), cells: int = CELLS
) -> DataFrame:
    """(group..., which, rep, auc): ROC area of every Poisson replicate for each score column; the same draws serve all scores.

    ``key`` is an integer that tells rows apart. Nothing is repeated per replicate: rows go by (group, score column, cell of the score range),
    sorted by score, past accumulators of one number for each replicate, and the cells of a group are put together from their
    sums. A cell is read as a stream, so neither a hot group nor a pile of equal scores is held in memory.
    """
    stacked = rows.select(
        *group, F.inline(F.array(*[F.struct(F.lit(s).alias("which"), F.col(s).cast("double").alias("score")) for s in scores])), F.col(label).cast("int").alias("label"), F.col(key).cast("bigint").alias("key")
    )
    return _areas(stacked, [*group, "which"], "key", _hashed(reps, seed), reps, domain, cells)


def _areas(stacked: DataFrame, by: list[str], key: str, drawn, reps: int, domain, cells: int) -> DataFrame:
    """(by..., rep, auc) of rows (by..., score, label, key), where ``drawn`` makes multiplicities of the column ``key``."""
    lo, hi = domain
    slot = F.floor((F.col("score") - F.lit(float(lo))) / F.lit(float(hi - lo)) * F.lit(cells))
    celled = R.clean_scores(stacked, "score").withColumn("cell", F.greatest(F.least(slot, F.lit(cells - 1)), F.lit(0)).cast("int"))
    keys = [*by, "cell"]
    laid = celled.select(*keys, "score", "label", key).repartition(*keys).sortWithinPartitions(*keys, "score")
    kinds = dict(laid.dtypes)
    schema = ", ".join(f"k{i} {kinds[k]}" for i, k in enumerate(keys)) + ", pos array<long>, neg array<long>, won array<long>"
    sums = laid.mapInArrow(_accumulate(len(keys), reps, drawn), schema).toDF(*keys, "pos", "neg", "won")

    def join_cells(table: pa.Table) -> pa.Table:
        """The cells of one group, ``cells`` of them at most, in order of their scores."""
        table = table.sort_by("cell")
        pos, neg, won = (np.array(table[c].combine_chunks().values.to_numpy()).reshape(table.num_rows, reps) for c in ("pos", "neg", "won"))
        below = np.cumsum(neg, axis=0) - neg
        both = pos.sum(axis=0) * neg.sum(axis=0, dtype=np.float64)
        area = np.divide((won + 2 * pos * below).sum(axis=0), 2 * both, out=np.full(reps, np.nan), where=both > 0)
        cols = [pa.array([table[c][0].as_py()] * reps, table[c].type) for c in by]
        return pa.table([*cols, pa.array(np.arange(reps, dtype=np.int32)), pa.array(area, from_pandas=True)], names=[*by, "rep", "auc"])

    return sums.groupBy(*by).applyInArrow(join_cells, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", rep int, auc double")


BLOCK, TURN = 1 << 16, 100  # draws of a class that are made at once, while they are in the cache, and replicates of a task
HELD = 1 << 15  # rows of a class in one packed row
PARTS = 200  # tasks that make draws: the size of their input says nothing about the work


def _landed(codes: np.ndarray, own: np.ndarray, mark: np.uint32, n_codes: int, seed: int, block: int) -> np.ndarray:
    """How many draws of a replicate land on each code; ``own`` holds the hashes of the draws' numbers."""
    counts = np.zeros(n_codes, dtype=np.int64)
    size, step = np.uint32(len(codes)), max(block, n_codes)  # a count costs as much as there are codes
    for at in range(0, len(codes), step):
        drawn = np.empty(min(step, len(codes) - at), dtype=codes.dtype)
        for i in range(0, len(drawn), block):
            part = drawn[i : i + block]
            h = mixed(own[at + i : at + i + len(part)] ^ mark, seed)
            h -= h // size * size  # quicker than the remainder
            codes.take(h, out=part, mode="clip")
        counts += np.bincount(drawn, minlength=n_codes)
    return counts


def exact_auc(
    rows: DataFrame, group: list[str], score: str, label: str = "label", index: str = "idx", reps: int = REPS, seed: int = 0, domain=(0.0, 1.0),
    block: int = BLOCK, held: int = HELD,
) -> DataFrame:
    """(group..., rep, auc) over the draws of ``draw_multiplicities``: n of n from every class.

    Where a draw lands depends on its number and the size of the class alone, so no draw leaves the task that makes it. Scores become their
    ranks among those of the group, packed as a few bytes each in the order of ``index``, and go once to each task, which makes ``TURN``
    replicates of a group. A task holds 10 to 16 bytes for each row of its group, besides a few numbers for each different score.
    """
    by = [*group, "label"]
    pts = durable(rows.select(*group, F.col(label).cast("int").alias("label"), F.col(index).cast("bigint").alias("idx"), F.col(score).cast("double").alias("score")))
    values = R.clean_scores(pts, "score").select(*group, "score").distinct().withColumn("one", F.lit(1))
    ranks = durable(R.running_sums(values, group, "score", ["one"], domain).select(*group, "score", (F.col("below_one") + 1).alias("code")))
    coded = pts.join(ranks, [*group, "score"], "left").select(
        *by, F.floor(F.col("idx") / F.lit(held)).cast("bigint").alias("held"), (F.col("idx") % F.lit(held)).cast("int").alias("place"), F.coalesce("code", F.lit(0)).cast("bigint").alias("code")
    )
    kinds = dict(coded.dtypes)
    named = lambda names: ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def pack(points: pa.Table) -> pa.Table:
        codes = np.zeros(points.num_rows, dtype=np.int64)
        codes[points["place"].to_numpy()] = points["code"].to_numpy()
        wide = np.min_scalar_type(codes.max()).itemsize
        cols = [points[c].slice(0, 1) for c in (*by, "held")]
        return pa.table([*cols, pa.array([wide], pa.int32()), pa.array([codes.astype(f"<u{wide}").tobytes()], pa.binary())], names=[*by, "held", "wide", "codes"])

    def areas(packed: pa.Table) -> pa.Table:
        packed = packed.sort_by("held")
        turn = packed["turn"][0].as_py()
        numbers = np.arange(turn * TURN, min(reps, (turn + 1) * TURN))
        codes, own = [], []
        for k in (0, 1):
            parts = [np.frombuffer(c.as_buffer(), f"<u{w}") for x, w, c in zip(packed["label"].to_pylist(), packed["wide"].to_pylist(), packed["codes"], strict=True) if x == k]
            codes.append(np.concatenate([np.empty(0, dtype=np.uint8), *parts]))
            own.append(np.concatenate([np.empty(0, dtype=np.uint32), *(hash_array(np.arange(at, min(at + block, len(codes[k]))) * 2 + k, seed + 1) for at in range(0, len(codes[k]), block))]))
        n_codes = 1 + max(int(c.max(initial=0)) for c in codes)
        found = []
        for mark in hash_array(numbers, seed + 2):
            neg, pos = (_landed(codes[k], own[k], mark, n_codes, seed, block)[1:] for k in (0, 1))  # code 0 is a missing score
            both = pos.sum() * neg.sum(dtype=np.float64)
            found.append((pos * (2 * (np.cumsum(neg) - neg) + neg)).sum() / (2 * both) if both > 0 else np.nan)
        kept = len(numbers) if n_codes > 1 else 0  # a group without scores has no areas
        cols = [pa.array([packed[c][0].as_py()] * kept, packed[c].type) for c in group]
        return pa.table([*cols, pa.array(numbers[:kept], pa.int32()), pa.array(np.array(found)[:kept], from_pandas=True)], names=[*group, "rep", "auc"])

    packed = coded.groupBy(*by, "held").applyInArrow(pack, named([*by, "held"]) + ", wide int, codes binary")
    turns = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // TURN))).alias("turn")).repartition(PARTS, *group, "turn")
    return turns.groupBy(*group, "turn").applyInArrow(areas, ", ".join([*(f"`{c}` {kinds[c]}" for c in group), "rep int", "auc double"]))


def drawn_auc(drawn: DataFrame, group: list[str], score: str, label: str = "label", domain=(0.0, 1.0)) -> DataFrame:
    """(group..., rep, auc) of rows that are there once for each replicate that takes them, with ``times``."""
    keys = [*group, "rep"]
    pos = F.when(F.col(label) == 1, F.col("times")).otherwise(0)
    neg = F.when(F.col(label) == 0, F.col("times")).otherwise(0)
    dist = R.value_counts(R.clean_scores(drawn, score), keys, score, {"pos": pos, "neg": neg})
    p = R.running_sums(dist, keys, score, ["pos", "neg"], domain)
    d = lambda c: F.col(c).cast("double")
    won = F.sum(d("pos") * (d("below_neg") + d("neg") / 2))
    return p.groupBy(*keys).agg((won / F.nullif(F.max(d("total_pos")) * F.max(d("total_neg")), F.lit(0.0))).alias("auc"))


def interval(reps: DataFrame, group: list[str], value: str = "auc") -> DataFrame:
    """2.5 and 97.5 percentiles and population spread over replicates (a bounded number per group)."""
    aggs = [
        F.count(F.lit(1)).alias("reps"),
        F.round(F.percentile(value, 0.025), 6).alias("lo"),
        F.round(F.percentile(value, 0.975), 6).alias("hi"),
        F.round(F.stddev_pop(value), 6).alias("se"),
    ]
    return reps.groupBy(*group).agg(*aggs) if group else reps.agg(*aggs)


def drawn_rows(rows: DataFrame, group: list[str], label: str, index: str, reps: int = REPS, seed: int = 0) -> DataFrame:
    """Rows repeated per replicate with their multiplicity."""
    times = draw_multiplicities(rows, group, label, index, reps, seed)
    return times.join(rows, [*group, label, index])
