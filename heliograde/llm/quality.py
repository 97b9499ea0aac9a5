"""Quality rules: divergence of a document's histograms from its language's reference.

A reference holds, for each language, the counts of character classes and of common function
words over *all* documents. A document is measured by the Jensen-Shannon distance (base 2) of its two
histograms from the reference of its language. Too short histograms are not judged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of four languages. All languages share one list, so that a
# text in another language than it says diverges too.
COMMON_WORDS = (
    "the of and to in a is it that for was on are with as be at this by from or an have not but "
    "le la les de des du un une et en que qui est pas pour par sur dans au avec "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch wird "
    "el los las del y se por con no para su lo como más al una sus es"
).split()
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 10  # base rule: fewer words fail
MAX_REPEAT_PERCENT = 20  # base rule: more words inside repeated 5-word windows fail
# A sample of the reference itself is the further off the shorter it is, as 1 / sqrt(words): limits are (a, b) of a + b / sqrt(words).
CHAR_LIMIT, CHAR_LEAST = (0.17, 1.6), 200  # distance limit and shortest histogram (bytes) of the class test
WORD_LIMIT, WORD_LEAST = (0.10, 2.4), 60  # the same for common words

_CLASSES = 10


def _class_table() -> np.ndarray:
    """Byte -> class: lower, upper, digit, blank, line break, sentence marks, other marks, symbols, control, non-ASCII."""
    t = np.full(256, 8, dtype=np.uint8)
    t[0x80:] = 9
    t[0x21:0x7F] = 6
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:'\"-()", "", SYMBOLS)):
        for c in chars:
            t[ord(c)] = k
    return t


_TABLE = _class_table()
_COMMON = list(dict.fromkeys(w.encode() for w in COMMON_WORDS))
_BINS = _CLASSES + len(_COMMON) + 1  # classes, words, every other word


def _classes(raw: bytes) -> np.ndarray:
    return np.bincount(_TABLE[np.frombuffer(raw, dtype=np.uint8)], minlength=_CLASSES)


def _common(words: list[bytes]) -> list[int]:
    c = Counter(words)
    own = [c[w] for w in _COMMON]
    return [*own, len(words) - sum(own)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not text or lang is None:
                continue
            raw = text.encode()
            have = total.setdefault(lang, np.zeros(_BINS, dtype=np.int64))
            have[:_CLASSES] += _classes(raw)
            have[_CLASSES:] += _common(raw.lower().split())
        if len(total) > 1000:  # languages come from the data: never hold many
            yield from _flush(total)
            total = {}
    yield from _flush(total)


def _flush(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if total:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k in total for _ in range(_BINS)], pa.string()),
                pa.array(list(range(_BINS)) * len(total), pa.int32()),
                pa.array(np.concatenate(list(total.values()))),
            ],
            names=["lang", "bin", "n"],
        )


def language_references(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, bin, n): histogram counts of every language over all documents; null texts and languages add nothing."""
    return (
        docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
        .mapInArrow(_counts, "lang string, bin int, n bigint")
        .groupBy("lang", "bin")
        .agg(F.sum("n").alias("n"))
    )


ROWS = 500  # rows of a batch that are judged at once


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of count rows; nan where a row is empty."""
    none = (p.sum(axis=1) == 0) | (q.sum(axis=1) == 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = p / p.sum(axis=1, keepdims=True), q / q.sum(axis=1, keepdims=True)
        m = (p + q) / 2
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=1)
        return np.where(none, np.nan, np.sqrt(np.maximum(0.0, (kl(p) + kl(q)) / 2)))


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    often = Counter(grams)
    covered, end = 0, 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


_SPACES = " \t\n\x0b\x0c\r"
STATS = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "base_failed:boolean,kept:boolean,char_distance:double,word_distance:double>"
)


def judge(reference: dict[str, np.ndarray], char_limit: tuple[float, float] = CHAR_LIMIT, word_limit: tuple[float, float] = WORD_LIMIT):
    """A column function (text, lang) -> STATS. ``reference``: language -> counts of all bins."""

    @F.arrow_udf(STATS)
    def stats(text: pa.Array, lang: pa.Array) -> pa.Array:
        parts = [some(text.slice(at, ROWS), lang.slice(at, ROWS)) for at in range(0, max(1, len(text)), ROWS)]
        return pa.concat_arrays(parts)

    def some(text: pa.Array, lang: pa.Array) -> pa.Array:
        rows, near, far, langs = [], [], [], []
        for t, own in zip(text.to_pylist(), lang.to_pylist(), strict=True):
            t = t or ""
            raw = t.encode()
            words = raw.split()  # bytes: exactly space and \x09-\x0D part words
            n, repeat = len(words), repeated_words(words)
            lines = [x for x in t.split("\n") if x.strip(_SPACES)]
            rows.append((n, len(t) - sum(map(t.count, _SPACES)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n))
            ref = reference.get(own)
            judged = ref is not None
            near.append(_classes(raw) if judged and len(raw) >= CHAR_LEAST else np.zeros(_CLASSES, dtype=np.int64))
            far.append(_common(raw.lower().split()) if judged and n >= WORD_LEAST else [0] * (_BINS - _CLASSES))
            langs.append(ref if judged else np.zeros(_BINS, dtype=np.int64))
        if rows:
            refs = np.array(langs)
            chars, common = _distance(np.array(near), refs[:, :_CLASSES]), _distance(np.array(far), refs[:, _CLASSES:])
        else:
            chars = common = np.zeros(0)
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        failed = np.array([r[5] for r in rows], dtype=bool)
        root = np.sqrt(np.maximum(1, [r[0] for r in rows]))
        over = [d > a + b / root for d, (a, b) in ((chars, char_limit), (common, word_limit))]
        kept = ~failed & ~over[0] & ~over[1]  # nan compares false: not judged
        cols += [pa.array(failed), pa.array(kept), pa.array(chars, from_pandas=True), pa.array(common, from_pandas=True)]
        return pa.StructArray.from_arrays(cols, names=[x.split(":")[0] for x in STATS[7:-1].split(",")])

    return stats


def collect_references(counts: DataFrame) -> dict[str, np.ndarray]:
    """The references as arrays on the driver: one row of fixed width for each language."""
    out: dict[str, np.ndarray] = {}
    for r in counts.toLocalIterator():
        out.setdefault(r["lang"], np.zeros(_BINS, dtype=np.int64))[r["bin"]] = r["n"]
    return out


def with_quality(docs: DataFrame, into: str = "quality_stats", lang: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` with a struct column of counts, distances and the verdict ``kept``; all rows and columns stay.

    A null or empty text has no words and fails the base rule. A null language has no reference, so only the base
    rule judges it. Repeated rows and ids are judged one by one; an empty table gives an empty result.
    """
    reference = collect_references(language_references(docs, lang, text))
    return docs.withColumn(into, judge(reference)(F.col(text), F.col(lang)))
