"""License scans: phrases word by word, and an exact containment join of text blocks with license templates.

A block is a stretch of words of the text, across line ends; a template is a set of words. Blocks overlap by the longest template at least. A block matches if it holds at least the threshold's share of
the template's distinct words. Words of templates are put in one order for the whole corpus, rarest first. A template that
matches a block shares one of its first (size - needed + 1) words with it (prefix filter), the block has at least as many words
as are needed (length filter), and the words left after the first common one suffice (position filter). What
passes is counted exactly. Templates are few and fixed, so their index goes to every task; blocks never meet each other.

Licenses of one family differ by a word, so containment alone names several. Two templates of different labels are rivals where the words of
one make up the needed share of the other. Against a rival, a template needs all the words that the rival lacks; and where
the block has all the words that only the rival has, the template must stand whole between them, in a stretch a quarter longer than
itself at most. Numbers of a template, which are versions, must be there in any case.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The phrases that count as places, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Opening or notice sentences of common licenses, lower case, without marks.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work cc0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.9
STEP = 32  # words between the starts of two blocks, or as many as the longest template has; a block is twice as long

# Bytes of words are 0-9, a-z and all beyond ASCII; A-Z become a-z, everything else parts words.
_FOLD = bytes(c if c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


class Index:
    """Templates whose words are ordered by corpus frequency, and the prefix index over them."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], threshold: float = THRESHOLD):
        words = {w for _, t in templates for w in t.encode().split()}
        order = sorted(words, key=lambda w: (frequency.get(w.decode(), 0), w))
        self.order = {w: k for k, w in enumerate(order)}
        self.templates, self.prefix = [], {}
        for label, text in templates:
            own = sorted({self.order[w] for w in text.encode().split()})
            need = math.ceil(threshold * len(own) - 1e-9)
            for at, w in enumerate(own[: len(own) - need + 1]):
                self.prefix.setdefault(w, []).append((len(self.templates), at))
            self.templates.append((label, frozenset(own), need))
        self.numbers = [frozenset(w for w in own if order[w].isdigit()) for _, own, _ in self.templates]
        self.rivals = [self._rivals(k) for k in range(len(self.templates))]
        self.step = max([STEP, *(len(t.split()) for _, t in templates)])
        self.first_words = frozenset(order[w] for w in self.prefix)

    def _rivals(self, k: int) -> list[tuple[frozenset[int], frozenset[int]]]:
        """For each rival of a template: the words that the rival lacks and the template must therefore show, and the words that only the rival has."""
        label, own, need = self.templates[k]
        out = []
        for other, words, other_need in self.templates:
            both = len(own & words)
            if other != label and both >= min(need, other_need):
                out.append((own - words if both >= need else frozenset(), words - own))
        return out

    def _stands(self, k: int, block: list[bytes], own: set[int]) -> bool:
        """Whether a template whose words the block holds is meant, and not a rival."""
        _, words, _ = self.templates[k]
        if not self.numbers[k] <= own:
            return False
        for lacking, only in self.rivals[k]:
            if not lacking <= own:
                return False
            if only and only <= own:
                near: deque[int | None] = deque(maxlen=len(words) + len(words) // 4)
                for w in map(self.order.get, block):
                    near.clear() if w in only else near.append(w)
                    if w in words and words <= set(near):
                        break
                else:
                    return False
        return True

    def _contained(self, block: set[bytes], distinct: int) -> list[tuple[int, float]]:
        """(template, containment) of every template whose needed share a block with so many distinct words holds."""
        own = sorted(self.order[w] for w in block if w in self.order)
        out, seen = [], set()
        for at, w in enumerate(own):
            for k, place in self.prefix.get(w, ()):
                _, words, need = self.templates[k]
                if k in seen or distinct < need:
                    continue
                seen.add(k)  # the first common word decides the position filter
                if 1 + min(len(words) - place - 1, len(own) - at - 1) < need:
                    continue
                both = len(words.intersection(own))
                if both >= need:
                    out.append((k, both / len(words)))
        return out

    def match(self, block: set[bytes], distinct: int) -> list[tuple[str, float]]:
        """(label, containment) of every template that the block (its words, and how many they are) holds, rivals or not."""
        return [(self.templates[k][0], share) for k, share in self._contained(block, distinct)]

    def meant(self, block: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that a block of words in order holds and that no rival explains."""
        held = set(block)
        found = self._contained(held, len(held))
        own = {self.order[w] for w in held if w in self.order} if found else set()
        return [(self.templates[k][0], share) for k, share in found if self._stands(k, block, own)]


def template_frequencies(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> dict[str, int]:
    """How often each template word occurs in all documents. The result has one row for each such word, whatever the corpus."""
    known = {w for _, t in templates for w in t.encode().split()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                total.update(filter(known.__contains__, (t or "").encode().translate(_FOLD).split()))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def _blocks(words: list[bytes], step: int) -> Iterator[list[bytes]]:
    """Any ``step`` words in a row lie in one block."""
    for at in range(0, max(1, len(words) - step), step):
        yield words[at : at + 2 * step]


RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())]
)


def scan(text: str | None, index: Index, phrases: dict[str, str]) -> tuple:
    """One row of RESULT for one text."""
    words = (text or "").encode().translate(_FOLD).split()
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in phrases.items():
        find = b" " + phrase.encode() + b" "
        at, word, last = joined.find(find), 0, 0
        while at >= 0:
            word, last = word + joined.count(b" ", last, at), at
            places.append(word)
            base.add(label)
            at = joined.find(find, at + 1)
    labels, score = set(base), 1.0 if base else 0.0
    if not index.first_words.isdisjoint(words):
        for block in _blocks(words, index.step):
            if index.first_words.isdisjoint(block):
                continue
            for label, share in index.meant(block):
                labels.add(label)
                score = max(score, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def license_scan(docs: DataFrame, ident: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """(ident, RESULT columns) for every row of ``docs``.

    n_base counts all places of all phrases; first_word and last_word are their smallest and largest start. base_labels and
    labels are distinct, sorted and comma-joined; score is the highest containment found, 1 where a phrase stands, else 0.
    Null and empty texts have no words, no places, empty labels and score 0. Rows are scanned one by one, so repeated rows and
    ids stay; an empty table gives an empty result.
    """
    index = Index(templates, template_frequencies(docs, templates, text), threshold)

    @F.arrow_udf(RESULT)
    def run(t: pa.Array) -> pa.Array:
        rows = [scan(x.as_py(), index, phrases) for x in t]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=RESULT.names)

    return docs.select(F.col(ident), run(F.col(text)).alias("__r")).select(ident, "__r.*")
