"""SentencePiece (BPE with byte fallback): encoding through a table of last tokens, and decoding.

For every prefix of a text there is exactly one token that ends its encoding. An automaton over the vocabulary lists the
tokens ending at a position; the last one is the token whose pair with the last token before it is stable, that is, no merge
across their border would have come before the merges that made them. The ids are read backwards from that table.
Runs of blanks are the one exception: their pieces all have the same rank, merge last and leftmost first, and are made by that
rule. No piece holds a blank after another character, so a text falls into words that are encoded one by one and remembered.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
REMEMBERED = 700_000  # words kept by a task before it starts afresh
BATCH_CHARS = 8_000_000  # characters of a result batch


class Pieces:
    """A vocabulary: encode one text, decode one list of ids."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], dummy_prefix: bool = True):
        """``kinds``: 1 normal, 6 byte, anything else takes no part in encoding (control, unknown, unused)."""
        if any(BLANK in p.lstrip(BLANK) or (p.startswith(2 * BLANK) and p.strip(BLANK)) for p, k in zip(pieces, kinds, strict=True) if k == 1):
            raise ValueError("pieces with a blank after another character, or two before one, are not supported")
        self.dummy_prefix = dummy_prefix
        self.pieces = pieces
        self.byte_ids = [0] * 256
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == 6:
                self.byte_ids[int(p[3:-1], 16)] = i
        normal = [i for i, k in enumerate(kinds) if k == 1]
        self.runs = {p: i for i in normal if not (p := pieces[i]).strip(BLANK)}
        own = {pieces[i]: i for i in normal if len(pieces[i].strip(BLANK)) > 0 or pieces[i] == BLANK}
        # ranks: single characters first, then merges from the best score on
        order = sorted(own, key=lambda p: (len(p) > 1, -scores[own[p]] if len(p) > 1 else 0, own[p]))
        self.rank = {p: r for r, p in enumerate(order)}
        self.n_single = sum(len(p) == 1 for p in order)
        if len({scores[own[p]] for p in order[self.n_single :]}) < len(order) - self.n_single:
            raise ValueError("merges of equal score outside runs of blanks are not supported")
        self.ids = [own[p] for p in order]
        self.length = [len(p) for p in order]
        self.split = [(r, r) for r in range(len(order))]
        self.joined: dict[tuple[int, int], int] = {}
        valid = ahocorasick.Automaton()
        for r, p in enumerate(order):
            if len(p) > 1:
                halves = self._last_merge(p)
                if halves is None:
                    continue  # no merges lead to it
                self.split[r] = halves
                self.joined[halves] = r
            valid.add_word(p, (r, len(p)))
        valid.make_automaton()
        self.automaton = valid
        self.characters = {c for p in order for c in p}
        self.neighbours = {ab for p in order for ab in zip(p, p[1:], strict=False)}
        self.stable: dict[int, bool] = {}  # by left << 20 | right
        self.words: dict[str, bytes] = {}
        self.remembered = REMEMBERED
        self.lone = array("i", [self.runs[BLANK]]).tobytes()
        self.raw = [b""] * len(pieces)  # what a token decodes to; control tokens to nothing
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == 6:
                self.raw[i] = bytes([int(p[3:-1], 16)])
            elif k == 1:
                self.raw[i] = p.replace(BLANK, " ").encode()
            elif k == 2:
                self.raw[i] = " ⁇ ".encode()
        self.silent = {i for i, r in enumerate(self.raw) if not r}

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``piece``, by playing all merges; None if they do not end in one token."""
        parts = list(piece)
        if any(c not in self.rank for c in parts):
            return None
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.rank:
                return None
            last = (self.rank[parts[best]], self.rank[parts[best + 1]])
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return last

    def _pair_is_stable(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart: undo the later of their merges again and again, and look for a merge across."""
        joined, split = self.joined, self.split
        limit = 1 << 60
        while True:
            across = joined.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                limit = left
                left = split[left][1]
                if left == limit:
                    limit = right + 1
                    right = split[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = split[right][0]
                if right + 1 == limit:
                    limit = left
                    left = split[left][1]
                    if left == limit:
                        return True

    def _known(self, word: str) -> list[int]:
        """Ids of a word whose characters are all in the vocabulary."""
        n = len(word)
        last = [-1] * n
        stable = self.stable
        for end, (r, size) in self.automaton.iter(word):  # at each end from the longest match to the shortest
            if last[end] >= 0:
                continue
            if size > end:
                last[end] = r
                continue
            other = last[end - size]
            pair = other << 20 | r
            ok = stable.get(pair)
            if ok is None:
                if len(stable) > self.remembered:
                    stable.clear()
                ok = stable[pair] = self._pair_is_stable(other, r)
            if ok:
                last[end] = r
        back = []
        at = n - 1
        while at >= 0:
            r = last[at]
            back.append(self.ids[r])
            at -= self.length[r]
        back.reverse()
        return back

    def _stretch(self, word: str) -> bytes:
        """Ids of a word without runs of blanks.

        Characters that are neighbours in no piece never merge, so the word is cut between them; one outside the vocabulary
        becomes its bytes.
        """
        if self.characters.issuperset(word):
            parts = [word]
        else:
            cuts = [0, *(i for i, ab in enumerate(zip(word, word[1:], strict=False), 1) if ab not in self.neighbours), len(word)]
            parts = [word[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        out = b""
        for part in parts:
            if len(part) > 1:
                ids = self._known(part)
            elif part in self.rank:
                ids = [self.ids[self.rank[part]]]
            else:
                ids = [self.byte_ids[b] for b in part.encode()]
            out += array("i", ids).tobytes()
        return out

    def _run(self, n: int) -> list[int]:
        """Ids of n blanks: equal ranks merge from the left, round after round as pairs come up."""
        if n > 4096:  # all blocks of the longest piece first are what the merges give
            longest = max(map(len, self.runs))
            most = 1
            while 2 * most <= longest and BLANK * (2 * most) in self.runs:
                most *= 2
            whole = n // most - 64
            if most == longest and whole > 0:
                return [self.runs[BLANK * most]] * whole + self._run(n - whole * most)
        sym = [1] * n
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(i, 1, 1) for i in range(n - 1) if BLANK * 2 in self.runs]
        while heap:
            i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, 0
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and BLANK * (sym[x] + sym[y]) in self.runs:
                    heapq.heappush(heap, (x, sym[x], sym[y]))
        return [self.runs[BLANK * k] for k in sym if k]

    def _word(self, word: str) -> bytes:
        """Ids of one blank and what follows it up to the next blank."""
        if "\n" not in word or "\n" in self.characters:
            return self._stretch(BLANK + word)
        first, *more = word.split("\n")
        line = array("i", [self.byte_ids[10]]).tobytes()
        return b"".join([self._stretch(BLANK + first), *(x for w in more for x in (line, self._stretch(w) if w else b""))])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as int32; none for null and empty texts."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        parts = (text if self.dummy_prefix else text.removeprefix(" ")).replace(BLANK, " ").split(" ")
        out, words, blanks, lone = [], self.words, 0, self.lone
        for p in parts:
            if not p:
                blanks += 1
                continue
            ids = words.get(p)
            if ids is None:
                if len(words) > self.remembered:
                    words.clear()
                ids = self._word(p)
                if len(p) <= 64:
                    words[p] = ids
            if blanks:
                if ids[:4] == lone:  # its own blank stands alone and joins the run
                    blanks, ids = blanks + 1, ids[4:]
                out.append(array("i", self._run(blanks)).tobytes())
                blanks = 0
            out.append(ids)
        if blanks:
            out.append(array("i", self._run(blanks)).tobytes())
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def forget(self) -> None:
        """Lets go of the words remembered."""
        self.words.clear()
        self.stable.clear()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD one by one."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        if self.silent.isdisjoint(ids):
            return self._text(ids, True)
        runs: list[list[int]] = [[]]  # a control token decodes to nothing and ends a run of bytes
        for i in ids:
            runs.append([]) if i in self.silent else runs[-1].append(i)
        runs = [r for r in runs if r]
        return "".join(self._text(r, k == 0) for k, r in enumerate(runs))

    def _text(self, ids: list[int], first: bool) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = _lossy(raw)
        return text[1:] if first and self.dummy_prefix and ids and self.pieces[ids[0]].startswith(BLANK) else text


def _lossy(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """The vocabulary of a model file; only BPE models whose normalizer changes nothing are supported."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError(f"{path}: not a BPE model with an identity normalizer ({sentencepiece.__version__})")
    return Pieces([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], norm.add_dummy_prefix)


def encode_decode(docs: DataFrame, model: str, ident: str = "doc_id", text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """(ident, ids array<int>, decoded string) for every row of ``docs``; ``model`` is a path or a file of the public set by name.

    Null and empty texts have no ids and decode to the empty string. Repeated rows and ids are encoded one by one; an
    empty table gives an empty result. Columns other than the two named are not read. ``remembered`` bounds the words that a task keeps.
    """
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path(model))
        pieces.remembered = remembered
        try:
            for b in batches:
                ids, texts, at = [], [], 0
                size = 0
                for k, t in enumerate(b.column(1)):
                    got = pieces.encode(t.as_py())
                    ids.append(got)
                    texts.append(pieces.decode(got))
                    size += len(texts[-1])
                    if size > BATCH_CHARS or k == b.num_rows - 1:
                        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                        arr = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ids)), arr, pa.array(texts, pa.string())], names=["ident", "ids", "decoded"])
                        ids, texts, at, size = [], [], k + 1, 0
        finally:
            pieces.forget()  # workers live on beside other jobs

    out = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text")).mapInArrow(run, f"ident {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("ident", ident)


def model_path(model: str) -> str:
    """A model file by path, or by its name in the installed public set."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def digests(encoded: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(ident, n_tokens, ids_sha256, decoded_sha256) of what ``encode_decode`` returns: digests of the decimal ids and of the text."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(ident, F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
