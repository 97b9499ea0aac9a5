"""Byte-level BPE: encoding by replaying all merges over the words of a corpus at once, and decoding.

The words of many texts are laid out one after another as one sequence of tokens, each distinct word once. An inverted index holds, for
each merge, the positions of the pairs that it joins. Merges are taken from the index in rank order; each is applied at all its
positions, and only the two neighbours of a joined pair are looked up again and put into the index. What a merge does inside a word
depends on that word alone, so a corpus may be replayed in blocks: a task takes blocks of bounded size, remembers the words it has seen,
and replays those that are new.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REMEMBERED = 800_000  # words kept by a task before it starts afresh
BLOCK_CHARS = 8_000_000  # characters whose words are replayed together
SIMPLE_BELOW = 0x500  # below this code point letters and digits are the same in all versions of Unicode that matter here
GONE = 0xFFFF_FFFF
FEW = 40  # positions from which on a merge is applied to all of them at once


class _Sequence:
    """Tokens of all words with links to both neighbours; ``n`` is the border of a word. Each array is also there as a memory view, for single items."""

    def __init__(self, tokens: np.ndarray, ends: np.ndarray, sizes: np.ndarray):
        self.n = n = len(tokens)
        self.tokens = np.append(tokens.astype(np.int64), GONE)
        self.rights = np.arange(1, n + 2)
        self.rights[ends - 1] = n
        self.lefts = np.arange(-1, n)
        self.lefts[ends - sizes] = n
        self.token, self.right, self.left = memoryview(self.tokens), memoryview(self.rights), memoryview(self.lefts)


class _Index:
    """From the rank of a merge to the positions of the pairs it joins; ``heap`` holds the ranks that have positions."""

    def __init__(self):
        self.single: dict[int, list[int]] = {}
        self.arrays: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []

    def add_one(self, rank: int, place: int) -> None:
        got = self.single.get(rank)
        if got is not None:
            got.append(place)
        else:
            self.single[rank] = [place]
            if rank not in self.arrays:
                heapq.heappush(self.heap, rank)

    def add(self, ranks: np.ndarray, places: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        starts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.concatenate([[0], starts])].tolist(), np.split(places, starts), strict=True):
            if rank not in self.arrays:
                self.arrays[rank] = []
                if rank not in self.single:
                    heapq.heappush(self.heap, rank)
            self.arrays[rank].append(part)

    def pop(self) -> tuple[int, list[int] | np.ndarray]:
        """The lowest rank and its positions in order: a list if they are few, else an array."""
        rank = heapq.heappop(self.heap)
        single, arrays = self.single.pop(rank, []), self.arrays.pop(rank, [])
        if len(single) + sum(map(len, arrays)) < FEW:
            return rank, sorted({*single, *(p for a in arrays for p in a.tolist())})
        return rank, np.unique(np.concatenate([np.array(single, dtype=np.int64), *arrays]))


class BytePairs:
    """A vocabulary with its merges: encode words, decode ids."""

    def __init__(self, raw: list[bytes], pairs: dict[tuple[int, int], tuple[int, int]] | None, whole: bool):
        """``raw``: bytes of each id. ``pairs``: (left, right) -> (rank, id); None if any two tokens whose bytes stand in the
        vocabulary may join, the id being the rank. ``whole``: a word that is itself in the vocabulary is that token."""
        self.raw = raw
        self.ids = {b: i for i, b in enumerate(raw)}
        self.whole = whole
        self.bits = max(len(raw) - 1, 1).bit_length()
        self.rank: dict[int, int] = {}  # of a pair left << bits | right; -1 if the two never join
        self.made: list[int] = []  # id of what the merge of a rank makes
        if pairs is None:
            self.made = list(range(len(raw)))
        else:
            self.made = [0] * (1 + max((r for r, _ in pairs.values()), default=0))
            for (a, b), (r, i) in pairs.items():
                self.rank[a << self.bits | b] = r
                self.made[r] = i
        self.listed = pairs is not None
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.uint32)
        first = np.full((256, 256), -1, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                first[a, b] = self._rank(int(self.byte_ids[a]), int(self.byte_ids[b]))
        self.first = first
        self.known: dict[str, bytes] = {}
        self.remembered = REMEMBERED

    def _rank(self, left: int, right: int) -> int:
        key = left << self.bits | right
        r = self.rank.get(key)
        if r is None:
            if self.listed:
                return -1
            if len(self.rank) > 4_000_000:
                self.rank.clear()
            r = self.rank[key] = self.ids.get(self.raw[left] + self.raw[right], -1)
        return r

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word (none of them empty), all merges replayed over all words together."""
        joined = b"".join(words)
        n = len(joined)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        data = np.frombuffer(joined, dtype=np.uint8)
        state = _Sequence(self.byte_ids[data], ends, sizes)
        ranks = np.full(n, -1, dtype=np.int64)
        ranks[:-1] = self.first[data[:-1], data[1:]]
        ranks[ends - 1] = -1  # the last byte of a word has no right neighbour
        at = np.flatnonzero(ranks >= 0)
        index = _Index()
        index.add(ranks[at], at)
        odd: set[int] = set()  # positions in words in which an earlier merge came up late
        while index.heap:
            r, places = index.pop()
            if len(places) < FEW:
                self._join_few(state, index, odd, r, places)
            else:
                self._join_many(state, index, odd, r, places)
        live = state.tokens[:-1] != GONE
        packed = state.tokens[:-1][live].astype("<u4").tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(live)[ends - 1]])).tolist()
        out = [packed[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        for w in set(np.searchsorted(ends, sorted(odd), side="right").tolist()):
            out[w] = self._one(words[w])
        return out

    def _join_few(self, state: _Sequence, index: _Index, odd: set[int], r: int, places: list[int]) -> None:
        """The merge of rank ``r`` at its positions, from the left."""
        token, right, left, n, bits, known = state.token, state.right, state.left, state.n, self.bits, self.rank
        new = self.made[r]
        for i in places:
            a, j = token[i], right[i]
            if a == GONE or j == n:
                continue
            b = token[j]
            q = known.get(a << bits | b)
            if (self._rank(a, b) if q is None else q) != r:
                continue  # one of the two has joined another since
            token[i] = new
            token[j] = GONE
            k = right[i] = right[j]
            h = left[i]
            if k != n:
                left[k] = i
                q = known.get(new << bits | token[k])
                if q is None:
                    q = self._rank(new, token[k])
                if q >= 0:
                    odd.add(i) if q < r else index.add_one(q, i)
            if h != n:
                q = known.get(token[h] << bits | new)
                if q is None:
                    q = self._rank(token[h], new)
                if q >= 0:
                    odd.add(i) if q < r else index.add_one(q, h)

    def _join_many(self, state: _Sequence, index: _Index, odd: set[int], r: int, places: np.ndarray) -> None:
        """The same for many positions at once, where no two of them share a token."""
        tokens, rights, lefts, n = state.tokens, state.rights, state.lefts, state.n
        j = rights[places]
        here = (tokens[places] != GONE) & (j != n)
        places, j = places[here], j[here]
        pairs = tokens[places] << self.bits | tokens[j]
        kinds, of = np.unique(pairs, return_inverse=True)
        fits = [self._rank(x >> self.bits, x & ((1 << self.bits) - 1)) == r for x in kinds.tolist()]
        if not any(fits):
            return
        kept = np.array(fits)[of]
        places, j = places[kept], j[kept]
        if sum(fits) > 1 or len(np.intersect1d(places, j, assume_unique=True)):
            return self._join_few(state, index, odd, r, places.tolist())
        new, a = self.made[r], int(tokens[places[0]])
        tokens[places] = new
        tokens[j] = GONE
        k = rights[j]
        rights[places] = k
        inner = k != n
        lefts[k[inner]] = places[inner]
        if 0 <= self._rank(new, a) < r:  # between two neighbouring places, before the right one is joined
            odd.update(places[inner][tokens[k[inner]] == new].tolist())
        h = lefts[places]
        outer = h != n
        self._enter(index, odd, r, new << self.bits | tokens[k[inner]], places[inner])
        outer &= tokens[np.where(outer, h, 0)] != new  # a neighbour made here has entered the pair from its side
        self._enter(index, odd, r, tokens[h[outer]] << self.bits | new, h[outer])

    def _enter(self, index: _Index, odd: set[int], r: int, pairs: np.ndarray, places: np.ndarray) -> None:
        """Puts the pairs that begin at ``places`` into the index."""
        if not len(pairs):
            return
        kinds, of = np.unique(pairs, return_inverse=True)
        mask = (1 << self.bits) - 1
        ranks = np.array([self._rank(x >> self.bits, x & mask) for x in kinds.tolist()], dtype=np.int64)[of]
        late = (ranks >= 0) & (ranks < r)
        if late.any():
            odd.update(places[late].tolist())
        later = ranks > r
        index.add(ranks[later], places[later])

    def _one(self, word: bytes) -> bytes:
        """A word in which merges do not come up in rank order: the lowest rank first, the leftmost of equals, again and again."""
        n = len(word)
        token = [*self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist(), GONE]
        right, left = [*range(1, n + 1), n], list(range(-1, n))
        heap = [(r, i) for i in range(n - 1) if (r := self._rank(token[i], token[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if token[i] == GONE or j >= n or self._rank(token[i], token[j]) != r:
                continue
            token[i], token[j] = self.made[r], GONE
            right[i] = right[j]
            left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (q := self._rank(token[x], token[y])) >= 0:
                    heapq.heappush(heap, (q, x))
        return np.array([t for t in token if t != GONE], dtype="<u4").tobytes()

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit integers) of each text, as one block."""
        split = [words_of(t) for t in texts]
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        new = list(set().union(*split).difference(known))
        if new:
            raw = [w.encode() for w in new]
            if self.whole:
                ids = self.ids
                done = {w: array("I", [ids[b]]).tobytes() for w, b in zip(new, raw, strict=True) if b in ids}
                known.update(done)
                rest = [(w, b) for w, b in zip(new, raw, strict=True) if w not in done]
                new, raw = [w for w, _ in rest], [b for _, b in rest]
            if new:
                known.update(zip(new, self.replay(raw), strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > 64:  # long words seldom come again
                del known[w]
        return out

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


# Fixed value: the pattern of the public vocabularies, with white space written out, since engines differ on U+001C to U+001F.
SPACE = "\t-\r \x85\xa0  -     　"
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{l}{n}]+|[{S}]+(?![^{S}])|[{S}]+"


def _range_of(kind: str) -> str:
    """Code points of a general category below SIMPLE_BELOW, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(SIMPLE_BELOW) if unicodedata.category(chr(c))[0] == kind)


def _pattern(letters: str, numbers: str) -> str:
    return PATTERN.format(L=f"[{letters}]", N=f"[{numbers}]", S=SPACE, l=letters, n=numbers)


_SIMPLE = re.compile(_pattern(_range_of("L"), _range_of("N")))
_FULL = regex.compile(_pattern(r"\p{L}", r"\p{N}"))
_BEYOND = re.compile(f"[^\\x00-{chr(SIMPLE_BELOW - 1)}]")


def words_of(text: str) -> list[str]:
    """The matches of the pattern, which cover the whole text."""
    return (_FULL if _BEYOND.search(text) else _SIMPLE).findall(text)


@lru_cache(maxsize=4)
def load(path: str) -> BytePairs:
    """A vocabulary file: ``.tiktoken`` (base64 bytes and rank in each line) or ``.json`` (vocabulary and list of merges)."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError(f"{path}: ranks are not 0 to n - 1")
        return BytePairs(sorted(ranks, key=ranks.get), None, True)
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    if file.get("normalizer") or file["pre_tokenizer"] != file["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    to_byte = {c: b for b, c in enumerate(byte_letters())}
    names = sorted(model["vocab"], key=model["vocab"].get)
    special = {a["content"] for a in file.get("added_tokens", [])}
    raw = [n.encode() if n in special else bytes(map(to_byte.__getitem__, n)) for n in names]
    ids = model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return BytePairs(raw, {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(merges)}, False)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies kept as text: printable Latin-1 is itself, the rest count up from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def blocks(batches: Iterable[pa.RecordBatch], column: int, chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``chars`` characters (one text at least), and their texts; null is the empty text."""
    for b in batches:
        texts, size, at = [], 0, 0
        for k, t in enumerate(b.column(column)):
            texts.append(t.as_py() or "")
            size += len(texts[-1])
            if size > chars or k == b.num_rows - 1:
                yield b.slice(at, len(texts)), texts
                texts, size, at = [], 0, k + 1


def encode_decode(docs: DataFrame, vocabulary: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, ids binary, decoded binary) for every row of ``docs``: ids packed as little-endian unsigned 32-bit integers, the form of token
    files, and the bytes that the ids decode to. ``vocabulary`` is a path or a file of the public set by name.

    Null and empty texts have no ids. Repeated rows and ids are encoded one by one; an empty table gives an empty result.
    Columns other than the two named are not read. Strings of special tokens are plain text.
    """
    from heliograde.llm.pieces import model_path

    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(model_path(vocabulary))
        for part, texts in blocks(batches, 1):
            ids = pairs.encode_block(texts)
            decoded = [pairs.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["ident", "ids", "decoded"])

    out = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text")).mapInArrow(run, f"ident {kind}, ids binary, decoded binary")
    return out.withColumnRenamed("ident", ident)


def token_count(ids: Column | str = "ids") -> Column:
    """Number of packed ids."""
    return (F.octet_length(ids) / 4).cast("bigint")


def digests(encoded: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(ident, n_tokens, ids_sha256, decoded_sha256) of what ``encode_decode`` returns."""
    return encoded.select(ident, token_count().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
