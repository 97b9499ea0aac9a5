"""Main text of web pages: the maximum-scoring stretch of words and tags.

A page is a sequence of words and tags. A word scores by how surely words in its surroundings (the tags, classes and ids that
enclose it) are content, a tag scores negative; both weights come from labelled pages. A linear scan finds the contiguous stretch
of highest score. The text is that of the blocks inside it, without blocks whose own surroundings say boilerplate; a stretch that
begins inside an article or main element takes in the rest of that element.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td template "
    "textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object canvas select".split())
ROOTS = frozenset(("article", "main"))
# Elements and names that speak against content before any page was labelled.
AGAINST = frozenset("nav header footer aside form button select option script style noscript iframe template textarea title head menu dialog label fieldset svg math object canvas".split())
NAMES = re.compile(
    r"^(?:ads?|adverts?|advertisements?|adbox|banners?|sponsor(?:ed)?|promos?|side-?bar\w*|menus?|nav(?:bar|igation)?|foot(?:er)?|header|masthead|comments?|commentlist|"
    r"disqus|replies|respond|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe|signup|login|search|breadcrumbs?|share|sharing|social|"
    r"related|recommended|widgets?|pagination|pager|tags|toolbar|copyright|legal|disclaimer|skip|hidden)$"
)
SMOOTH = 50.0  # words that the assumption about a surrounding counts as
SAMPLE_PAGES = 2_000  # labelled pages that weights are learned from, at most about so many
TAG_SCORE = 0.4  # what a tag costs where nothing was learned

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@lru_cache(maxsize=4096)
def _keys(tag: str, attrs: str) -> tuple[str, ...]:
    """What an element is known by: its tag, and its tag with each class, id and role."""
    names = [n for m in _ATTR.finditer(attrs) for n in (m[2] or m[3] or m[4] or "").lower().split()]
    return (tag, *(f"{tag}.{n}" for n in names))


@lru_cache(maxsize=8192)
def assumed(key: str) -> float:
    """Share of content words that a surrounding is taken to have before pages are seen."""
    tag, _, name = key.partition(".")
    return 0.02 if tag in AGAINST or (name and any(map(NAMES.match, (name, *re.split(r"[-_]+", name))))) else 0.8


class Page:
    """Blocks of a page in order: text, keys of all that encloses it, tags before it, number of its root element (0: none)."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, tuple[str, ...], int, int]] = []
        stack: list[tuple[str, tuple[str, ...], int]] = []
        held: list[str] = []
        tags = roots = at = 0
        source = source or ""

        def close_block() -> None:
            nonlocal tags
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                keys = tuple(dict.fromkeys(k for _, ks, _ in stack for k in ks))
                self.blocks.append((text, keys, tags, next((r for _, _, r in reversed(stack) if r), 0)))
                tags = 0

        while at < len(source):
            m = _TOKEN.match(source, at)
            at = m.end()
            tag = m[2]
            if tag is None:
                if not m[0].startswith(("<!", "<?")):
                    held.append(html.unescape(m[0]))
                continue
            tag = tag.lower()
            tags += 1
            if tag in VOID:
                if tag in BLOCKS:
                    close_block()
                else:
                    held.append(" ")
                continue
            if tag in BLOCKS or tag in RAW:
                close_block()
            if m[1]:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if depth is not None:
                    if not (tag == "p" or tag not in BLOCKS) or all(stack[i][0] not in BLOCKS for i in range(depth + 1, len(stack))):
                        del stack[depth:]
                    else:
                        del stack[depth]
                continue
            if m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
                continue
            if tag in ("script", "style", "textarea", "title", "noscript", "iframe", "template"):  # what they hold is no page text
                end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in BLOCKS:
                # a new block ends an open paragraph and inline elements left open, an item or cell its predecessor
                while stack and (stack[-1][0] == "p" or stack[-1][0] not in BLOCKS):
                    stack.pop()
                if stack and stack[-1][0] == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                    stack.pop()
            roots += tag in ROOTS
            stack.append((tag, _keys(tag, m[3]), roots if tag in ROOTS else 0))
        close_block()


class Weights:
    """Scores of words and tags. ``content`` maps keys to (content words, all words) of labelled pages, "" to the totals."""

    def __init__(self, content: dict[str, tuple[int, int]], tags: tuple[int, int] = (0, 0)):
        self.content = content
        good, all_ = content.get("", (0, 0))
        self.base = (good + 0.6 * SMOOTH) / (all_ + SMOOTH)
        inside, outside = tags  # tags per word: content against the rest
        self.tag = TAG_SCORE if not outside else min(1.0, max(0.1, TAG_SCORE * (1 + outside) / (1 + inside) / 4))

    def share(self, key: str) -> float:
        good, all_ = self.content.get(key, (0, 0))
        return (good + SMOOTH * assumed(key)) / (all_ + SMOOTH)

    def word(self, keys: tuple[str, ...]) -> float:
        """Between -2 and 1: the least of what the surroundings say."""
        least = min((self.share(k) for k in keys if k not in ("html", "body")), default=self.base)
        return 1.0 if least >= 0.4 else -2.0 if least < 0.1 else -0.5


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous part of highest sum, the first and shortest of equals; (0, 0) if none is above 0."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_blocks(page: Page, weights: Weights) -> list[str]:
    """Texts of the blocks of the main content, in page order."""
    own = [weights.word(keys) for _, keys, _, _ in page.blocks]
    sizes = [text.count(" ") + 1 for text, _, _, _ in page.blocks]
    # words and tags in order; a block's words are one run, so the scan goes block by block
    scores = [x for (_, _, tags, _), w, n in zip(page.blocks, own, sizes, strict=True) for x in (-weights.tag * min(tags, 20), w * n)]
    a, z = best_stretch(scores)
    chosen = {i // 2 for i in range(a, z) if i % 2}
    roots = {page.blocks[i][3] for i in chosen if own[i] > 0} - {0}
    return [text for i, (text, _, _, root) in enumerate(page.blocks) if own[i] > 0 and (i in chosen or root in roots)]


def main_text(source: str | None, weights: Weights) -> str:
    return "\n".join(main_blocks(Page(source), weights))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(html, content) -> (key, good, total): a block's words are content if the labelled text holds the block."""
    total: dict[str, list[int]] = {}
    for b in batches:
        for source, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            known = " ".join((content or "").split())
            for text, keys, tags, _ in Page(source).blocks:
                n = text.count(" ") + 1
                good = n if text in known else 0
                for k in (*keys, ""):
                    have = total.setdefault(k, [0, 0])
                    have[0] += good
                    have[1] += n
                have = total.setdefault("<in" if good else "<out", [0, 0])
                have[0] += tags
                have[1] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array([v[i] for v in total.values()], pa.int64()) for i in (0, 1))], names=["key", "good", "total"])


def learn(labelled: DataFrame, keys: int = 2_000) -> Weights:
    """Weights from a bounded sample of (html, content); the ``keys`` surroundings with most words count, others keep the assumption."""
    rows = labelled.select("html", "content").mapInArrow(_learn, "key string, good bigint, total bigint").groupBy("key").agg(F.sum("good").alias("good"), F.sum("total").alias("total"))
    got = {r["key"]: (r["good"], r["total"]) for r in rows.orderBy(F.desc("total"), "key").limit(keys).collect()}
    inside, outside = got.pop("<in", None), got.pop("<out", None)
    rate = lambda x: 0 if not x or not x[1] else x[0] / x[1]
    return Weights(got, (rate(inside), rate(outside)))


def labelled_pages(pages: DataFrame, docs: DataFrame, rows: int = SAMPLE_PAGES, ident: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(html, content) of about ``rows`` pages whose url ends in the number of a document, with that document's text.

    The pages are chosen by a hash of their id; the sample is bounded, so it is sent to the documents.
    """
    number = F.regexp_extract(F.col(url), r"^[^?#]*/([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#]|$)", 1)
    own = pages.filter(F.col(ident).isNotNull() & F.col(source).isNotNull()).select(F.col(ident).alias("id"), F.when(number != "", number).cast("bigint").alias("doc"), F.col(source).alias("html"))
    total = own.count()
    span = 1 << 30
    cut = span if total <= rows else int(span * rows / total)
    own = own.filter(F.col("doc").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(span)) < cut))
    return docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("content")).join(F.broadcast(own.select("doc", "html")), "doc").select("html", "content")


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, weights: Weights, source: Column | str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` instead of any columns of these names; all rows stay.

    Character references are decoded, white space inside a block becomes one blank, blocks are joined by one line break. A null or
    empty page, and one without any content, gives the empty string. Repeated rows are read one by one; no rows give no rows.
    """

    @F.arrow_udf(RESULT)
    def run(t: pa.Array) -> pa.Array:
        texts = [main_text(x.as_py(), weights) for x in t]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=RESULT.names)

    own = F.col(source) if isinstance(source, str) else source
    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    return pages.select(*rest, run(own).alias("__r")).select(*rest, "__r.*")
