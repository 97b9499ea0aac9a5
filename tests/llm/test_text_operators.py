"""Quality rules, licenses, toxicity, pages and urls against plain rules on small tables."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliograde.llm import hosts, html, licenses, mixing, quality, queries, toxicity
from tests.check_queries import compare

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)


EDGES = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id " * 40), (4, "same words here " * 3000), (5, " \t\n\x0b\x0c\r"), (6, "x\u00a0y z\x85")]


# --- quality -----------------------------------------------------------------------------


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    got = quality.with_quality(base).select("text", "quality_stats.*").toPandas()
    for r in got.itertuples():
        want = plain_stats(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_quality_tells_junk_from_prose(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.with_quality(base, "q").select("doc_id", "q.kept").join(labels, "doc_id").toPandas()
    good, junk = got[got.quality == 1], got[got.quality == 0]
    assert good.kept.mean() > 0.97 and junk.kept.mean() < 0.25


def test_quality_edges(spark):
    rows = docs(spark, EDGES).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    got = quality.with_quality(rows)
    assert got.columns == [*rows.columns, "quality_stats"] and got.count() == len(EDGES)
    stats = {r.doc_id: r.quality_stats for r in got.collect()}
    assert stats[1].n_words == 0 and stats[1].base_failed and not stats[1].kept and stats[6].n_words == 2
    none = quality.with_quality(rows.limit(0))
    assert none.count() == 0
    assert quality.with_quality(rows.withColumn("lang", F.lit(None).cast("string"))).filter("quality_stats.char_distance IS NOT NULL").isEmpty()


def test_distance_is_jensen_shannon():
    p, q = np.array([[1.0, 1, 0]]), np.array([[1.0, 0, 1]])
    assert quality._distance(p, q)[0] == pytest.approx(np.sqrt(0.5))
    assert quality._distance(p, p * 7)[0] == 0 and np.isnan(quality._distance(p * 0, q)[0])


# --- licenses ----------------------------------------------------------------------------


def plain_places(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, lab) for p, lab in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_places(spark):
    extra = ["Under THE (MIT) license under the mit license, apache license, Version 2.0 é", "under the mit licensé", "cc-by-nc cc by\nnc", "ÀPACHE apache license version 2x"]
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id bigint, text string"))
    text = {r.doc_id: r.text for r in base.collect()}
    for r in licenses.license_scan(base).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_places(text[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_filters_lose_no_match():
    """The filtered join finds exactly the templates that plain counting finds."""
    rng = np.random.default_rng(5)
    vocab = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    for threshold in (0.5, 0.8, 0.9, 1.0):
        index = licenses.Index(licenses.TEMPLATES, {w: int(rng.integers(0, 1000)) for w in vocab}, threshold)
        for _ in range(400):
            _, t = licenses.TEMPLATES[rng.integers(len(licenses.TEMPLATES))]
            words = {w for w in t.split() if rng.random() < 0.93} | set(rng.choice(vocab, 4)) | {f"x{k}" for k in range(rng.integers(0, 9))}
            got = sorted(index.match({w.encode() for w in words}, len(words)))
            want = []
            for label, text in licenses.TEMPLATES:
                own = set(text.split())
                if len(own & words) >= threshold * len(own) - 1e-9:
                    want.append((label, len(own & words) / len(own)))
            assert got == sorted(want)


def test_license_edges(spark):
    rows = docs(spark, [*EDGES, (9, "This work is licensed under the GNU General Public License, version 3.")]).withColumn("labels", F.lit("clash"))
    got = {r.doc_id: r for r in licenses.license_scan(rows).collect()}
    assert got[9].labels == "gpl-3" and got[9].base_labels == "" and got[1].n_words == 0 and got[1].labels == "" and got[1].first_word is None
    assert licenses.license_scan(rows).count() == len(EDGES) + 1 and licenses.license_scan(rows.limit(0)).count() == 0


# --- toxicity ----------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    base = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.toxic_scores(base, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert got[got.toxic == 1].predicted.mean() > 0.85 and got[got.toxic == 0].predicted.mean() < 0.02
    assert got.score.between(0, 1).all()


def test_identity_terms_do_not_move_scores(spark):
    """A term that goes with toxic labels in the sample gets next to no say once its counterfactuals count."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        words = [f"w{rng.integers(50)}" for _ in range(12)] + (["rotten"] if toxic else [])
        if rng.random() < (0.8 if toxic else 0.1):
            words.append("muslim")
        rows.append((" ".join(words), int(toxic)))
    sample = spark.createDataFrame(rows, "text string, toxic int")
    fair, free = toxicity.fit(sample, penalty=20.0), toxicity.fit(sample, penalty=0.0)
    gap = lambda m: abs(m.weights.get("muslim", 0.0) - m.weights.get("jewish", 0.0))
    assert gap(fair) < 0.25 * gap(free) and fair.score("you are rotten") > 0.5 > fair.score("a muslim and a jewish neighbour")


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxic_scores(docs(spark, EDGES).withColumn("score", F.lit("clash")), labels)
    rows = got.collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [True]
    assert toxicity.toxic_scores(docs(spark, []), labels).count() == 0


def test_swapping_is_within_a_group():
    assert toxicity.swapped({"a", "women"}) == {"a", "men"} and toxicity.swapped({"a"}) is None


# --- pages -------------------------------------------------------------------------------

ODD = """<html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class="page">
<header><a href=/>Home</a></header><div class="cookie-notice"><p>We use cookies, a lot of them, everywhere.</p></div>
<nav><ul><li>Menu one<li>Menu two</ul></nav>
<article><h1>Head &amp; line</h1><p>First   words of the text<br>go on&nbsp;here, long enough.
<div class="ad">Buy things now</div><p>Second paragraph &lt;b&gt; with <b>bold</b> and <a href="x>y">a link</a>.</p>
<aside>Related: many other things to read</aside><form><input value="x"><button>Send</button></form><pre>last   bit</pre></article>
<section id="comments"><p>I say this was nice to read and long as well.</p></section><footer>&copy; me</footer></body></html>"""


def test_odd_page():
    got = html.main_text(ODD, html.Weights({}))
    assert got == "Head & line\nFirst words of the text go on here, long enough.\nSecond paragraph <b> with bold and a link.\nlast bit"


def test_page_without_article():
    body = "".join(f"<p>{'word ' * 30}{k}</p>" for k in range(5))
    got = html.main_text(f"<body><div class=menu>a b c</div><div class=content>{body}</div><div class=footer>{'x ' * 50}</div></body>", html.Weights({}))
    assert got == "\n".join(("word " * 30) + str(k) for k in range(5))


def test_best_stretch_is_the_best():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = list(rng.integers(-4, 5, size=12).astype(float))
        best = max((sum(s[i:j]) for i in range(12) for j in range(i + 1, 13)), default=0)
        a, z = html.best_stretch(s)
        assert sum(s[a:z]) == max(0, best)


def test_pages_equal_their_articles(spark):
    pages, base = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    weights = html.learn(html.labelled_pages(pages, base))
    assert weights.content[""][1] > 0 and weights.share("footer") < 0.1 < weights.share("article")
    import html as H

    for r in html.extract(pages, weights, "html").join(pages.select("page_id", F.col("html").alias("h")), "page_id").collect():
        own = re.search(r"<article>(.*?)(</article>|$)", r.h, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub("<br>|</?b>|</?i>", " " if "br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", own)]
        blocks = [" ".join(H.unescape(re.sub("</?[bi]>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", own)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_page_edges(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<article><p>a</article"), (4, "u", "just text &am"), (5, "u", "<!-- never closed <p>x</p>"), (6, "u", "<script>var x"), (7, "u", "<p>" + "w " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = html.extract(pages, html.Weights({}))
    texts = [(r.page_id, r.text) for r in got.collect()]
    assert len(texts) == len(rows) and (1, "") in texts and (5, "") in texts and (6, "") in texts and (4, "just text &am") in texts and (3, "a") in texts
    assert html.extract(pages.limit(0), html.Weights({})).count() == 0


# --- urls --------------------------------------------------------------------------------

URLS = [
    ("http://WWW.Example.ORG/en/12?x#y", "www.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/fr/1", "example.org", "/fr/1", "org/", "allow"),
    ("https://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"),
    ("x://a.com/de/", "a.com", "/de/", "com/de/", "block"),
    ("x://a.com", "a.com", "", None, "allow"),
    ("x://com/fr/é", "com", "/fr/é", "com/fr/", "allow"),
    ("x://a.com?/fr/", "a.com", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a\nb://Ä.com/de/x\ny?z", "Ä.com", "/de/x\ny", "com/de/", "block"),
    ("://x//y", "x", "//y", None, "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id bigint, url string").withColumn("host", F.lit("clash"))
    nothing = spark.createDataFrame([], "host string, bad int")
    got = {r.page_id: r for r in hosts.judge_urls(pages, nothing).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), URLS[i]
    assert hosts.judge_urls(pages.limit(0), nothing).count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [("spam.bad.net", 1)] * 40 + [("two.bad.net", 1)] * 30 + [("new.bad.net", 1)] + [("www.good.net", 0)] * 60 + [("new.good.net", 1)] + [("a.fine.com", 0)] * 50 + [("a.fine.com", None), ("", 1)]
    rep = {r.host: r for r in hosts.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert rep["spam.bad.net"].pages == 40 and rep["a.fine.com"].pages == 50 and "" not in rep
    assert rep["new.bad.net"].rate > 0.6 > 0.5 > rep["new.good.net"].rate  # one bad page each
    assert all(r.lower <= r.rate for r in rep.values()) and rep["spam.bad.net"].lower > rep["new.bad.net"].lower
    pages = spark.createDataFrame([(1, "http://spam.bad.net/x"), (2, "http://www.good.net/x")], "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in hosts.judge_urls(pages, spark.createDataFrame(rows, "host string, bad int")).collect()} == {1: "block", 2: "allow"}


# --- mixing ------------------------------------------------------------------------------


def test_mixing_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert compare(queries.op9_mixing(spark, SF).toPandas(), con.execute(queries.ORACLES["op9_mixing"]).df()) == "ok"


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 500), ("b", "z", 500)], "d string, s string, tokens bigint")
    got = {r.s: r.budget for r in mixing.budgets(leaves, ["d", "s"], [{}, {}], F.lit(200.0)).collect()}
    assert got == {"x": 10, "y": 90, "z": 100}  # y takes what x cannot; b keeps its half
    got = {r.s: r.budget for r in mixing.budgets(leaves, ["d", "s"], [{"a": 1.0, "b": 0.0}, {}], F.lit(700.0)).collect()}
    assert got == {"x": 10, "y": 500, "z": 0}
    got = {r.s: r.budget for r in mixing.budgets(leaves, ["d", "s"], [{}, {}], F.lit(1e9), epochs=2).collect()}
    assert got == {"x": 20, "y": 1000, "z": 1000}


def test_mixing_edges(spark):
    rows = [(1, "a", 5), (1, "a", 5), (None, "a", 5), (2, None, 7), (3, "b", 0), (4, "b", 0)]
    base = spark.createDataFrame(rows, "doc_id bigint, g string, n_tokens bigint").withColumn("tokens", F.lit("clash")).withColumn("budget", F.lit("clash"))
    got = mixing.mix(base, ["g"], [{}], F.lit(1.0) * F.col("all_tokens"))
    assert got.columns == [*base.columns, "copies"] and got.count() == len(rows)
    assert {r.copies for r in got.filter("n_tokens > 0").collect()} == {1}
    assert mixing.mix(base.limit(0), ["g"], [{}], F.lit(5.0)).count() == 0
    half = mixing.mix(base, ["g"], [{}], F.lit(0.5) * F.col("all_tokens")).toPandas()
    assert (half.n_tokens * half.copies).sum() <= 11 and half[half.doc_id == 1].copies.nunique() == 1


def test_nothing_but_results(spark):
    """All queries of the subpackage are there, one for each operator."""
    assert {re.match(r"op(\d+)_", q)[1] for q in queries.QUERIES if q != "pipeline"} == {str(k) for k in range(1, 14)}
    assert pd.Series(queries.QUERIES).index.is_unique
