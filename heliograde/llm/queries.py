"""Registered queries of the numbered operators, and their SQL twins."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograde.llm import alignment, bytepairs, forest, hosts, html, licenses, mixing, pieces, quality, resampling, simhash, substrings, toxicity
from heliograde.session import durable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = quality.with_quality(_table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return docs.select("doc_id", "quality_stats.*")


@query()
def op2_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = _table(spark, sf, "pages")
    weights = html.learn(html.labelled_pages(pages, _table(spark, sf, "documents")))
    return html.extract(pages.select("page_id", "url", "html"), weights).select("page_id", "url", "text", "n_chars")


@query()
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxic_scores(_table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "labels"))


@query()
def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf, "documents").select("doc_id", "text"))


@query()
def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op6_prefix_forest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").select("vec_id", "embedding")
    return forest.search(vectors, F.col("vec_id") % 100 == 0)


@query()
def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


MODEL = "piece_bpe_32k.model"


@query()
def op8_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    out = pieces.encode_decode(_table(spark, sf, "documents").select("doc_id", "text"), MODEL)
    return pieces.digests(out)


TREE = ["domain", "lang", "source"]
WEIGHTS = [{"web": 0.5, "books": 0.3, "forum": 0.2}, {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}, {}]
EPOCHS, PART = 3, 0.8
DOMAIN = "CASE WHEN source = 'src0' THEN 'web' WHEN right(source, 1) IN ('1', '3', '5', '7', '9') THEN 'forum' ELSE 'books' END"


@query(
    rf"""
WITH d AS (SELECT doc_id, {DOMAIN} AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
leaf AS (SELECT domain, lang, source, sum(n)::DOUBLE AS tokens, {EPOCHS} * sum(n)::DOUBLE AS cap FROM d GROUP BY ALL),
root AS (SELECT least({PART} * sum(tokens), sum(cap)) AS budget FROM leaf),
c1 AS (SELECT domain, sum(cap) AS c, CASE domain WHEN 'web' THEN 0.5 WHEN 'books' THEN 0.3 ELSE 0.2 END::DOUBLE AS w, any_value(budget) AS b FROM leaf, root GROUP BY domain),
f1 AS (SELECT *, (b - coalesce(sum(c) OVER (ORDER BY c / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY c / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM c1),
b1 AS (SELECT domain, CASE WHEN w * s >= c THEN c ELSE w * min_by(s, c / w) FILTER (w * s < c) OVER () END AS b FROM f1),
c2 AS (SELECT domain, lang, sum(cap) AS c, CASE lang WHEN 'en' THEN 0.6 WHEN 'de' THEN 0.15 WHEN 'fr' THEN 0.15 WHEN 'es' THEN 0.1 ELSE 0 END::DOUBLE AS w, any_value(b) AS b FROM leaf JOIN b1 USING (domain) GROUP BY ALL),
f2 AS (SELECT *, (b - coalesce(sum(c) OVER (PARTITION BY domain ORDER BY c / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY domain ORDER BY c / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM c2),
b2 AS (SELECT domain, lang, CASE WHEN w * s >= c THEN c ELSE w * min_by(s, c / w) FILTER (w * s < c) OVER (PARTITION BY domain) END AS b FROM f2),
c3 AS (SELECT domain, lang, source, tokens, cap AS c, 1.0::DOUBLE AS w, b FROM leaf JOIN b2 USING (domain, lang)),
f3 AS (SELECT *, (b - coalesce(sum(c) OVER (PARTITION BY domain, lang ORDER BY c / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY domain, lang ORDER BY c / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM c3),
b3 AS (SELECT domain, lang, source, tokens::BIGINT AS tokens, floor(CASE WHEN w * s >= c THEN c ELSE w * min_by(s, c / w) FILTER (w * s < c) OVER (PARTITION BY domain, lang) END)::BIGINT AS budget FROM f3),
e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM b3),
o AS (SELECT d.doc_id, d.domain, d.lang, d.source, d.n, e.whole, e.budget, e.budget - e.whole * e.tokens AS rest, sum(d.n) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('0:' || e.whole || ':' || d.doc_id) RANGE UNBOUNDED PRECEDING) AS upto FROM d JOIN e USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n AS n_tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM o
"""
)
def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", F.expr(DOMAIN).alias("domain"), "lang", "source", mixing.token_count("text").alias("n_tokens"))
    return mixing.mix(docs, TREE, WEIGHTS, F.lit(PART) * F.col("all_tokens"), EPOCHS)


@query()
def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = _table(spark, sf, "pages").select("page_id", "url")
    outcomes = hosts.page_outcomes(pages, _table(spark, sf, "labels"))
    return hosts.judge_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


@query()
def op11_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return bytepairs.digests(bytepairs.encode_decode(docs, "byte_bpe_multi_50k.tiktoken"))


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents), b AS (SELECT {WORDS} AS w FROM benchmark),
runs AS (SELECT r, 0 AS side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d
  UNION ALL SELECT NULL, 1, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) FROM b),
tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)),
bytes AS (SELECT f, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS y FROM x),
crc AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], y), lambda c, z: xor(c >> 8, t[(xor(c, z) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM runs JOIN crc USING (f) GROUP BY bucket),
tot AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM n),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM n, tot),
per AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS gain FROM runs JOIN crc USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
sc AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(gain::DOUBLE / n), 0)::BIGINT AS weight,
  ('0x' || substr(sha256('7:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN per USING (r)),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM sc),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id, weight DESC, n_features DESC) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS able FROM e)
SELECT doc_id, n_words::BIGINT AS n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS "rank" FROM k
"""
)
def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    docs, target = _table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "benchmark").select("text")
    return resampling.resample(docs, target)


@query()
def op13_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    blocks = alignment.aligned_blocks(docs, "byte_bpe_50k.json", MODEL, write=lambda groups: hashlib.sha256(groups).hexdigest() if groups else "")
    out = alignment.with_link_counts(durable(blocks)).withColumnRenamed("groups", "groups_sha256")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared")


@query()
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
