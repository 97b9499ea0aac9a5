"""Documents to training tokens in five stages; each reads what the one before it wrote as Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograde.llm import copies, mixing, pieces, quality, substrings
from heliograde.session import durable, scratch, scratch_folder, shuffles_removed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MODEL = "piece_bpe_32k.model"
REMEMBERED = 150_000  # words that a task of the last stage keeps: Python workers live on beside the stages of the next run
TREE = ["source", "lang"]
# The hot source is held to a third of the tokens where the others can give the rest; other sources share alike.
WEIGHTS: list[dict[str, float]] = [{"src0": 10.0, "*": 1.0}, {}]
PART = 0.9  # of all tokens that the mix takes


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.with_quality(docs, "__q").filter("__q.kept").select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each class of near copies (five-word shingles, similarity 0.8 or more); of equal rows, one.

    Rows of one id with texts of different classes all stay. Rows without an id all stay.
    """
    named = docs.filter("doc_id IS NOT NULL").select(COLUMNS)
    first = copies.near_copies(named.select("doc_id", "text")).groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("f")).select("f.*")
    rows = named.withColumn("digest", copies.digest("text")).join(first, ["doc_id", "digest"])
    others = ["lang", "source", "n_chars"]
    kept = rows.groupBy("doc_id", "digest").agg(F.min("text").alias("text"), F.min(F.struct(*others)).alias("o")).select("doc_id", "text", "o.*").select(COLUMNS)
    return kept.unionByName(docs.filter("doc_id IS NULL").select(COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of an earlier one; a document of which nothing is left goes. Texts of one id keep their own words apart."""
    done = substrings.remove_repeats(docs.select("doc_id", "text")).filter("n_removed > 0")
    cut = done.select("doc_id", F.col("words_sha256").alias("__words"), F.col("kept").alias("__kept"), F.lit(True).alias("__cut")).dropDuplicates(["doc_id", "__words"])
    out = docs.withColumn("__words", words_digest("text")).join(cut, ["doc_id", "__words"], "left")
    text = F.when(F.col("__cut"), F.col("__kept")).otherwise(F.col("text"))
    out = out.withColumn("text", text).withColumn("n_chars", F.when(F.col("__cut"), F.char_length("__kept").cast("bigint")).otherwise(F.col("n_chars")))
    return out.filter("__cut IS NULL OR __kept <> ''").select(COLUMNS)


def words_digest(text: str) -> Column:
    """Digest of the words of a text, joined by one blank."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")), 256)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the token budgets of their source and language take, each once. Budgets are dealt out on ids and counts, and rows of one id,
    source and language are taken together, so texts meet the result in one join."""
    counted = durable(docs.select("doc_id", *TREE, mixing.token_count("text").alias("n_tokens")))
    mixed = mixing.mix(counted, TREE, WEIGHTS, F.lit(PART) * F.col("all_tokens")).filter("copies > 0")
    keys = ["doc_id", *TREE]
    taken = mixed.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return docs.select(COLUMNS).join(taken, same, "left_semi")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_sha256) of every document."""
    out = pieces.encode_decode(docs.select("doc_id", "text"), MODEL, remembered=REMEMBERED)
    return out.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

ORACLE_SQL = None  # fingerprints, recompression and tokens are beyond SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again. What a stage stored and shuffled goes when it ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark), shuffles_removed(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
