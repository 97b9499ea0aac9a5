import corpus_pipeline as cp
from heliograde import session
from heliograde.llm import copies


def test_near_copies_leave_only_small_tables(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[: 50 + i % 3])) for i in range(30)] + [(99, "other")], "doc_id long, text string")
    before = len(session._WRITTEN)
    out = copies.near_copies(docs)
    left = [spark.read.parquet(p).columns for p in session._WRITTEN[before:]]
    assert not any("grams" in c or "bands" in c for c in left)
    assert {r.component for r in out.filter("doc_id < 99").collect()} != {r.component for r in out.filter("doc_id = 99").collect()}


def test_mixing_moves_no_text_but_once(spark):
    docs = spark.createDataFrame([(None if i % 7 == 0 else i % 40, f"t{i} " * (i % 5), None if i % 11 == 0 else "en", f"src{i % 3}", i) for i in range(120)], cp.COLUMNS)
    from pyspark.sql import functions as F

    from heliograde.llm import mixing

    counted = docs.select(*cp.COLUMNS, mixing.token_count("text").alias("n_tokens"))
    want = mixing.mix(counted, cp.TREE, cp.WEIGHTS, F.lit(cp.PART) * F.col("all_tokens")).filter("copies > 0").select(cp.COLUMNS)
    out = cp.mixing_stage(spark, docs, "")
    key = lambda rows: sorted(map(str, rows))
    assert key(out.collect()) == key(want.collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text#") <= 4, plan
