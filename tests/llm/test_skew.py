"""Groups that hold a third of all rows: results stay whole, and nothing gathers a group in one place."""

import random

from pyspark.sql import functions as F

from sparkfolio.llm import exact_dedup, mixing, simhash, url_filter


def test_a_third_of_all_rows_is_one_text(spark):
    rng = random.Random(1)
    docs = [(i, "the same text again and again" if i % 3 == 0 else " ".join(f"w{rng.randrange(900)}" for _ in range(30))) for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    exact = exact_dedup.exact_duplicates(frame)
    assert exact.filter("group_size = 1000").count() == 1000 and exact.filter("kept").count() == 2001
    near = simhash.near_duplicates(frame)
    assert near.count() == 3000 and near.filter("component_id = 0").count() >= 1000


def test_a_third_of_all_rows_is_one_host(spark):
    pages = spark.range(3000).select(
        F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://hot.com/x").otherwise(F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".org/"))).alias("url"), F.expr("timestamp'2024-01-05'").alias("fetched_at")
    )
    entries = spark.sql("SELECT 'l' AS list_name, 'block' AS kind, 'd:hot.com' AS pattern, 'add' AS action, timestamp'2024-01-01' AS effective")
    found = url_filter.filter_urls(pages, entries)
    assert found.count() == 3000 and found.filter("blocked").count() == 1000


def test_a_third_of_all_rows_is_one_source(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 400).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("source"), F.lit("en").alias("lang")
    )
    mixed = mixing.mix(docs, budget_share=0.5)
    share = {r["_source"]: r["p"] for r in mixed.groupBy("_source").agg(F.first("_probability").alias("p")).collect()}
    assert share["hot"] < min(p for s, p in share.items() if s != "hot")
    assert abs(mixed.filter("_selected").count() / 3000 - 0.5) < 0.05
