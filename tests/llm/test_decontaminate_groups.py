"""Groups of very many short texts."""

from pyspark.sql import functions as F

from latchkey.llm import decontaminate

ITEM = "which of these rivers crosses the old town before it meets the northern sea"


def test_many_short_texts_hide_no_leak(spark):
    short = spark.range(0, 2_097_155, 1, 1).select("id", F.lit("ab").alias("text"))
    leak = spark.range(2_097_155, 2_097_156, 1, 1).select("id", F.lit(f"so: {ITEM}, they asked").alias("text"))
    docs = short.union(leak).coalesce(1).withColumnRenamed("id", "doc_id")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.edit_distance) for r in decontaminate.find_items(docs, items).collect()] == [(2_097_155, 1, 0)]
