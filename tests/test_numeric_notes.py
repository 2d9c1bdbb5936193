"""Answers whose pack states a quantity twice read as the SQL has them; the small tables have no such pack."""

from pyspark.sql import functions as F

from latchkey.plans.base import Base

SF = "/root/testdata/sf0.001"


def test_values_in_answers_read_as_in_sql(spark):
    b = Base(spark, SF)
    pack = b.packs.limit(1).cache()
    one = pack.head()
    packs = pack.unionByName(pack.withColumns({"chunk_id": F.lit("other::c000"), "doc_id": F.lit(-5).cast("long"), "position": F.lit(2)}))
    claims = spark.createDataFrame([(one.chunk_id, one.doc_id, "allowance", "percent", 8.0), ("other::c000", -5, "allowance", "percent", 9.5)], "chunk_id string, doc_id long, topic string, unit string, value double")
    b.__dict__ |= {"packs": packs, "claims": claims, "selected": pack.select("query_id", "chunk_id", F.lit(0).alias("chunk_rank"), F.lit(0).alias("place"), F.lit("It is so.").alias("sentence"))}
    assert "- different values for allowance in percent: 8.0 and 9.5\n" in b.drafts.head().answer + "\n"
