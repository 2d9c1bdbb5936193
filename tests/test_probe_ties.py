"""The probe rounds scores that are half-way as written, as those of six digits often are, like the SQL does."""

import duckdb
from pyspark.sql import functions as F

from latchkey.plans.base import Base

SF = "/root/testdata/sf0.001"


def test_half_way_scores_round_as_in_sql(spark):
    b = Base(spark, SF)
    ties = [(n, 1, f"{n}::c000", n, (10 * n + 5) / 1e5) for n in range(10_000)]
    dense = spark.createDataFrame(ties, "query_id long, user_id long, chunk_id string, doc_id long, score double").withColumn("rank", F.lit(1))
    b.__dict__ |= {"queries": dense.select("query_id", "user_id"), "dense": dense, "sparse": dense.withColumn("normalised", F.lit(1.0))}
    got = {r.query_id: r.dense_confidence for r in b.probe.collect()}
    assert got == dict(duckdb.sql("select i, round((10 * i + 5) / 1e5, 4) from range(10000) t(i)").fetchall())
