"""Scope by lists of users and documents: right whatever the sizes of lists, and spread evenly with few sets of roles."""

import pytest
from pyspark.sql import functions as F

from latchkey.operators import governance as G


@pytest.mark.parametrize(("user_block", "doc_block"), [(1, 1), (7, 10), (1_024, 4_096)])
def test_scope_is_what_roles_say(spark, user_block, doc_block):
    u = [(i, r) for i in range(40) for r in ((" HR ", "it"), ("it",), ("none",), (None,))[i % 4]]
    d = [(i, r) for i in range(90) for r in (("hr", "it"), ("hr",), ("IT",), ("x",), (None,))[i % 5]]
    clean = lambda r: r and r.strip().lower()
    want = sorted({(a, b) for a, r in u for b, s in d if r and clean(r) == clean(s)})
    got = G.scope(spark.createDataFrame(u, "user_id int, role string"), spark.createDataFrame(d, "doc_id int, role string"), user_block, doc_block)
    assert sorted(map(tuple, got.collect())) == want


def test_one_set_of_roles_is_spread(spark):
    """All users and documents have one set: no part holds more than a few times its share of the pairs."""
    one = lambda key, n: spark.range(n).select(F.col("id").alias(key), F.lit("all").alias("role"))
    pairs = G.scope(one("user_id", 600), one("doc_id", 1_000), 50, 100)
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 600_000 and max(sizes) < 60_000
