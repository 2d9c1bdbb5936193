"""Approximate nearest neighbours: candidates by buckets inside blocks, against plain numpy."""

import numpy as np
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from latchkey.operators import embed as D
from latchkey.operators import search as S


def _vectors(spark, n=600, dim=6):
    x = np.random.RandomState(8).randn(n, dim).astype(np.float32)
    return x.astype(float), spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def test_candidates_share_a_bucket(spark):
    """The same candidates as random projections give, with exact scores; what has too few is searched for exactly."""
    x, v = _vectors(spark)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(unit)], "vec_id long, e array<double>").select("vec_id", array_to_vector("e").alias("v"))
    h = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.06, numHashTables=2, seed=7).fit(rows).transform(rows)
    h = np.array([r.h for r in h.orderBy("vec_id").select(F.transform("h", lambda y: vector_to_array(y)[0]).alias("h")).collect()])
    k, q = 60, list(range(0, 600, 10))
    got = {}
    for r in D.ann_topk(v.where("vec_id % 10 = 0"), v, k, bucket=0.06, tables=2).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    short = 0
    for i in q:
        score = np.round(unit @ unit[i], 6)
        near = [j for j in range(600) if j != i and (h[j] == h[i]).any()]
        short += len(near) < k
        near = near if len(near) >= k else [j for j in range(600) if j != i]
        assert got[i] == sorted(near, key=lambda j: (-score[j], j))[:k]
    assert 0 < short < len(q)


def test_vectors_are_shuffled_once_as_they_are(spark):
    """No join by bucket, whose pairs carry both vectors; floats aren't made doubles before the shuffle."""
    _, v = _vectors(spark, 100)
    q = v.where("vec_id % 10 = 0")
    keyed = lambda d: d.withColumn("keys", F.array(F.lit(1)))
    plan = S.cosine_topk(keyed(q), keyed(v), 5, keys=True)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "as double" not in plan[plan.index("FlatMapCoGroupsInArrow") :]
    joins = []
    original = S.DataFrame.join
    try:
        S.DataFrame.join = lambda self, *a, **b: joins.append(a) or original(self, *a, **b)
        D.ann_topk(q, v, 5).collect()
    finally:
        S.DataFrame.join = original
    assert all(a[1:] in (("vec_id", "left_anti"), ("query_id", "left_semi")) for a in joins)


def test_many_queries_meet_a_block_in_slices(spark):
    """More queries than a slice holds, each block's scores are those of one product."""
    x, v = _vectors(spark, 700)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in S.cosine_topk(v, v, 3, block=300).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for i in range(700):
        score = np.round(unit @ unit[i], 6)
        score[i] = -2
        assert got[i] == sorted(range(700), key=lambda j: (-score[j], j))[:3]
