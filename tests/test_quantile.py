"""Exact quantiles by counts of ranges, against numpy."""

import random

import numpy as np
import pytest

from latchkey.operators import evaluate as V


@pytest.mark.parametrize(("q", "bins", "rounds"), [(0.95, 1024, 2), (0.5, 2, 3), (0.0, 3, 1), (1.0, 4, 2), (1 / 3, 5, 0)])
def test_same_as_numpy(spark, q, bins, rounds):
    r = random.Random(3)
    groups = {
        "hot": [r.gauss(0, 1e6) for _ in range(3_000)], "ties": [float(r.randrange(3)) for _ in range(500)], "one": [7.5], "equal": [2.0] * 40, None: [1.0, -4.0, 3.0],
        "wide": [-1.7e308, 1.7e308, 0.0, 1.0], "skewed": [10.0 ** r.randrange(12) for _ in range(300)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("none", None), ("one", None)]
    got = {x.g: x.value for x in V.exact_quantile(spark.createDataFrame(rows, "g string, x double"), "g", "x", q, bins, rounds).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        xs, at = sorted(xs), q * (len(xs) - 1)
        lo, hi = xs[int(np.floor(at))], xs[int(np.ceil(at))]
        assert got[g] == pytest.approx(lo * (1 - (at - np.floor(at))) + hi * (at - np.floor(at)), rel=1e-12)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "rank string, n long")
    assert V.exact_quantile(empty, "rank", "n", 0.5).count() == 0
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "lo string, before long")
    assert [tuple(x) for x in V.exact_quantile(rows, "lo", "before", 0.5).collect()] == [("a", 1.5)]


def test_no_group_is_held_whole(spark):
    rows = spark.range(1_000).selectExpr("id % 2 as g", "id as x")
    plan = V.exact_quantile(rows, "g", "x", 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan
