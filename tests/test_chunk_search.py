"""Search by chunks that are dealt out once, against plain Python, and its plan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from latchkey.operators import search as S
from latchkey.plans import queries as Q
from latchkey.plans.base import Base

SF = "/root/testdata/sf0.001"
BY = ("query_id", "user_id", "sub_no")


@pytest.mark.parametrize(("k", "share"), [(1, 4), (5, 4), (10, 64), (5_000, 2)])
def test_best_chunks_are_exact(spark, k, share):
    r = random.Random(3)
    entries = {f"c{c:03d}": {"stop": (0.01, 0.02), **{f"w{w}": (round(r.uniform(-1, 2), 2), round(r.random(), 2)) for w in r.sample(range(60), 5)}} for c in range(400)}
    doc_set = {c: i % 3 for i, c in enumerate(entries)}
    reach = {(0, 0), (0, 1), (1, 2)}
    asked = [(q, q % 3, 0, q % 3, t, 1 + q % 2, 0.5) for q in range(12) for t in ("stop", f"w{q}", f"w{q + 20}")]
    chunks = spark.createDataFrame([(c, i, doc_set[c], [(t, *x) for t, x in e.items()]) for i, (c, e) in enumerate(entries.items())], "chunk_id string, doc_id long, doc_set long, entries array<struct<term:string,sparse:double,dense:double>>")
    terms = spark.createDataFrame(asked, "query_id int, user_id int, sub_no int, user_set long, term string, qtf long, w double")
    got = S.chunk_topk(terms, chunks, 400, spark.createDataFrame(list(reach), "user_set long, doc_set long"), k, BY, share)
    found = {(x.query_id, x.kind, x["rank"]): (x.chunk_id, round(x.score, 5)) for x in got.collect()}
    want = {}
    for q in {a[0] for a in asked}:
        for kind in (0, 1):
            scores = {}
            for a in (a for a in asked if a[0] == q):
                for c, e in entries.items():
                    if a[4] in e and (a[3], doc_set[c]) in reach:
                        scores[c] = scores.get(c, 0.0) + a[5 + kind] * e[a[4]][kind]
            best = sorted((-round(s, 6), c) for c, s in scores.items() if kind or round(s, 6) > 0)[:k]
            want |= {(q, ("sparse", "dense")[kind], i + 1): (c, round(-s, 5)) for i, (s, c) in enumerate(best)}
    assert found == want


def test_postings_are_counted_inside_their_row(spark):
    chunks = spark.createDataFrame([("a", 1, "x y x y-z x"), ("b", 2, "?!"), ("c", 3, "one")], "chunk_id string, doc_id long, text string")
    p = S.postings(chunks)
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.chunk_id, r.term, r.tf, r.dl) for r in p.collect()) == [("a", "x", 3, 5), ("a", "y", 1, 5), ("a", "y-z", 1, 5), ("b", "__empty__", 1, 1), ("c", "one", 1, 1)]


@pytest.mark.parametrize("often", [1, 3, 100_000])
def test_lengths_of_vectors_by_either_join(spark, often):
    b = Base(spark, SF)
    got = {r.chunk_id: r.norm for r in S.chunk_lengths(b.postings, b.term_idf, often).collect()}
    idf = {r.term: r.idf for r in b.term_idf.collect()}
    want = {}
    for r in b.postings.collect():
        want[r.chunk_id] = want.get(r.chunk_id, 0.0) + ((1 + math.log(r.tf)) * idf[r.term]) ** 2
    assert got == pytest.approx({c: math.sqrt(x) for c, x in want.items()})


def test_no_pair_of_asker_and_chunk_is_shuffled(spark):
    """Where terms are few, one exchange by chunk_id alone comes before the join by term."""
    plan = Q.QUERIES["acl_resolve"](spark, SF)._jdf.queryExecution().toString()
    assert "hashpartitioning(chunk_id" in plan and not [line for line in plan.splitlines() if "Exchange" in line and "user_id" in line and "chunk_id" in line and "gone" not in line and "Broadcast" not in line and "hashpartitioning(user_id" in line and "ordinal" in line]


def test_blocks_of_postings_are_not_built_for_searches(spark):
    from latchkey.sources.scratch import BUILT

    BUILT.pop("bm25-blocks", None)
    assert Base(spark, SF, tag="fresh/").probe.where(F.col("sparse_confidence") > 0).count() > 0
    assert "bm25-blocks" not in BUILT and "tfidf-blocks" not in BUILT


def test_candidates_without_scope_keep_the_best_readable(spark):
    """Scores of all chunks, whoever may read them, down to a bound that the best readable ones reach; pairs stay where they are."""
    r = random.Random(5)
    entries = {f"c{c:03d}": {"stop": 0.02, **{f"w{w}": round(r.random(), 2) for w in r.sample(range(40), 5)}} for c in range(600)}
    chunks = spark.createDataFrame([(c, i, i % 4, [(t, 1.0, x) for t, x in e.items()]) for i, (c, e) in enumerate(entries.items())], "chunk_id string, doc_id long, doc_set long, entries array<struct<term:string,sparse:double,dense:double>>")
    terms = spark.createDataFrame([(q, q % 2, q % 2, t, 1, 0.5) for q in range(8) for t in ("stop", f"w{q}", f"w{q + 20}")], "query_id int, user_id int, user_set long, term string, qtf long, w double")
    reach = spark.createDataFrame([(0, 0), (1, 1), (1, 2)], "user_set long, doc_set long")
    got = S.chunk_candidates(terms, chunks, 600, reach, 3, share=4)
    plan = got._jdf.queryExecution().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "query_id" in line and "chunk_id" in line]
    found = {(x.query_id, x.chunk_id): x.score for x in got.collect()}
    scores = {(q, c): round(sum(0.5 * e.get(t, 0.0) for t in ("stop", f"w{q}", f"w{q + 20}")), 6) for q in range(8) for c, e in entries.items()}
    assert found == pytest.approx({k: scores[k] for k in found}) and len(found) < len(scores) / 2
    for q in range(8):
        mine = sorted((-scores[q, c], c) for i, c in enumerate(entries) if (i % 4 == 0 if q % 2 == 0 else i % 4 in (1, 2)))[:3]
        assert all((q, c) in found for _, c in mine)


def test_acl_filter_builds_no_tfidf_vectors(spark, monkeypatch):
    from latchkey.sources import scratch

    monkeypatch.setattr(scratch, "_KEPT", {})
    monkeypatch.setattr(scratch, "BUILT", {})
    assert Q.QUERIES["acl_filter"](spark, SF).count() > 0
    assert "tfidf" not in scratch.BUILT


def test_pairs_are_scored_as_products_of_matrices(spark):
    """Entries aren't exploded to meet terms; null bounds, weights of zero, several parts and blocks."""
    r = random.Random(9)
    rows = [(f"c{c:04d}", c, c % 3, [(f"w{w}", r.uniform(-1, 2), r.choice((0.0, 0.5, 1.5))) for w in r.sample(range(30), 4)]) for c in range(1_300)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, doc_set long, entries array<struct<term:string,sparse:double,dense:double>>")
    asked = [(q, 0, [(f"w{q % 30}", 2, 0.5), (f"w{(q + 7) % 31}", 1, 0.0)], [q % 3, 2], None if q % 2 else 0.5, 0.4) for q in range(9)]
    asks = spark.createDataFrame(asked, "query_id int, user_id int, terms array<struct<term:string,qtf:long,w:double>>, doc_sets array<long>, least_s double, least_d double")
    got = S.pair_scores(chunks, 1_300, asks, ("query_id", "user_id"), each=200, block=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan and "entries" not in "".join(x for x in plan.splitlines() if "Generate explode" in x and "explode(entries" in x)
    want = {}
    for q, _, terms, sets, ls, ld in asked:
        for c, _, d_set, entries in rows:
            hit = [(f, w, s, d) for t, f, w in terms for u, s, d in entries if t == u]
            s, d = sum(f * s for f, _, s, _ in hit), sum(w * d for _, w, _, d in hit)
            if hit and d_set in sets and (s > 0 and (ls is None or s >= ls - S.SLACK) or d >= ld - S.SLACK):
                want[q, c] = (s, d)
    found = {(x.query_id, x.chunk_id): (x.s, x.d) for x in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], abs=1e-6) for k in want)
