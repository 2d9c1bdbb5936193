"""Search by blocks of postings and numbers of role sets, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from latchkey.operators import governance as G
from latchkey.operators import search as S
from latchkey.plans.base import Base

SF = "/root/testdata/sf0.001"
BY = ("query_id", "user_id")


@pytest.fixture(scope="module")
def corpus(spark):
    """2,000 chunks that all have ``stop`` and a few of 400 rarer words, some of them equal; three users."""
    r = random.Random(5)
    parts = [("stop", c, c // 2, 0.01 + 0.01 * r.random()) for c in range(2_000)]
    parts += [(f"w{w}", c, c // 2, round(1 + r.random(), 1)) for c in range(2_000) for w in r.sample(range(400), 4)]
    parts += [("less", c, c // 2, -0.5) for c in range(0, 2_000, 3)]
    # Documents that end in 9 have no roles.
    doc_set = {d: d % 3 for d in range(1_000) if d % 10 != 9}
    reach = {(0, 0), (0, 1), (1, 2)}
    users = {1: 0, 2: 1, 3: 2}
    queries = [(q, 1 + q % 3, ["stop", *{f"w{r.randrange(400)}" for _ in range(q % 4)}, *(["less"] if q % 5 == 0 else [])]) for q in range(40)]
    p = spark.createDataFrame([(t, f"{c:04d}", d, x) for t, c, d, x in parts], "term string, chunk_id string, doc_id long, part double")
    blocks = S.impact_blocks(p, spark.createDataFrame(list(doc_set.items()), "doc_id long, doc_set long"), spark.createDataFrame([(2_000,)], "n long"), 32).cache()
    terms = spark.createDataFrame([(q, u, users[u], t, 1.0 + (len(t) + q) % 2) for q, u, ts in queries for t in ts], "query_id int, user_id int, user_set long, term string, w double")
    return parts, doc_set, reach, users, terms.cache(), blocks


@pytest.mark.parametrize(("k", "positive"), [(1, True), (10, True), (10, False), (5_000, True)])
def test_block_search_is_exact(spark, corpus, k, positive):
    parts, doc_set, reach, users, terms, blocks = corpus
    got = S.block_topk(terms, blocks, S.term_tops(blocks), spark.createDataFrame(list(reach), "user_set long, doc_set long"), k, BY, positive)
    want, by_term = {}, {}
    for t, c, d, x in parts:
        by_term.setdefault(t, []).append((c, d, x))
    for t in terms.collect():
        for c, d, x in by_term[t.term]:
            if (t.user_set, doc_set.get(d)) in reach:
                s = want.setdefault(t.query_id, {})
                s[c] = s.get(c, 0.0) + t.w * x
    rows = {}
    for q, s in want.items():
        best = sorted(((-round(x, 6), f"{c:04d}") for c, x in s.items() if not positive or round(x, 6) > 0))[:k]
        rows |= {(q, c): (-x, i + 1) for i, (x, c) in enumerate(best)}
    found = {(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in got.collect()}
    assert found.keys() == rows.keys() and all(found[x] == pytest.approx(rows[x], abs=2e-6) for x in rows)


def test_most_blocks_of_a_frequent_term_stay_closed(spark, corpus):
    *_, reach, _, terms, blocks = corpus
    terms = terms.join(terms.groupBy("query_id").count().where("count > 2"), "query_id").drop("count").where("user_id < 3 and term <> 'less'")
    wanted = S.wanted_blocks(terms, blocks, S.term_tops(blocks), spark.createDataFrame(list(reach), "user_set long, doc_set long"), 3, BY)
    opened = wanted.join(terms.where("term = 'stop'"), list(BY)).count()
    closed = terms.where("term = 'stop'").select("query_id").distinct().count() * blocks.where("term = 'stop'").count()
    assert 0 < opened < 0.4 * closed


def test_empty_search(spark, corpus):
    *_, terms, blocks = corpus
    none = spark.createDataFrame([], "user_set long, doc_set long")
    assert S.block_topk(terms, blocks, S.term_tops(blocks), none, 3, BY).count() == 0
    assert S.block_topk(terms.limit(0), blocks, S.term_tops(blocks), none, 3, BY).count() == 0


def test_sets_of_roles_say_what_scope_says(spark):
    u = spark.createDataFrame([(1, " HR "), (1, "it"), (2, "it"), (3, "it"), (4, "none"), (5, None)], "user_id int, role string")
    d = spark.createDataFrame([(10, "hr"), (10, "it"), (11, "hr"), (12, "IT"), (13, "x"), (14, None)], "doc_id int, role string")
    us, ds = G.sets_of_roles(u, "user_id"), G.sets_of_roles(d, "doc_id")
    un, dn = G.numbered_sets(us, "user_set").cache(), G.numbered_sets(ds, "doc_set").cache()
    users, docs = us.join(un, "roles").select("user_id", "user_set"), ds.join(dn, "roles").select("doc_id", "doc_set")
    pairs = u.select("user_id").crossJoin(d.select("doc_id")).withColumn("more", F.lit(1))
    want = sorted(map(tuple, G.scope(u, d).collect()))
    assert sorted(map(tuple, G.scope_among(pairs, users, docs, G.reach(un, dn)).collect())) == want
    assert sorted({(r.user_id, r.doc_id) for r in G.readable(pairs, users, docs, G.reach(un, dn)).collect()}) == want


def test_no_search_makes_pairs_of_users_and_documents(spark):
    b = Base(spark, SF)
    plan = S.block_topk(b.terms(b.queries).withColumn("w", F.lit(1.0)), b.sparse_blocks, b.sparse_tops, b.reach, 10, BY)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text and "user_set" in text
    joins = [line for line in text.splitlines() if "Join" in line]
    assert not [line for line in joins if "doc_id#" in line] and not [line for line in joins if "Cross" in line]
