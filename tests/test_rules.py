"""Rules on small literal tables with results worked out by hand."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from latchkey.functions import text as T
from latchkey.operators import embed as D
from latchkey.operators import evaluate as V
from latchkey.operators import evidence as E
from latchkey.operators import governance as G
from latchkey.operators import ingest as I
from latchkey.operators import routing as R
from latchkey.operators import search as S
from latchkey.sources import files as S1


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).head().x


def ask(spark, query, history=None):
    return R.text_features(spark.createDataFrame([(1, query, history)], "query_id int, query string, history string")).head()


def test_tokenize_keeps_identifiers(spark):
    assert one(spark, T.tokenize, "Fix ERR-5041 on v1.2_b, now!") == ["fix", "err-5041", "on", "v1.2_b", "now"]


def test_normalise_and_markup(spark):
    assert one(spark, T.normalise, " a \r\nb\r\n\n\n\nc d ") == "a\nb\n\nc d"
    assert one(spark, T.html_to_text, "<style>x{}</style><p>a &amp; b</p><script>1<2</script><b>c</b>") == "a & b\n c"
    assert one(spark, T.front_matter_strip, "---\ntitle: x\n---\nbody") == "body" and one(spark, T.front_matter_strip, "--- no end") == "--- no end"


def test_sentences(spark):
    assert one(spark, T.sentences, "First sentence here. Second one follows!\n- third item of list\n\nshort. 4 more words here") == ["First sentence here.", "Second one follows!", "third item of list", "4 more words here"]
    assert one(spark, T.sentences, "A good first sentence. Another good sentence.") == ["A good first sentence.", "Another good sentence."]


def test_sections_and_chunks(spark):
    text = "# Leave policy\nTwenty days.\n2.1 Carry over\nFive days.\nNOTICE PERIODS\n\n# Empty\n"
    d = spark.createDataFrame([("d1", text), ("d2", "no heading at all"), ("d3", "# only a heading")], "doc_id string, text string")
    got = {(r.chunk_id, r.heading, r.text) for r in I.chunks(d).collect()}
    assert ("d1::c000", "Leave policy", "Leave policy\n\nTwenty days.") in got and ("d1::c001", "2.1 Carry over", "2.1 Carry over\n\nFive days.") in got
    assert ("d2::c000", None, "no heading at all") in got and len([g for g in got if g[0].startswith("d1")]) == 2
    with pytest.raises(ValueError):
        I.chunks(d, 100, 100)


def test_paragraph_packing_carries_overlap(spark):
    paragraphs = ["a" * 500, "b" * 300, "c" * 400]
    pieces = one(spark, lambda c: I.packed(c), "\n\n".join(paragraphs))
    assert pieces[0] == "a" * 500 + "\n\n" + "b" * 300
    assert pieces[1] == "b" * 150 + "\n\n" + "c" * 400
    assert [len(w) for w in one(spark, lambda c: I.windows(c), "x" * 2000)] == [900, 900, 500]


def test_decompose(spark):
    d = lambda q: one(spark, R.decompose, q)
    assert d("what is the difference between north site and south site?")[1:] == ["north site", "south site"]
    assert d("compare parking rules versus garage rules") == ["compare parking rules versus garage rules", "compare parking rules", "parking rules garage rules"]
    assert d("list open tasks; name the owner") == ["list open tasks; name the owner", "list open tasks", "name the owner"]
    assert d("how has the leave policy changed")[1:] == ["current has leave policy", "previous has leave policy"]
    assert d("plain question") == ["plain question"] and d("  ") == []


def test_query_features(spark):
    f = ask(spark, "How do I fix fault ABC-1234 on the billing host?")
    assert f.identifiers_found == ["ABC-1234"] and f.identifier_signal == 0.65 and f.intent == "procedural"
    assert ask(spark, "what is the latest travel allowance now").temporal_signal == 1.0
    c = ask(spark, "compare parking rules between north site and south site")
    assert c.comparison_signal == 1.0 and c.intent == "comparison" and c.likely_hop_count == 2
    m = ask(spark, "Which team owns the gateway and who approves changes across every region?")
    assert m.multihop_signal == 1.0 and m.hop_signal == pytest.approx(0.34 + 0.18 * 0.5 + 0.20 * 2 / 18)
    assert ask(spark, "what about it", "travel allowance").followup_signal == pytest.approx(0.75)
    assert ask(spark, "what about it").followup_signal == 0.0
    assert ask(spark, "salary policy").doc_type_hints == ["policy", "finance"]


def test_follow_up_is_resolved(spark):
    q = spark.createDataFrame([("what about  it", "travel allowance for interns"), ("travel rules", "x"), ("it", None)], "q string, h string")
    assert [r.x for r in q.select(R.normalise_query(F.col("q"), F.col("h")).alias("x")).collect()] == ["travel allowance for interns what about it", "travel rules", "it"]


def test_rrf(spark):
    r = spark.createDataFrame([(1, 1, "a", 1, 1, 1.0), (1, 1, "b", 1, 2, 1.0), (1, 1, "b", 1, 1, 1.0), (1, 1, "c", 1, 2, 0.75)], "query_id int, user_id int, chunk_id string, doc_id int, rank int, weight double")
    got = [(x.chunk_id, x.score) for x in S.rrf(r).orderBy("rank").collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("c", round(0.75 / 62, 9))]
    with pytest.raises(ValueError):
        S.rrf(r, k=-1)


def test_scope_and_assertion(spark):
    u = spark.createDataFrame([(1, " HR "), (2, "it")], "user_id int, role string")
    d = spark.createDataFrame([(10, "hr"), (10, "it"), (11, "hr")], "doc_id int, role string")
    s = G.scope(u, d)
    assert sorted(map(tuple, s.collect())) == [(1, 10), (1, 11), (2, 10)]
    bad = spark.createDataFrame([(2, 11)], "user_id int, doc_id int")
    assert G.assert_allowed(s, s, "x").count() == 3
    with pytest.raises(PySparkException):
        G.assert_allowed(bad, s, "x").collect()


def test_claims_and_conflicts(spark):
    c = spark.createDataFrame([("a::c000", "a", "Notice is 20 working days. Lunch is 3 hours."), ("b::c000", "b", "The notice period: notice takes 30 days!"), ("c::c000", "c", "Allowance grows 5.50 % a year\nleave of 10 days")], "chunk_id string, doc_id string, text string")
    got = {(r.doc_id, r.topic, r.unit, r.value) for r in E.claims(c).collect()}
    assert got == {("a", "notice", "day", 20.0), ("b", "notice", "day", 30.0), ("c", "allowance", "percent", 5.5), ("c", "leave", "day", 10.0)}
    e = spark.createDataFrame([(1, "F", "a::c000"), (1, "F", "b::c000"), (1, "G", "c::c000")], "query_id int, policy_family string, chunk_id string")
    n = E.numeric_conflicts(e, E.claims(c)).collect()
    assert [(r.policy_family, r.topic, r.values_stated, r.chunk_ids) for r in n] == [("F", "notice", "20.0,30.0", "a::c000,b::c000")]


def test_citations(spark):
    a = spark.createDataFrame([(1, "Known [d1::c000]. Invented [d9::c007] . Again [d1::c000].")], "query_id int, answer string")
    p = spark.createDataFrame([(1, "d1::c000"), (1, "d1::c001")], "query_id int, chunk_id string")
    r = E.verify_citations(a, p).head()
    assert (r.text, r.citations, r.stripped) == ("Known [d1::c000]. Invented. Again [d1::c000].", "d1::c000", "d9::c007")


def test_metrics(spark):
    items = spark.createDataFrame([(1,), (2,)], "query_id int")
    gold = spark.createDataFrame([(1, 7), (1, 8)], "query_id int, doc_id int")
    ranked = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (1, 8, 9)], "query_id int, doc_id int, rank int")
    r = {x.query_id: x for x in V.retrieval_metrics(items, ranked, gold, 5).collect()}
    assert (r[1].recall, r[1].mrr, r[1].ndcg) == (0.5, 0.5, round((1 / 1.584962500721156) / (1 + 1 / 1.584962500721156), 6)) and r[2].recall is None


def test_bootstrap_covers_the_mean(spark):
    rows = spark.range(200).select("id", (F.col("id") % 2).cast("double").alias("value"))
    i = V.interval(V.bootstrap(rows, 300)).head()
    assert 0.38 < i.low < 0.5 < i.high < 0.62
    p = V.paired(rows, rows.withColumn("value", F.col("value") - 0.3), 200).head()
    assert p.difference == pytest.approx(0.3) and p.p == 0.0 and p.stars == "***"


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "a.md").write_text("café", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "c.txt").write_text(" ")
    (tmp_path / "d.exe").write_text("x")
    got = {r.path[-4:]: (r.text, r.error) for r in S1.corpus_scan(spark, str(tmp_path)).collect()}
    assert got["a.md"[-4:]] == ("café", None) and got[".txt"[-4:]][1] in (None, "empty file") and got[".exe"][1] == "unsupported type: exe"
    assert S1.run_id({"a": 1, "b": 2}) == S1.run_id({"b": 2, "a": 1})


def test_latent_semantics_of_all_terms(spark):
    """Term vectors and texts against a plain singular value decomposition; every term has a vector."""
    random = np.random.RandomState(3)
    a = np.where(random.rand(40, 25) < 0.3, random.rand(40, 25), 0) + np.outer(random.rand(40), random.rand(25))
    rows = [(f"t{j}", f"c{i}", float(a[i, j])) for i in range(40) for j in range(25) if a[i, j]]
    vectors = spark.createDataFrame(rows, "term string, chunk_id string, weight double")
    got = {r.term: np.array(r.vector) for r in D.lsa_fit(vectors, 6, extra=19).collect()}
    _, s, v = np.linalg.svd(a, full_matrices=False)
    want = (v[:6] * s[:6, None]).T
    found = np.stack([got[f"t{j}"] for j in range(25)])
    assert len(got) == 25 and np.allclose(found @ found.T, want @ want.T, atol=1e-6)
    texts = {r.chunk_id: np.array(r.vector) for r in D.lsa_fold_in(vectors, D.lsa_fit(vectors, 6, extra=19)).collect()}
    plain = a @ want
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    both = np.stack([texts[f"c{i}"] for i in range(40)])
    assert np.allclose(both @ both.T, plain @ plain.T, atol=1e-6)
    unknown = spark.createDataFrame([("zz", "new", 1.0), ("t1", "old", 1.0)], vectors.schema)
    folded = {r.chunk_id: r.vector for r in D.lsa_fold_in(unknown, D.lsa_fit(vectors, 6)).collect()}
    assert not any(folded["new"]) and any(folded["old"])
    with pytest.raises(ValueError):
        D.lsa_fit(vectors.limit(0), 6)


def test_nearest_vectors_in_blocks(spark):
    """Small blocks give what one product gives; approximate search never returns too few."""
    random = np.random.RandomState(4)
    x = random.randn(300, 8)
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    q = v.where("vec_id % 50 = 0")
    got = {(r.query_id, r["rank"]): r.vec_id for r in S.cosine_topk(q, v, 5, block=37, asked=2).collect()}
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for i in range(0, 300, 50):
        score = np.round(unit @ unit[i], 6)
        score[i] = -2
        assert [got[i, n] for n in range(1, 6)] == sorted(range(300), key=lambda j: (-score[j], j))[:5]
    assert S.cosine_topk(q.limit(0), v, 5).count() == 0
    near = D.ann_topk(q, v, 299).groupBy("query_id").count().collect()
    assert len(near) == 6 and all(r["count"] == 299 for r in near)


def test_evidence_gate(spark):
    today = F.lit("2026-08-19").cast("date")
    evidence = spark.createDataFrame(
        [(1, 7, 10, 0.5, "policy", 4, 1, None), (2, 7, 11, 0.05, "wiki", 1, 1, None), (3, 7, 12, 0.5, "policy", 2, 1, None), (4, 7, 13, 0.5, "wiki", 2, 1, 99), (5, 7, 99, 0.9, "wiki", 5, 1, None)],
        "query_id int, user_id int, doc_id int, score double, doc_type string, authority_score int, position int, superseded_by int",
    ).withColumn("effective_date", F.lit("2024-01-01").cast("date"))
    f = spark.createDataFrame([(1, "lookup", 9, 0.1, False), (2, "lookup", 9, 0.1, False), (3, "lookup", 9, 0.1, False), (4, "comparison", 9, 0.1, True), (5, "lookup", 9, 0.1, False), (6, "lookup", 9, 0.1, False)], "query_id int, intent string, query_length_tokens int, semantic_ambiguity double, freshness_required boolean")
    scope = spark.createDataFrame([(7, d) for d in (10, 11, 12, 13)], "user_id int, doc_id int")
    got = {r.query_id: r for r in E.sufficiency(f.select("query_id"), evidence, f, today, scope).collect()}
    assert [got[i].failure_reason for i in range(1, 7)] == [None, "low_relevance", "low_authority", "insufficient_diversity", "acl_violation", "no_authorised_evidence"]
    assert got[4].checks.freshness is False and got[4].checks.diversity is False and got[1].checks.asDict() == {"acl": True, "evidence": True, "relevance": True, "count": True, "diversity": True, "authority": True, "clarity": True, "freshness": True}


def test_requests_and_numeric_disclosure(spark):
    r = spark.createDataFrame([("a", " ", 1), ("b", "x", 2), ("c", "x", 1), ("d", None, 1)], "request_id string, asked string, user_id int")
    users = spark.createDataFrame([(1,)], "user_id int")
    assert {x.request_id: x.error for x in E.checked_requests(r, users).collect()} == {"a": "empty query", "b": "unknown user", "c": None, "d": "empty query"}
    selected = spark.createDataFrame([(1, "a::c000", 0, 0, "Notice is 20 days.")], "query_id int, chunk_id string, chunk_rank int, place int, sentence string")
    none = spark.createDataFrame([], "query_id int, versions string")
    notes = spark.createDataFrame([], "query_id int, notes string")
    numeric = spark.createDataFrame([(1, "notice", "day", "20.0,30.5")], "query_id int, topic string, unit string, values_stated string")
    assert E.answer_text(selected, none, notes, numeric).head().answer == "- Notice is 20 days. [a::c000]\n\n**Conflicting sources**\n- different values for notice in day: 20 and 30.5"


def test_stratified_split_of_hash_order(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 7 == 0, "a").otherwise("b").alias("c")).unionByName(spark.createDataFrame([(5000, None), (5001, None)], "id long, c string"))
    got = V.stratified_split(rows, "c").groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("train").cast("int")).alias("t")).collect()
    assert all(r.t == int(0.8 * r.n) for r in got) and len(got) == 3
