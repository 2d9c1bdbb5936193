"""What answers and gold read of the corpus."""

import pytest

from latchkey.operators import search as S
from latchkey.plans.base import Base
from latchkey.sources import scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture
def own(monkeypatch):
    monkeypatch.setattr(scratch, "_KEPT", {})
    monkeypatch.setattr(scratch, "BUILT", {})


def test_answers_read_the_claims_of_their_packs_alone(spark, own):
    b = Base(spark, SF)
    assert b.answers.count() > 0
    assert "claims" not in scratch.BUILT
    packed = {r.chunk_id for r in b.packs.select("chunk_id").collect()}
    key = lambda d: sorted((r.chunk_id, r.topic, r.unit, r.value) for r in d.collect() if r.chunk_id in packed)
    assert key(b.pack_claims) == key(b.claims)
    assert {r.chunk_id for r in b.pack_claims.collect()} <= packed


def test_passages_are_found_wherever_they_begin_and_however_short(spark, own, tmp_path):
    texts = ["xOne  two three\nfour five six.", "one two three four five sixty", "one two three", "pre One\ttwo thre", "", None, "one two", "two three four five"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    passages = {1: "one two three four five six", 2: "one  two thre", 3: "One", 4: "one two three four", 5: "ten nine eight seven six five four"}
    asked = spark.createDataFrame([(q, "x", 1, p) for q, p in passages.items()], "query_id long, query string, user_id long, passage string")
    b = Base(spark, str(tmp_path), asked, "short/")
    fold = lambda t: " ".join((t or "").split()).lower()
    want = {(q, d) for q, p in passages.items() for d, t in enumerate(texts) if t is not None and fold(p) in fold(t)}
    assert {(r.query_id, r.doc_id) for r in b.holders.collect()} == want and b.holders.count() == len(want)


def test_terms_are_counted_once_for_both_weights(spark, own):
    b = Base(spark, SF)
    plain = {r.term: (r.df, round(r.idf, 9)) for r in S.bm25_idf(b.postings).collect()}
    assert {r.term: (r.df, round(r.idf, 9)) for r in b.idf.collect()} == plain
    assert "term-idf" in scratch.BUILT
