"""The relations that queries share, each derived once for a directory of tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latchkey.functions import policy as P
from latchkey.functions import text as T
from latchkey.operators import evidence as E
from latchkey.operators import governance as G
from latchkey.operators import ingest as I
from latchkey.operators import routing as R
from latchkey.operators import search as S
from latchkey.sources import governed as S0
from latchkey.sources.scratch import kept

def folded(text: str):
    """White space as single blanks, lower case."""
    return F.lower(T.squeeze(F.col(text)))


def scaled_round(value, digits: int):
    """Rounded as SQL engines round binary numbers: what the value is times a power of ten, to whole numbers.
    Values that have been rounded before are often half-way as written (0.00145) but not as scaled."""
    return F.round(value * 10**digits) / 10**digits


ANSWERING = ("R1", "R2", "R3", "R4")


class Base:
    """All stages from documents to answers as relations of one directory. A stage that others build on
    is written to the shared folder once per application."""

    #: Stages that don't depend on who asks what.
    CORPUS = frozenset(
        ("docs", "chunks", "postings", "size", "bm25-idf", "term-idf", "tfidf", "claims", "doc-sets", "docs-of-sets", "user-sets", "users-of-sets", "reach", "lengths", "bm25-blocks", "bm25-tops")
    )

    def __init__(self, spark: SparkSession, sf_dir: str, asked: DataFrame | None = None, tag: str = "") -> None:
        """``asked`` replaces the labelled queries of the directory; its stages are kept under ``tag``."""
        self.spark, self.dir, self.asked, self.tag = spark, sf_dir, asked, tag
        self.today = F.lit(S0.REFERENCE_DATE).cast("date")

    def table(self, name: str) -> DataFrame:
        return S0.table(self.spark, self.dir, name)

    def _kept(self, name: str, build) -> DataFrame:
        of = f"{self.dir}/{{documents,benchmark,customer}}.parquet"
        return kept(self.spark, f"{self.dir}/{name if name in self.CORPUS else self.tag + name}", build, (of,))

    @cached_property
    def docs(self) -> DataFrame:
        return self._kept("docs", lambda: S0.documents(self.spark, self.dir))

    @cached_property
    def doc_roles(self) -> DataFrame:
        return S0.doc_roles(self.docs)

    @cached_property
    def users(self) -> DataFrame:
        return S0.users(self.spark, self.dir)

    @cached_property
    def user_roles(self) -> DataFrame:
        return S0.user_roles(self.spark, self.dir)

    @cached_property
    def queries(self) -> DataFrame:
        return S0.queries(self.spark, self.dir) if self.asked is None else self.asked

    @cached_property
    def doc_set_names(self) -> DataFrame:
        """(roles, doc_set)."""
        return self._kept("doc-sets", lambda: G.numbered_sets(G.sets_of_roles(self.doc_roles, "doc_id"), "doc_set"))

    @cached_property
    def doc_sets(self) -> DataFrame:
        """(doc_id, doc_set): the number of each document's set of roles."""
        return self._kept("docs-of-sets", lambda: G.sets_of_roles(self.doc_roles, "doc_id").join(self.doc_set_names, "roles").select("doc_id", "doc_set"))

    @cached_property
    def user_sets(self) -> DataFrame:
        """(user_id, user_set): of all users."""
        sets = G.sets_of_roles(self.user_roles, "user_id")
        return self._kept("users-of-sets", lambda: sets.join(self.user_set_names, "roles").select("user_id", "user_set"))

    @cached_property
    def user_set_names(self) -> DataFrame:
        """(roles, user_set)."""
        return self._kept("user-sets", lambda: G.numbered_sets(G.sets_of_roles(self.user_roles, "user_id"), "user_set"))

    @cached_property
    def reach(self) -> DataFrame:
        """(user_set, doc_set)."""
        return self._kept("reach", lambda: G.reach(self.user_set_names, self.doc_set_names))

    def scope_among(self, pairs: DataFrame) -> DataFrame:
        """(user_id, doc_id): what the users of ``pairs`` may read of these."""
        return G.scope_among(pairs, self.user_sets, self.doc_sets, self.reach)

    def readable(self, candidates: DataFrame) -> DataFrame:
        """Rows of ``candidates`` (user_id, doc_id, ...) that the user may read."""
        return G.readable(candidates, self.user_sets, self.doc_sets, self.reach)

    def terms(self, queries: DataFrame, by: tuple[str, ...] = ("query_id", "user_id")) -> DataFrame:
        """(*by, term, qtf, user_set); a user without roles reads nothing, so their queries have no terms."""
        return S.query_terms(queries, by).join(self.user_sets, "user_id")

    @cached_property
    def chunks(self) -> DataFrame:
        return self._kept("chunks", lambda: I.chunks(S0.texts(self.spark, self.dir)))

    @cached_property
    def per_doc(self) -> DataFrame:
        return self.chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))

    @cached_property
    def summary(self) -> DataFrame:
        return G.scope_summary(self.users, self.user_roles, self.docs, self.doc_roles, self.per_doc)

    @cached_property
    def postings(self) -> DataFrame:
        return self._kept("postings", lambda: S.postings(self.chunks))

    @cached_property
    def size(self) -> DataFrame:
        return self._kept("size", lambda: S.corpus_size(self.postings))

    @cached_property
    def idf(self) -> DataFrame:
        return self._kept("bm25-idf", lambda: S.bm25_idf(self.postings, self.term_idf, self.size))

    @cached_property
    def term_idf(self) -> DataFrame:
        return self._kept("term-idf", lambda: S.term_idf(self.postings, self.size))

    @cached_property
    def vectors(self) -> DataFrame:
        return self._kept("tfidf", lambda: S.tfidf(self.postings))

    @cached_property
    def sparse_blocks(self) -> DataFrame:
        return self._kept("bm25-blocks", lambda: S.impact_blocks(S.bm25_parts(self.postings, self.idf, self.size), self.doc_sets, self.size))

    @cached_property
    def sparse_tops(self) -> DataFrame:
        return self._kept("bm25-tops", lambda: S.term_tops(self.sparse_blocks))

    @cached_property
    def lengths(self) -> DataFrame:
        """(chunk_id, doc_id, dl, norm)."""
        return self._kept("lengths", lambda: S.chunk_lengths(self.postings, self.term_idf))

    @cached_property
    def asked_chunks(self) -> DataFrame:
        """(chunk_id, doc_id, doc_set, entries): readable chunks with the terms of queries and sub-queries that they have."""

        def build() -> DataFrame:
            terms = self.queries.select("query").unionByName(self.subqueries.select("query")).select(F.explode(T.tokenize(F.col("query"))).alias("term"))
            return S.asked_chunks(self.postings, terms, self.lengths, self.doc_sets, self.idf, self.term_idf, self.size)

        return self._kept("asked-chunks", build)

    @cached_property
    def dealt_chunks(self) -> DataFrame:
        return S.dealt(self.asked_chunks, self.size.head().n)

    @cached_property
    def rankings(self) -> DataFrame:
        """(query_id, user_id, sub_no, kind, chunk_id, doc_id, score, rank): the best of all sub-queries by both
        kinds of search. Sub-query 0 has the query's own words, so it stands for the query."""

        def build() -> DataFrame:
            by = ("query_id", "user_id", "sub_no")
            t = S.query_weights(self.terms(self.subqueries, by), self.term_idf, by)
            return S.chunk_topk(t, self.asked_chunks, self.size.head().n, self.reach, max(P.CANDIDATE_K, P.SUBQUERY_K), by)

        return self._kept("rankings", build)

    def _ranked(self, kind: str) -> DataFrame:
        return self.rankings.where((F.col("kind") == kind) & (F.col("sub_no") == 0) & (F.col("rank") <= P.CANDIDATE_K)).drop("kind", "sub_no")

    @cached_property
    def sparse(self) -> DataFrame:
        best = Window.partitionBy("query_id", "user_id")
        return self._ranked("sparse").withColumn("normalised", F.round(F.col("score") / F.max("score").over(best), 6))

    @cached_property
    def dense(self) -> DataFrame:
        return self._ranked("dense")

    @cached_property
    def probe(self) -> DataFrame:
        """(query_id, user_id, sparse_confidence, dense_confidence, agreement, conflict_likelihood)."""
        k = F.col("rank") <= P.PROBE_K
        s, d = self.sparse.where(k), self.dense.where(k)
        by = ("query_id", "user_id")
        first, second = F.max(F.when(F.col("rank") == 1, F.col("score"))), F.max(F.when(F.col("rank") == 2, F.col("score")))
        sp = s.groupBy(*by).agg(first.alias("b1"), second.alias("b2"), F.collect_set("chunk_id").alias("sparse_ids"))
        dp = d.groupBy(*by).agg(F.max("score").alias("cos"), F.collect_set("chunk_id").alias("dense_ids"))
        union = s.select(*by, "doc_id").unionByName(d.select(*by, "doc_id")).distinct().join(self.docs.select("doc_id", "policy_family"), "doc_id")
        conflict = union.groupBy(*by, "policy_family").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.max(F.when(F.col("n") > 1, 1.0).otherwise(0.0)).alias("conflict"))
        q = self.queries.select(*by).join(sp, list(by), "left").join(dp, list(by), "left").join(conflict, list(by), "left")
        none = F.array().cast("array<string>")
        q = q.withColumns({"sparse_ids": F.coalesce("sparse_ids", none), "dense_ids": F.coalesce("dense_ids", none)})
        margin = F.when(F.col("b2").isNotNull(), 1 - F.col("b2") / F.col("b1")).otherwise(1.0)
        confidence = F.least(F.lit(1.0), F.col("b1") / (F.col("b1") + 6.0) * (0.72 + 0.28 * margin))
        either = F.size(F.array_union("sparse_ids", "dense_ids"))
        return q.select(
            *by, F.round(F.coalesce(confidence, F.lit(0.0)), 4).alias("sparse_confidence"), scaled_round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("cos", F.lit(0.0)))), 4).alias("dense_confidence"),
            F.round(F.when(either > 0, F.size(F.array_intersect("sparse_ids", "dense_ids")) / either).otherwise(0.0), 4).alias("agreement"), F.coalesce("conflict", F.lit(0.0)).alias("conflict_likelihood"),
        )

    @cached_property
    def features(self) -> DataFrame:
        def build() -> DataFrame:
            q = R.text_features(self.queries)
            asked = self.queries.select("user_id").distinct()
            s = self.summary.join(asked, "user_id", "left_semi").select("user_id", "allowed_chunks", "restricted_fraction")
            return R.features(q.join(self.probe.drop("user_id"), "query_id").join(s, "user_id"))

        return self._kept("features", build)

    @cached_property
    def utilities(self) -> DataFrame:
        return self._kept("utilities", lambda: R.utilities(self.features))

    @cached_property
    def decisions(self) -> DataFrame:
        return self._kept("decisions", lambda: R.decisions(self.utilities))

    @cached_property
    def subqueries(self) -> DataFrame:
        """(query_id, user_id, sub_no, query)."""
        return self.queries.select("query_id", "user_id", F.posexplode(R.decompose(F.col("query"))).alias("sub_no", "query"))

    @cached_property
    def iterative(self) -> DataFrame:
        """Rankings of all sub-queries: (query_id, user_id, sub_no, kind, chunk_id, doc_id, rank, weight)."""
        return self.rankings.where(F.col("rank") <= P.SUBQUERY_K).drop("score").withColumn("weight", R.iteration_weight(F.col("sub_no")))

    @cached_property
    def candidates(self) -> DataFrame:
        """(query_id, user_id, route, chunk_id, doc_id, score, rank): the pools of all answering routes."""

        def build() -> DataFrame:
            s, d = self.sparse, self.dense
            cols = ("query_id", "user_id", "route", "chunk_id", "doc_id", "score", "rank")
            r1 = s.withColumns({"route": F.lit("R1"), "score": F.col("normalised")}).select(*cols)
            r2 = d.withColumns({"route": F.lit("R2"), "score": F.greatest(F.lit(0.0), F.col("score"))}).select(*cols)
            both = s.select("query_id", "user_id", "chunk_id", "doc_id", "rank").unionByName(d.select("query_id", "user_id", "chunk_id", "doc_id", "rank")).withColumn("weight", F.lit(1.0))
            r3 = S.rrf(both).where(F.col("rank") <= P.CANDIDATE_K).withColumn("route", F.lit("R3")).select(*cols)
            r4 = S.rrf(self.iterative).where(F.col("rank") <= P.CANDIDATE_K).withColumn("route", F.lit("R4")).select(*cols)
            return r1.unionByName(r2).unionByName(r3).unionByName(r4)

        return self._kept("candidates", build)

    @cached_property
    def reranked(self) -> DataFrame:
        """(query_id, user_id, route, chunk_id, doc_id, overlap, ..., score, rank)."""
        return self._kept("reranked", lambda: S.rerank(self.candidates, self.queries, self.chunks, self.term_idf, self.size, extra=("route",)))

    # From here on a query and a route together are what is asked: ask_id is "query:route".

    @cached_property
    def asks(self) -> DataFrame:
        routes = self.spark.createDataFrame([(r,) for r in P.ROUTES], "route string")
        q = self.queries.crossJoin(F.broadcast(routes))
        return q.withColumn("item_id", F.col("query_id")).withColumn("query_id", F.concat_ws(":", "item_id", "route"))

    @cached_property
    def packs(self) -> DataFrame:
        ranked = self.reranked.withColumn("query_id", F.concat_ws(":", "query_id", "route"))
        return self._kept("packs", lambda: E.pack(ranked, self.docs, self.asks, self.scope_among(ranked), self.today))

    @cached_property
    def ask_features(self) -> DataFrame:
        return self.asks.select("query_id", "item_id", "route").join(self.features.withColumnRenamed("query_id", "item_id").drop("query"), "item_id")

    @cached_property
    def sufficiency(self) -> DataFrame:
        return self._kept("sufficiency", lambda: E.sufficiency(self.asks, self.packs, self.ask_features, self.today, self.scope_among(self.packs)))

    @cached_property
    def selected(self) -> DataFrame:
        def build() -> DataFrame:
            w = E.term_weights(self.asks, self.packs, self.chunks)
            return E.select_sentences(E.scored_sentences(self.packs, self.chunks, w))

        return self._kept("selected", build)

    @cached_property
    def claims(self) -> DataFrame:
        return self._kept("claims", lambda: E.claims(self.chunks))

    @cached_property
    def pack_claims(self) -> DataFrame:
        """Claims of the chunks that are in a pack; the other chunks' sentences are not looked at."""
        return E.claims(self.chunks.join(self.packs.select("chunk_id").distinct(), "chunk_id", "left_semi"))

    @cached_property
    def drafts(self) -> DataFrame:
        """(query_id, answer) with all conflicts disclosed, values as the SQL writes them (8.0), before citations are verified."""
        return E.answer_text(self.selected, E.version_conflicts(self.packs, self.today), E.freshness_notes(self.packs, self.today), E.numeric_conflicts(self.packs, self.pack_claims), short=False)

    @cached_property
    def answers(self) -> DataFrame:
        """(query_id, text, citations, stripped, abstained, failure_reason, cost) of every query and route."""

        def build() -> DataFrame:
            verified = E.verify_citations(self.drafts, self.packs)
            read = self.packs.join(self.chunks.select("chunk_id", "text"), "chunk_id").groupBy("query_id").agg(F.sum(F.length("text")).alias("chars"))
            a = self.asks.select("query_id", "item_id", "route", "user_id", "query").join(self.sufficiency.select("query_id", "sufficient", "failure_reason"), "query_id").join(verified, "query_id", "left").join(read, "query_id", "left")
            a = a.join(E.clarifying_question(self.ask_features, self.packs), "query_id")
            gone = (F.col("route") == "R0") | ~F.col("sufficient")
            tokens_in = F.greatest(F.lit(1), F.floor((F.coalesce("chars", F.lit(0)) + F.length("query")) / 4))
            cost = E.usd(tokens_in, E.token_estimate(F.col("text")))
            none = F.lit("")
            return a.select(
                "query_id", "item_id", "route", "user_id", gone.alias("abstained"), F.when(gone, F.coalesce("failure_reason", F.lit("router_declined"))).alias("failure_reason"),
                F.when(gone, E.abstention(F.col("failure_reason"), F.col("question"))).otherwise(F.col("text")).alias("text"), F.when(gone, none).otherwise(F.col("citations")).alias("citations"),
                F.when(gone, none).otherwise(F.col("stripped")).alias("stripped"), F.when(gone, 0.0).otherwise(cost).alias("cost"),
            )

        return self._kept("answers", build)

    @cached_property
    def systems(self) -> DataFrame:
        """(system, item_id, route): the same stack, only the choice of route differs."""
        f = self.features.join(self.decisions.select("query_id", "route"), "query_id")
        fixed = [F.struct(F.lit(f"B{i}").alias("system"), F.lit(f"R{i}").alias("route")) for i in range(1, 5)]
        chosen = [F.struct(F.lit("B5").alias("system"), R.by_complexity().alias("route")), F.struct(F.lit("P1").alias("system"), F.col("route").alias("route"))]
        return f.select(F.col("query_id").alias("item_id"), F.explode(F.array(*fixed, *chosen)).alias("s")).select("s.system", "item_id", "s.route")

    @cached_property
    def holders(self) -> DataFrame:
        """(query_id, doc_id): documents that hold the passage of a query, whatever white space and case. Candidates
        meet by the passage's second to fifth word, whole words of any text that holds it, hashed at every place of
        the texts; then the whole passage is looked for. Passages of fewer than six words are looked for in all texts."""

        def build() -> DataFrame:
            four = lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(4)))
            words = F.split("passage", " ")
            q = self.queries.select("query_id", folded("passage").alias("passage")).withColumn("words", words)
            t = self.table("documents").select("doc_id", folded("text").alias("text"))
            places = F.sequence(F.lit(0), F.greatest(F.size("words") - 4, F.lit(0)))
            s = t.select("doc_id", F.split("text", " ").alias("words")).select("doc_id", F.explode(F.transform(places, four)).alias("key"))
            pairs = s.join(q.where(F.size("words") >= 6).select("query_id", four(F.lit(1)).alias("key")), "key").select("query_id", "doc_id").distinct()
            # Only candidates' texts are folded a second time.
            texts = self.table("documents").select("doc_id", "text").join(pairs, "doc_id").join(q.select("query_id", "passage"), "query_id")
            found = texts.where(F.contains(folded("text"), F.col("passage"))).select("query_id", "doc_id")
            few = q.where(F.size("words") < 6).select("query_id", "passage")
            return found.unionByName(t.join(few, F.contains("text", "passage")).select("query_id", "doc_id").distinct())

        return self._kept("holders", build)

    @cached_property
    def gold_chunks(self) -> DataFrame:
        """(query_id, doc_id, chunk_id, how): the chunk of each holding document that stands for the passage."""

        def build() -> DataFrame:
            q = self.queries.select("query_id", folded("passage").alias("passage"))
            c = self.holders.join(self.chunks.select("doc_id", "chunk_id", "ordinal", folded("text").alias("text")), "doc_id").join(q, "query_id")
            how = F.when(F.contains("text", "passage"), 0).when(F.contains("text", F.substring("passage", 1, 100)), 1).otherwise(2)
            best = c.withColumn("how", how).groupBy("query_id", "doc_id").agg(F.min(F.struct("how", "ordinal", "chunk_id")).alias("b"))
            return best.select("query_id", "doc_id", "b.chunk_id", F.element_at(F.array(F.lit("whole"), F.lit("prefix"), F.lit("first")), F.col("b.how") + 1).alias("how"))

        return self._kept("gold-chunks", build)

    @cached_property
    def held(self) -> DataFrame:
        """(query_id, doc_id, user_id, ...): holders of the queries' passages, with who asks."""
        return self.holders.join(self.queries.select("query_id", "user_id"), "query_id")

    @cached_property
    def gold(self) -> DataFrame:
        return self.readable(self.held).select("query_id", "doc_id")

    @cached_property
    def forbidden(self) -> DataFrame:
        return self.held.join(self.scope_among(self.held), ["user_id", "doc_id"], "left_anti").select("query_id", "doc_id")

    @cached_property
    def items(self) -> DataFrame:
        """Labelled items: query_id, user_id, should_abstain, freshness_sensitive, query_type, expected_route."""
        g = self.gold.select("query_id").distinct().withColumn("has", F.lit(True))
        i = self.queries.join(g, "query_id", "left").withColumn("should_abstain", F.col("has").isNull())
        kind = F.when(F.col("should_abstain"), "unanswerable").when(F.col("freshness_sensitive"), "temporal").otherwise("exact")
        route = F.when(F.col("should_abstain"), "R0").when(F.col("freshness_sensitive"), "R3").otherwise("R1")
        return i.select("query_id", "user_id", "should_abstain", "freshness_sensitive", kind.alias("query_type"), route.alias("expected_route"))

    @cached_property
    def eval_rows(self) -> DataFrame:
        """One row per system and item with all metrics."""

        def build() -> DataFrame:
            from latchkey.operators import evaluate as V

            s = self.systems
            by = ("query_id", "system")
            ask = F.concat_ws(":", "item_id", "route").alias("ask")
            keyed = s.select("system", F.col("item_id").alias("query_id"), "route", ask)
            p = self.packs.withColumnRenamed("query_id", "ask").select("ask", "chunk_id", "doc_id", F.col("position").alias("rank"), "superseded_by")
            served = keyed.join(p, "ask")
            items = keyed.join(self.items, "query_id")
            m5 = V.retrieval_metrics(items.select(*by), served, self.gold, 5, by)
            a = self.answers.withColumnRenamed("query_id", "ask").select("ask", "abstained", "failure_reason", "citations", "cost")
            cited = keyed.join(a.where("not abstained"), "ask").select(*by, "ask", F.posexplode(F.filter(F.split("citations", ","), lambda c: c != "")).alias("place", "chunk_id"))
            cited = cited.withColumn("doc_id", F.split("chunk_id", "::")[0].cast("long"))
            c = V.citation_scores(items.select(*by), cited, self.gold, served, by)
            top = cited.where("place = 0").join(self.docs.select("doc_id", "superseded_by"), "doc_id").select(*by, F.col("superseded_by").isNull().alias("first_current"))
            surfaced = served.join(self.queries.select("query_id", "user_id"), "query_id")
            bad = surfaced.join(self.scope_among(surfaced), ["user_id", "doc_id"], "left_anti").unionByName(surfaced.join(self.forbidden, ["query_id", "doc_id"], "left_semi").select(surfaced.columns)).select(*by, "doc_id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("violations"))
            # Items of unknown users fail, and stay as scored rows.
            failed = self.queries.where(F.col("query_id") % 11 == 0).select((-1 - F.col("query_id")).alias("query_id"), F.explode(F.array(*map(F.lit, ("B1", "B2", "B3", "B4", "B5", "P1")))).alias("system"))
            j = items.join(a, "ask").join(m5, list(by)).join(c, list(by)).join(top, list(by), "left").join(bad, list(by), "left")
            rows = j.select(
                "system", "query_id", "query_type", "route", "expected_route", "abstained", "failure_reason", "recall", "mrr", "ndcg", "citation_precision", "citation_coverage", "groundedness",
                V.is_appropriate(F.col("should_abstain"), F.col("abstained")).alias("abstention_appropriate"), F.when(F.col("freshness_sensitive") & ~F.col("abstained"), F.col("first_current")).alias("freshness_compliant"),
                F.coalesce("violations", F.lit(0)).alias("violations"), F.round("cost", 6).alias("cost"),
            )
            fixed = {"query_type": F.lit("error"), "route": F.lit("ERROR"), "expected_route": F.lit("R0"), "abstained": F.lit(False), "failure_reason": F.lit("unknown user"), "abstention_appropriate": F.lit(False), "violations": F.lit(0), "cost": F.lit(0.0)}
            return rows.unionByName(failed.select("system", "query_id", *(fixed.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[2:])))

        return self._kept("eval-rows", build)

    @cached_property
    def turns(self) -> DataFrame:
        """(turn_id, conv_id, turn, query, history): what users say, with what they said before."""
        c = self.table("conversations").where("role = 'user'")
        before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
        return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "conv_id", "turn", F.col("text").alias("query"), before.alias("history"))

    @cached_property
    def audit(self) -> DataFrame:
        """One row per query as the governed system answered it; no text of query or evidence."""

        def build() -> DataFrame:
            chosen = self.decisions.select(F.col("query_id").alias("item_id"), "route", "confidence", "utility")
            used = self.packs.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("doc_id")), lambda d: d.cast("string")), ",").alias("used_docs"))
            ask = F.concat_ws(":", "query_id", "route").alias("query_id")
            seen = self.candidates.groupBy(ask).agg(F.array_join(F.transform(F.array_sort(F.collect_set("doc_id")), lambda d: d.cast("string")), ",").alias("considered_docs"), F.countDistinct("chunk_id").alias("pool"))
            kept_ = self.reranked.groupBy(ask).agg(F.count(F.lit(1)).alias("reranked"))
            four = lambda c: F.format_string("%.4f", F.round(F.col(c) + 1e-9, 4))
            told = self.utilities.groupBy(F.col("query_id").alias("item_id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("route", F.lit("="), four("utility")))), ",").alias("utilities"))
            f = self.features.select(F.col("query_id").alias("item_id"), F.concat_ws(",", F.concat(F.lit("intent="), "intent"), *(F.concat(F.lit(f"{n}="), four(n)) for n in R.NAMES)).alias("features"))
            r = self.user_roles.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
            a = self.answers.join(chosen, ["item_id", "route"]).join(seen, "query_id", "left").join(kept_, "query_id", "left").join(used, "query_id", "left").join(r, "user_id", "left").join(told, "item_id").join(f, "item_id")
            a = a.join(self.summary.select("user_id", "withheld"), "user_id").join(self.queries.select(F.col("query_id").alias("item_id"), "query"), "item_id")
            text = lambda c: F.coalesce(c, F.lit(""))
            return a.select(
                F.col("item_id").alias("query_id"), S0.asked_at(F.col("item_id")).alias("asked_at"), F.sha2(F.lower(F.trim("query")), 256).alias("query_hash"), "user_id", text("roles").alias("roles"), "route", "confidence", "utility", "utilities", "features",
                text("considered_docs").alias("considered_docs"), text("used_docs").alias("used_docs"), F.coalesce("pool", F.lit(0)).alias("pool"), F.coalesce("reranked", F.lit(0)).alias("reranked"), "withheld", "citations", "abstained",
                text("failure_reason").alias("failure_reason"), F.round("cost", 6).alias("cost"),
            )

        return self._kept("audit", build)
