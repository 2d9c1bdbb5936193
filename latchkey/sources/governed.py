"""Governance tables derived from the plain ones: metadata, versions, roles, users, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latchkey.operators.routing import normalise_query

REFERENCE_DATE = "2026-08-19"
# Who may read what.
TYPE_ROLES = (("policy", "employee"), ("policy", "hr"), ("policy", "manager"), ("runbook", "engineering"), ("report", "employee"), ("report", "engineering"), ("report", "manager"), ("finance", "finance"), ("wiki", "employee"))
SEGMENT_ROLES = (("HOUSEHOLD", "hr"), ("MACHINERY", "engineering"), ("FURNITURE", "manager"), ("BUILDING", "finance"))


def asked_at(query_id):
    """When a query was asked: one every seven minutes of the reference day, so several share a time."""
    return F.timestamp_add("MINUTE", query_id % 200 * 7, F.lit(REFERENCE_DATE).cast("timestamp_ntz"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of documents with their links of supersession; no text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    kind = F.element_at(F.array(*map(F.lit, ("policy", "runbook", "report", "finance", "wiki"))), (F.substring("source", 4, 9).cast("int") % 5 + 1))
    d = d.select(
        "doc_id",
        F.concat(F.lit("Doc "), "doc_id").alias("title"),
        F.col("source").alias("owner"),
        kind.alias("doc_type"),
        F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") * 37 % 1500).cast("int")).alias("effective_date"),
        (1 + F.col("doc_id") % 5).cast("int").alias("authority_score"),
        F.concat_ws("-", "lang", "source", F.col("doc_id") % 7).alias("policy_family"),
    )
    w = Window.partitionBy("policy_family").orderBy("effective_date", "doc_id")
    return d.withColumns(
        {
            "created_date": F.date_sub("effective_date", 30),
            "supersedes": F.lag("doc_id").over(w),
            "superseded_by": F.lead("doc_id").over(w),
            "version": F.concat(F.lit("1."), F.row_number().over(w)),
        }
    )


def doc_roles(docs: DataFrame) -> DataFrame:
    """(doc_id, role)."""
    pairs = docs.sparkSession.createDataFrame(list(TYPE_ROLES), "doc_type string, role string")
    return docs.join(F.broadcast(pairs), "doc_type").select("doc_id", "role")


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, role): everyone is an employee, a segment gives one more role, every 50th user has none."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 50 <> 0")
    pairs = spark.createDataFrame(list(SEGMENT_ROLES), "c_mktsegment string, role string")
    more = c.join(F.broadcast(pairs), "c_mktsegment").select(F.col("c_custkey").alias("user_id"), "role")
    return c.select(F.col("c_custkey").alias("user_id"), F.lit("employee").alias("role")).unionByName(more)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of all documents: whole texts, in every third one with headings and terms of notice,
    in another third with an allowance, so that sections and stated quantities occur."""
    n, line = F.col("doc_id"), "\n"
    number = F.floor(n / 140)
    headed = F.concat(F.lit("# Part "), n, F.lit(line), "text", F.lit(line + "2. Terms of notice" + line + "The notice period is "), 10 + number % 4, F.lit(" days."))
    allowed = F.concat("text", F.lit(line + "An allowance of "), 5 + number % 5, F.lit(" percent applies."))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n % 3 == 0, headed).when(n % 3 == 1, allowed).otherwise(F.col("text")).alias("text"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled queries about benchmark passages, in words of these, asked by one of 150 users: plain ones,
    comparisons, conjunctions, and follow-ups to a turn before (history). ``query`` is what is searched for."""
    words = F.split("text", r"\s+")
    some = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    kind = F.col("item_id") % 5
    asked = (
        F.when(kind == 1, F.concat(F.lit("difference between "), some(1, 5), F.lit(" and "), some(6, 5)))
        .when(kind == 2, F.concat(some(1, 5), F.lit(" versus "), some(6, 5)))
        .when(kind == 3, F.concat(some(1, 6), F.lit("; "), some(7, 6)))
        .when(kind == 4, F.concat(F.lit("what about "), some(7, 3)))
        .otherwise(some(1, 12))
    )
    q = table(spark, sf_dir, "benchmark").select("item_id", "text", asked.alias("asked"), F.when(kind == 4, some(1, 6)).alias("history"))
    return q.select(
        F.col("item_id").alias("query_id"), normalise_query(F.col("asked"), F.col("history")).alias("query"), "asked", "history",
        (1 + F.col("item_id") * 17 % 150).alias("user_id"), F.col("text").alias("passage"), (F.col("item_id") % 3 == 0).alias("freshness_sensitive"),
    )
