"""A corpus pipeline: each stage works on all that the stage before it kept and is written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latchkey.llm import decontaminate, mixing, paragraph_dedup, tokens, toxicity
from latchkey.llm.common import new_folder
from latchkey.llm.queries import tokenizer_path


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but rows whose doc_id is in ``ids`` (column gone)."""
    return docs.join(ids, docs["doc_id"] == ids["gone"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; null ids are never rejected."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = toxicity.score_documents(docs, model).where("predicted = 1").select(F.col("doc_id").alias("gone"))
    return _without(docs, rejected.distinct())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id; null ids stay. Texts that SimHash
    ties together, and what bands of MinHash add, are near duplicates if their 5-word Jaccard similarity is 0.8 or more."""
    groups = paragraph_dedup.similar_documents(docs)
    return _without(docs, groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct())


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    leaks = decontaminate.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, leaks.select(F.col("doc_id").alias("gone")).distinct())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to three times, or not at all."""
    selection, _ = mixing.mix(docs, F.array("source"), mixing.word_count(F.col("text")))
    copies = selection.where("copies > 0").groupBy(F.col("doc_id").alias("picked")).agg(F.max("copies").alias("copies"))
    taken = docs.join(copies, docs["doc_id"].eqNullSafe(copies["picked"]))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    return taken.select(row, F.explode(F.sequence(F.lit(1), copies["copies"]))).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and checksum of each document in the token files."""
    return tokens.tokenize(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("source mixing", mix_sources),
    ("token output", write_tokens),
]
#: The classifier, the linked components and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        at = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
