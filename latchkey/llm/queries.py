"""The queries of this package and their SQL. Each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latchkey.llm import conversations, decontaminate, exact_dedup, mixing, paragraph_dedup, periodic, pii, quality, simhash, suffix_dedup, tokens, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The file of the public tokenizer that the queries use; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_single(_table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key that the session's ``latchkey.pii.key`` has in hex, else a random one."""
    key = spark.conf.get("latchkey.pii.key", None)
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), bytes.fromhex(key) if key else None)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.planted(_table(spark, sf_dir, "documents"))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(_table(spark, sf_dir, "conversations"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).drop("failed_rule")


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_suffix_array_dedup,
        op3_source_mixing,
        op4_benchmark_decontamination,
        op5_token_output,
        op6_exact_dedup,
        op7_paragraph_dedup,
        op8_toxicity,
        op9_pii_surrogates,
        op10_url_filter,
        op11_periodic_runs,
        op12_conversation_repair,
        op13_quality_rules,
    )
}
ORACLE_SQL = {"op3_source_mixing": mixing.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op13_quality_rules": quality.ORACLE}
