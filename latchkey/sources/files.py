"""Files in and out: text corpora, JSON lines, evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = ("txt", "md", "markdown")


def corpus_scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of all files below ``path``: UTF-8 text, else latin-1; a file of another kind or
    without text is a row with an error and stops nothing."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    text = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    text = F.when(kind.isin(*EXTENSIONS), text)
    error = F.when(~kind.isin(*EXTENSIONS), F.concat(F.lit("unsupported type: "), kind)).when(F.trim(text) == "", "empty file")
    return f.select("path", F.when(error.isNull(), text).alias("text"), error.alias("error"))


def jsonl_scan(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of a JSON-lines file; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def run_id(config: dict) -> str:
    """Sixteen hex digits that a configuration hashes to, whatever the order of its keys."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def store_run(rows: DataFrame, path: str, run: str) -> None:
    """Writes a run's rows by run and system; the same run written again replaces itself alone."""
    rows.withColumn("run_id", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "system").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, systems, rows) of a store."""
    return spark.read.parquet(path).groupBy("run_id").agg(F.countDistinct("system").alias("systems"), F.count(F.lit(1)).alias("rows"))


def export(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
