"""Helpers that the text operators share: staging tables, linking rows into components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (a single-machine session, as in tests) a local folder is set once.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("latchkey.checkpoint.dir", None)
        if not at and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="latchkey-")
            spark.conf.set("latchkey.checkpoint.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def delete_folder(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs whose DataFrames are gone, which otherwise
    waits for the driver's next full garbage collection."""
    for _ in range(2):  # the first call also lets go of what the driver's Python has dropped
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that tasks hold, since rows with texts can be of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def tidy(run):
    """``run``, a function over Arrow batches, that at its end gives back the memory Arrow keeps in reserve:
    the worker lives on, and beside it the executor's other processes need theirs."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return tidied


def text_column(name: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def join_hot(rows: DataFrame, table: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row for each key) for their key, null where it has none.

    Keys that hold more than one in ``most`` of all rows are fewer than ``most`` whatever the input, so
    their part of ``table`` is broadcast and their rows stay where they are; the others' rows are too
    few to fill a task and are joined by an ordinary shuffle."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = staged(n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).where(F.col("n") * most > F.col("all")).select(key), "hot")
    few = F.broadcast(table.join(F.broadcast(hot), key, "left_semi"))
    busy = rows.join(F.broadcast(hot), key, "left_semi").join(few, key, "left")
    return busy.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): ``component`` is the smallest node that links reach from ``node``.

    Only nodes that occur in a link are returned. Large-star / small-star rounds (Kiveris et al.,
    2014) on a distributed table of links, each round written to the shared folder, until all links
    point to a smallest node. Links, nodes and components never come to the driver; each round counts
    only changed links. An empty table gives an empty result; null ends are ignored.
    """
    spark = links.sparkSession
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    edges = staged(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("k"), F.least("u", "w").alias("w"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("w")).withColumnRenamed("u", "k")
        small = (
            large.join(low, F.col("u") == F.col("k"))
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("w").alias("v")), F.struct("u", F.col("w").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = staged(small, "links")
        # Stars: no node is both an end that points and an end that is pointed at.
        is_star = new.select(F.col("v").alias("u")).distinct().join(new.select("u"), "u", "left_semi").limit(1).count() == 0
        many = new.groupBy("u").count().where("count > 1").limit(1).count() if is_star else 1
        edges = new
        if is_star and not many:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
