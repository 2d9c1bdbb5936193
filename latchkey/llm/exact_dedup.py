"""Exact dedup with a heavy-hitter split; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latchkey.llm.common import staged, text_column


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 1024, tracked: int = 16384) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows with the same text (byte for byte; null is the empty text) form a group, and the row with
    the largest id stays. Repeated rows with that id all count as kept; a null id is never the
    largest, and a group with null ids alone keeps all its rows with keep_id null. An empty table
    gives an empty result.

    A mergeable frequent-items sketch of the Misra-Gries family (``approx_top_k``) finds at most
    ``top`` digests that may be frequent. Their exact counts and winners come from one aggregate with
    map-side combining, are at most ``top`` rows whatever the input's size, and are broadcast, so rows
    of frequent texts get their answer where they are read and are never shuffled. The other digests
    are too rare to fill a partition and go through an ordinary shuffle. A digest that the sketch
    misses only costs balance, never the result. Texts are read once: digests and ids are written to
    the shared folder, and all passes go over those.
    """
    d = staged(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_column(text_col), 256)).alias("digest")), "digests")
    frequent = (
        d.select(F.hex("digest").alias("h"))
        .agg(F.expr(f"approx_top_k(h, {top}, {tracked})").alias("items"))
        .select(F.explode("items").alias("i"))
        .where("i.count > 1")
        .select(F.unhex("i.item").alias("digest"))
    )
    winners = (
        d.join(F.broadcast(frequent), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    hot = d.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    cold = d.join(F.broadcast(winners), "digest", "left_anti").select(
        "digest", "doc_id", F.max("doc_id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size")
    )
    return hot.select(cold.columns).unionByName(cold).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = """
select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
       doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256
from (select doc_id, sha256(coalesce(text, '')) as h from documents)
"""
