"""Queries as a stream: answered by micro-batch, audit rows written once per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_stream(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], to: str, checkpoint: str):
    """Starts a query that answers each micro-batch of the stream ``queries`` with ``answer`` and writes
    its audit rows to ``to`` under the batch's number. A batch that is run again writes the same
    partition again, so rows are neither lost nor doubled. There is no state, so no watermark."""

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(to)

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
