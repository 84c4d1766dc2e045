"""Live meters: the counts behind the request, response, consumer and sink reports, carried from batch to batch.

A batch adds its counts to those of the batch before it and writes the sum
under its own id, so a repeated batch counts once and a restart goes on where
it stopped. A table has a row per namespace and kind of row, never per message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluiceway.operators.metrics import message_counts, request_counts
from sluiceway.operators.validation import DEFAULT_MAX_VALUE
from sluiceway.sinks.batches import batch_path, committed_batches, remove


def add_counts(counts: DataFrame, path: str, batch_id: int) -> None:
    """Add a batch's counts (keys, n and n_bytes) to the table below ``path``; batch ids rise, repeating one changes nothing."""
    spark, keys = counts.sparkSession, [c for c in counts.columns if c not in ("n", "n_bytes")]
    done = [b for b in committed_batches(spark, path) if b < batch_id]
    if done:
        counts = counts.unionByName(spark.read.schema(counts.schema).parquet(batch_path(path, done[-1])))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"))
    total.write.mode("overwrite").parquet(batch_path(path, batch_id))
    done = committed_batches(spark, path)
    remove(spark, f"{path}/batch=*", lambda name: int(name.split("=")[1]) < done[-2:][0])


def meter_requests(classified: DataFrame, path: str, batch_id: int) -> None:
    add_counts(request_counts(classified), f"{path}/requests", batch_id)


def meter_messages(gated: DataFrame, path: str, batch_id: int, limit: int = DEFAULT_MAX_VALUE) -> None:
    add_counts(message_counts(gated, limit), f"{path}/messages", batch_id)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts after the last finished batch."""
    done = committed_batches(spark, path)
    if not done:
        raise ValueError(f"no finished batch below {path}")
    return spark.read.parquet(batch_path(path, done[-1]))
