"""Publishing messages to topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from sluiceway.operators.records import record_sizes
from sluiceway.sources.messages import LOG


def publish_layout(df: DataFrame, shards: int = 8) -> DataFrame:
    """Topic = namespace; the shard depends on the id alone, so an id stays in one shard."""
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("long")
    return df.withColumns({"topic": F.col("namespace"), "shard": shard}).select(*LOG.names)


def publish(df: DataFrame, path: str, shards: int = 8) -> None:
    """Append to a file log. Large shards are written by several tasks, small ones together."""
    laid_out = publish_layout(df, shards).hint("rebalance", F.col("topic"), F.col("shard"))
    laid_out.write.mode("append").partitionBy("topic", "shard").parquet(path)


def publish_kafka(encoded: DataFrame, options: dict[str, str]) -> None:
    """Send encoded messages; the broker partitions by key. Needs Spark's Kafka package."""
    encoded.select("topic", "key", "value").write.format("kafka").options(**options).save()


def to_console(df: DataFrame, with_values: bool = False) -> DataStreamWriter:
    """Record sizes on the console, for a stream with ``key`` and ``value``."""
    return record_sizes(df, with_values=with_values).writeStream.format("console")
