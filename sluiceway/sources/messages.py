"""Message log readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluiceway.schemas import MESSAGES

# A published log on files: the columns of a message, below topic= and shard= folders.
LOG = T.StructType(
    [f for f in MESSAGES if f.name != "shard"]
    + [T.StructField("topic", T.StringType()), T.StructField("shard", T.LongType())]
)


def read_messages(
    spark: SparkSession,
    topics_regex: str,
    path: str | None = None,
    stream: bool = False,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Messages of every topic whose whole name matches ``topics_regex``.

    With ``path``, typed messages from a published file log; topics that do
    not match are pruned as partitions. Without it, undecoded rows (topic,
    shard, seq, value) from Kafka, ``options`` going to the source. The
    query's checkpoint plays the part of a consumer group.
    """
    reader = spark.readStream if stream else spark.read
    reader = reader.options(**(options or {}))
    if path is None:
        return (
            reader.format("kafka")
            .option("subscribePattern", topics_regex)
            .load()
            .select(
                "topic", F.col("partition").cast("long").alias("shard"), F.col("offset").alias("seq"), "value"
            )
        )
    return reader.schema(LOG).parquet(path).filter(F.col("topic").rlike(f"^(?:{topics_regex})" + r"\z"))
