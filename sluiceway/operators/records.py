"""Key/value record views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluiceway.functions.payload import merge_timestamp


def record_sizes(df: DataFrame, key: str = "key", value: str = "value", with_values: bool = False) -> DataFrame:
    """Key length in characters and value length in bytes, with the value text on request."""
    out = [F.col(key).alias("key"), F.length(key).alias("key_len"), F.octet_length(value).alias("value_len")]
    if with_values:
        out.append(F.decode(F.col(value).cast("binary"), "UTF-8").alias("value"))
    return df.select(*out)


def with_ingest_ts(df: DataFrame, field: str = "ingest_ts", payload: str = "payload") -> DataFrame:
    """Set ``field`` of each JSON payload to the message time.

    A payload that is no JSON object becomes null with reason ``not_an_object``;
    an earlier reason stays.
    """
    merged = merge_timestamp(F.col(payload), F.col("ts_ms"), field)
    out = df.withColumn("_merged", F.encode(merged, "UTF-8"))
    found = F.when(F.col("_merged").isNull() & F.col(payload).isNotNull(), "not_an_object")
    before = F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")
    return out.withColumn("reason", F.coalesce(before, found)).withColumn(payload, F.col("_merged")).drop("_merged")


def dedupe_redelivered(df: DataFrame, delay: str | None = None, ts: str = "ts") -> DataFrame:
    """One row per log position (namespace, shard, seq, ord).

    On a stream give ``delay``: how much later a redelivered row may arrive.
    """
    position = ["namespace", "shard", "seq", "ord"]
    if df.isStreaming:
        if delay is None:
            raise ValueError("a stream needs a delay")
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(position)
    return df.dropDuplicates(position)
