"""SequenceFile archives of key/value pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_kv_archive(spark: SparkSession, path: str, as_bytes: bool = False) -> DataFrame:
    """(key, value) of every file below ``path``; no DataFrame reader exists for this format."""
    kind = "binary" if as_bytes else "string"
    pairs = spark.sparkContext.sequenceFile(path)
    return spark.createDataFrame(pairs, f"key string, value {kind}")
