"""Date-partitioned archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluiceway.functions.keys import utc_time

DEFAULT_CODEC = "org.apache.hadoop.io.compress.DefaultCodec"
# Columns of an archive, its folders last.
ARCHIVE = "key string, value binary, namespace string, ds string"


def archive_rows(actions: DataFrame, date_by: str = "event", date_format: str = "yyyy-MM-dd", more: list[str] | None = None) -> DataFrame:
    """(namespace, ds, key, value), and ``more``, of the stores; an archive ignores deletes.

    Stores without an event time go to the day ``undated``.
    """
    if date_by not in ("event", "ingest"):
        raise ValueError(f"unknown date_by {date_by!r}")
    at = utc_time(F.col("ts_ms")) if date_by == "event" else F.current_timestamp()
    return actions.filter("action = 'store'").select(
        "namespace",
        F.coalesce(F.date_format(at, date_format), F.lit("undated")).alias("ds"),
        F.col("id").alias("key"),
        F.col("payload").alias("value"),
        *(more or []),
    )


def write_archive(
    actions: DataFrame,
    path: str,
    date_by: str = "event",
    max_records: int = 0,
    mode: str = "append",
    spread: int | None = None,
) -> None:
    """Write below ``path``/namespace=/ds=.

    Adaptive execution splits a large (namespace, day) over tasks and packs
    small ones together. Where it is off, as inside a stream's micro-batch,
    ``spread`` says over how many tasks each may go.
    """
    rows = archive_rows(actions, date_by)
    keys = [F.col("namespace"), F.col("ds")]
    if spread is None:
        rows = rows.hint("rebalance", *keys)
    else:
        rows = rows.repartition(*keys, F.pmod(F.xxhash64("key", "value"), F.lit(spread)))
    rows.write.mode(mode).option("maxRecordsPerFile", max_records).partitionBy("namespace", "ds").parquet(path)


def export_kv(df: DataFrame, path: str, as_bytes: bool = False, codec: str | None = DEFAULT_CODEC) -> None:
    """Write (key, value) as SequenceFiles for Hadoop readers, one file per partition."""

    def pair(row):
        return row.key, bytearray(row.value) if as_bytes else row.value

    value = F.col("value").cast("binary" if as_bytes else "string")
    df.select("key", value.alias("value")).rdd.map(pair).saveAsSequenceFile(path, codec)
