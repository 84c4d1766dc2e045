"""Which log positions have arrived, as intervals: redelivered messages are dropped before any sink.

A shard that is delivered in order is one interval, however many messages it
had; only gaps add rows. Messages that share a position and differ in their
place within the request (``ord``) have intervals of their own. The ledger is written with each batch, beside the
sinks, and a repeated batch reads the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sluiceway.operators.ordering import CHUNK, int_div
from sluiceway.sinks.batches import batch_path, committed_batches, remove

SHARD = ["namespace", "shard", "ord"]
LEDGER = "namespace string, shard long, ord int, low long, high long"


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """Overlapping and touching intervals of each shard as one."""
    by = W.partitionBy(*SHARD).orderBy("low", "high")
    before = F.max("high").over(by.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.col("low") <= before + 1, 0).otherwise(1)
    islands = intervals.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*SHARD, "_island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_island")


def intervals_of(positions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(namespace, shard, ord, low, high) of the runs of consecutive ``seq``; first inside chunks of positions, then across."""
    runs = positions.select(*SHARD, "seq", int_div(F.col("seq"), chunk).alias("_run")).distinct()
    nth = F.row_number().over(W.partitionBy(*SHARD, "_run").orderBy("seq"))
    local = runs.withColumn("_island", F.col("seq") - nth).groupBy(*SHARD, "_run", "_island").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    return merged_intervals(local.select(*SHARD, "low", "high"))


def read_ledger(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The intervals after the last finished batch (before ``before``)."""
    done = [b for b in committed_batches(spark, path) if before is None or b < before]
    if not done:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(batch_path(path, done[-1]))


def _fresh(rows: DataFrame, ledger: DataFrame, chunk: int) -> DataFrame:
    """Those of ``rows`` whose position no interval of the ledger holds, one per position.

    Rows and intervals are sorted together inside chunks of positions. Intervals
    do not overlap, so only the last one that starts at or before a row can hold it.
    """
    runs = F.sequence(int_div(F.col("low"), chunk), int_div(F.col("high"), chunk))
    held = ledger.select(*SHARD, F.explode(runs).alias("_run"), "low", F.col("high").alias("_high"))
    held = held.select(*SHARD, "_run", F.greatest(F.col("low"), F.col("_run") * chunk).alias("seq"), "_high")
    marked = rows.withColumns({"_run": int_div(F.col("seq"), chunk), "_high": F.lit(None).cast("long")})
    by = W.partitionBy(*SHARD, "_run").orderBy("seq", F.col("_high").asc_nulls_last())
    is_row = F.col("_high").isNull()
    reached = F.last("_high", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    before = F.lag(F.when(is_row, F.col("seq"))).over(by)
    judged = marked.unionByName(held, allowMissingColumns=True).withColumns({"_reached": reached, "_before": before})
    arrived = F.coalesce(F.col("_reached") >= F.col("seq"), F.lit(False))
    again = F.coalesce(F.col("_before") == F.col("seq"), F.lit(False))
    return judged.filter(is_row & ~arrived & ~again).select(*rows.columns)


def drop_redelivered(rows: DataFrame, path: str, batch_id: int, chunk: int = CHUNK) -> DataFrame:
    """The rows of a batch whose log position (namespace, shard, seq, ord) no earlier batch had, each once.

    Batches may come in any order of positions. Rows without a position cannot
    be told apart and stay. Call ``commit_ledger`` once the sinks are written.
    """
    known = F.col("seq").isNotNull()
    fresh = _fresh(rows.filter(known), read_ledger(rows.sparkSession, path, batch_id), chunk)
    return fresh.unionByName(rows.filter(~known))


def commit_ledger(rows: DataFrame, path: str, batch_id: int, chunk: int = CHUNK) -> None:
    """Add the positions of a batch. Repeating a batch changes nothing."""
    spark = rows.sparkSession
    before = read_ledger(spark, path, batch_id)
    after = merged_intervals(before.unionByName(intervals_of(rows.filter("seq is not null"), chunk)))
    after.select("namespace", F.col("shard").cast("long").alias("shard"), F.col("ord").cast("int").alias("ord"), "low", "high").write.mode("overwrite").parquet(batch_path(path, batch_id))
    done = committed_batches(spark, path)
    remove(spark, f"{path}/batch=*", lambda name: int(name.split("=")[1]) < done[-2:][0])
