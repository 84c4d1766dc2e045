"""An archive whose files roll by size, across the batches of a stream.

A file is a folder ``namespace=/ds=/shard=/file_no=``; each batch adds its part
of it below the batch's own folder. Where the limit is far below a megabyte
consecutive files share a folder, named by the first, and ``place`` counts on
from there: else the folders of a batch would be as many as its records. How many bytes the open file of a group
holds is written with the batch, and the next batch goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluiceway.operators.batching import plan_files, record_bytes
from sluiceway.operators.ordering import join_groups
from sluiceway.sinks.archive import archive_rows
from sluiceway.sinks.batches import batch_path, committed_batches, read_batches, remove

GROUP = ["namespace", "ds", "shard"]
OPEN = "namespace string, ds string, shard long, file_no long, held long"
FILES = "key string, value binary, seq long, ord int, place long, namespace string, ds string, shard long, file_no long"
ROLL_BYTES = 536_870_912
# Files share a folder up to about this size.
FOLDER_BYTES = 1 << 20


def _open_files(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The open file of each group after the last finished batch before ``before``."""
    done = [b for b in committed_batches(spark, f"{path}/open") if b < before]
    if not done:
        return spark.createDataFrame([], OPEN)
    return spark.read.schema(OPEN).parquet(batch_path(f"{path}/open", done[-1]))


def write_rolling(actions: DataFrame, path: str, batch_id: int, max_bytes: int = ROLL_BYTES, date_by: str = "event") -> None:
    """Append a batch of stores to the rolling archive below ``path``.

    Before each record, in log order, the open file of its (namespace, day,
    shard) closes if it holds ``max_bytes`` or more; 0 never rolls. A record
    counts its key's characters and its value's bytes. What a file held when
    the batch began stands in the plan as one record before all others.

    Batch ids rise. A repeated batch starts from the state before it and writes
    its own folders again, so nothing is there twice.
    """
    spark = actions.sparkSession
    rows = archive_rows(actions, date_by, more=["shard", "seq", "ord"])
    opened = _open_files(spark, path, batch_id)
    slim = rows.select(*GROUP, "seq", "ord", F.coalesce(record_bytes(F.col("key"), F.col("value")), F.lit(0)).cast("long").alias("n_bytes"))
    begun = join_groups(slim.select(*GROUP).distinct(), opened, GROUP).select(
        *GROUP, F.lit(0).cast("long").alias("seq"), F.lit(-1).alias("ord"), F.col("held").alias("n_bytes")
    )
    planned = plan_files(slim.withColumn("ord", F.col("ord").cast("int")).unionByName(begun), max_bytes, group=tuple(GROUP))
    numbered = join_groups(planned, opened.select(*GROUP, F.col("file_no").alias("_base")), GROUP, "left")
    numbered = numbered.withColumn("file_no", F.col("file_no") + F.coalesce("_base", F.lit(0))).drop("_base")

    place = [*GROUP, "seq", "ord"]
    files = join_groups(rows, numbered.filter("ord >= 0").select(*place, "file_no").distinct(), place)
    place = F.pmod("file_no", F.lit(max(1, FOLDER_BYTES // max_bytes) if max_bytes else 1))
    files = files.withColumn("place", place).withColumn("file_no", F.col("file_no") - F.col("place"))
    files = files.select("key", "value", "seq", F.col("ord").cast("int").alias("ord"), "place", *GROUP, "file_no")
    # The number is given, or small batches would be written by one task: files cost more than their bytes.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = files.repartition(tasks, *GROUP, "file_no").sortWithinPartitions(*GROUP, "file_no", "place", "seq", "ord")
    laid.write.mode("overwrite").partitionBy(*GROUP, "file_no").parquet(batch_path(f"{path}/files", batch_id))

    sizes = numbered.groupBy(*GROUP, "file_no").agg(F.sum("n_bytes").alias("held"))
    last = sizes.groupBy(*GROUP).agg(F.max(F.struct("file_no", "held")).alias("l")).select(*GROUP, "l.file_no", "l.held")
    rest = opened.join(last.withColumnsRenamed({g: f"_{g}" for g in GROUP}), [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in GROUP], "left_anti")
    rest.unionByName(last).write.mode("overwrite").parquet(batch_path(f"{path}/open", batch_id))
    done = committed_batches(spark, f"{path}/open")
    remove(spark, f"{path}/open/batch=*", lambda name: int(name.split("=")[1]) < done[-2:][0])


def read_rolling(spark: SparkSession, path: str) -> DataFrame:
    """All archived records with their group, file_no and batch."""
    found = read_batches(spark, f"{path}/files", schema=FILES)
    if found is None:
        raise ValueError(f"no finished batch below {path}")
    return found.withColumn("file_no", F.col("file_no") + F.coalesce("place", F.lit(0))).drop("place")
