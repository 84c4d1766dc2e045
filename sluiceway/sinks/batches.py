"""Output folders written once per batch id.

Each batch overwrites its own folder, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_path(path, batch_id))


def committed_batches(spark: SparkSession, path: str, name: str = "batch") -> list[int]:
    """Ids of the ``name=<id>`` folders whose write has finished."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS")
    found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])


def remove(spark: SparkSession, pattern: str, which: Callable[[str], bool]) -> None:
    """Delete the folders that match ``pattern`` and whose name ``which`` picks."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    files = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.globStatus(found) or []:
        if which(status.getPath().getName()):
            files.delete(status.getPath(), True)


def read_batches(
    spark: SparkSession, path: str, after: int = -1, schema: str | None = None
) -> DataFrame | None:
    """Rows of the finished batches with an id above ``after``; None when there are none.

    Give the ``schema`` where all batches may be without rows.
    """
    ids = [i for i in committed_batches(spark, path) if i > after]
    if not ids:
        return None
    reader = spark.read.option("basePath", path)
    if schema is not None:
        reader = reader.schema(f"{schema}, batch long")
    return reader.parquet(*[batch_path(path, i) for i in ids])


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key over all batches of an update-mode stream; rows with a ``reason`` are no updates."""
    rows = read_batches(spark, path)
    if rows is None:
        raise ValueError(f"no finished batch below {path}")
    if "reason" in rows.columns:
        rows = rows.filter("reason is null")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
        .select(*keys, "_row.*")
    )
