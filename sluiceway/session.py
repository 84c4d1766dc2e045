"""Session settings and shared scratch space."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Used by single-process sessions only.
LOCAL_DIR = "/tmp/checkpoints"
# Bytes that may be sent to every task; beyond them both sides of a join are shuffled.
SENT_BYTES = 64 << 20
# Shuffle files go when the statement that wrote them ends, not when the driver happens to collect its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Paths of the tables written inside each open block of ``passing``, the innermost last.
_WRITTEN: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Static settings, for whoever builds the session. Recording a call site for
# every Column expression triples the time it takes to build a plan.
SESSION_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local-mode session for tests and measurements."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    settings = {"spark.sql.shuffle.partitions": str(cores), **SESSION_CONF, **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # The JVM never compiles a method above 8000 bytes; beyond that, generated
    # code split over several methods is faster than one fused stage.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder.

    Only a session whose tasks run in the driver's own process may do without
    the setting; on a cluster it is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL_DIR
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def workspace(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder, removed when the application ends."""
    run = f"{shared_dir(spark)}/sluiceway-{spark.sparkContext.applicationId}"
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(run)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return f"{run}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, *, keep: bool = False, **options: str) -> DataFrame:
    """Cut the lineage of ``df`` by writing it once and reading it back; what the write shuffles is freed at its end.

    Inside ``passing`` the table goes at the end of the block, or with ``keep`` of the block around it, if any.
    """
    spark = df.sparkSession
    path = workspace(spark, tag)
    blocks = _WRITTEN.get()[: -1 if keep else None]
    if blocks:
        blocks[-1].append(path)
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """A block whose written tables are deleted at its end: what leaves it must be written with ``keep``."""
    here: list[str] = []
    token = _WRITTEN.set((*_WRITTEN.get(), here))
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        for path in here:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def few(df: DataFrame, n_bytes: Column | int, most: int = SENT_BYTES) -> bool:
    """Whether the rows of the written ``df``, of ``n_bytes`` each, may be sent to every task."""
    size = df.agg(F.coalesce(F.sum(F.lit(n_bytes) if isinstance(n_bytes, int) else n_bytes), F.lit(0))).first()[0]
    return size <= most


def small(df: DataFrame, n_bytes: Column | int) -> DataFrame:
    """The written ``df`` marked for broadcast if its rows, of ``n_bytes`` each, are few."""
    return F.broadcast(df) if few(df, n_bytes) else df
