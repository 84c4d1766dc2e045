"""Keyed state on files: key-hash buckets, a manifest, and segments merged tier by tier.

A batch adds one small segment of partial states, whose merge does not depend
on order or repetition. ``FANOUT`` segments of a tier become one of the next,
so a table of n batches has about log(n) segments, and a row is written again
about log(n) times. Each segment is split into buckets by a hash of (namespace,
id): all rows of an id, whatever their row keys, are in one bucket.

A manifest names the segments that count. It is written last, in a folder of
its own version, so that readers see a batch whole or not at all, and never
list batches. The previous manifest's segments stay for readers that still use it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from sluiceway.operators.ordering import join_groups
from sluiceway.operators.state import HORIZON_MS, KEY, is_alive, live_rows, merge_states, partial_state, with_row_keys
from sluiceway.sinks.batches import committed_batches, remove

BUCKETS, FANOUT = 64, 4
MANIFEST = "segment string, tier int, last_batch long, buckets int"
STATE = "put_at struct<ts_ms: bigint, seq: bigint, ord: int, shard: bigint>, payload binary, del_ms bigint, deleted boolean, bucket int"


def _keys(key_mode: str) -> list[str]:
    if key_mode not in ("plain", "salted"):
        raise ValueError(f"unknown key mode {key_mode!r}")
    return KEY if key_mode == "plain" else [*KEY, "row_key"]


def _schema(keys: list[str]) -> str:
    return ", ".join(f"{k} {'binary' if k == 'row_key' else 'string'}" for k in keys) + f", {STATE}"


def key_bucket(buckets: int, namespace: Column, id: Column) -> Column:
    return F.pmod(F.xxhash64(namespace, id), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str) -> list[int]:
    return committed_batches(spark, f"{path}/manifest", "version")


def _segments(spark: SparkSession, path: str, version: int) -> list[Row]:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={version}").collect()


def segments(spark: SparkSession, path: str) -> list[Row]:
    """The segments that count (segment, tier, last_batch, buckets), oldest first."""
    versions = _versions(spark, path)
    return sorted(_segments(spark, path, versions[-1]), key=lambda s: (s.last_batch, s.segment)) if versions else []


def _read(spark: SparkSession, path: str, found: list[Row], keys: list[str]) -> DataFrame:
    return spark.read.schema(_schema(keys)).option("basePath", f"{path}/segments").parquet(
        *[f"{path}/segments/segment={s.segment}" for s in found]
    ).drop("segment")


def _write(states: DataFrame, path: str, segment: str) -> None:
    """Buckets are folders; those of a small segment are written by few tasks."""
    states.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/segments/segment={segment}")


def _commit(spark: SparkSession, path: str, version: int, found: list[Row]) -> None:
    """Make ``found`` the table, and drop what neither this manifest nor the one before it names."""
    rows = [(s.segment, s.tier, s.last_batch, s.buckets) for s in found]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    versions = _versions(spark, path)
    named = {s.segment for v in versions[-2:] for s in _segments(spark, path, v)}
    remove(spark, f"{path}/segments/segment=*", lambda name: name.split("=")[1] not in named)
    remove(spark, f"{path}/manifest/version=*", lambda name: int(name.split("=")[1]) < versions[-2:][0])


def _merged(states: DataFrame, keys: list[str]) -> DataFrame:
    return merge_states(states, ["bucket", *keys])


def upsert_state(
    actions: DataFrame, path: str, batch_id: int, key_mode: str = "plain", buckets: int = BUCKETS, fanout: int = FANOUT
) -> None:
    """Apply a batch of stores and deletes. Batch ids rise; repeating one changes nothing.

    A salted table has a row per id and day. Stores that allow no row key are
    not for it (see ``refuse_unsaltable``); deletes name the bare id and are
    kept beside its rows.
    """
    spark, keys = actions.sparkSession, _keys(key_mode)
    found = segments(spark, path)
    if found and batch_id <= max(s.last_batch for s in found):
        return
    version = 1 + max(_versions(spark, path), default=-1)
    buckets = found[0].buckets if found else buckets
    if key_mode == "salted":
        actions = with_row_keys(actions)
    bucket = key_bucket(buckets, F.col("namespace"), F.col("id"))
    _write(partial_state(actions.withColumn("bucket", bucket), ["bucket", *keys]), path, f"{version}-0")
    found.append(Row(segment=f"{version}-0", tier=0, last_batch=batch_id, buckets=buckets))
    tier = 0
    while len(full := [s for s in found if s.tier == tier]) >= fanout:
        tier += 1
        _write(_merged(_read(spark, path, full, keys), keys), path, f"{version}-{tier}")
        last = max(s.last_batch for s in full)
        found = [s for s in found if s.tier != tier - 1] + [Row(segment=f"{version}-{tier}", tier=tier, last_batch=last, buckets=buckets)]
    _commit(spark, path, version, found)


def _live(states: DataFrame, horizon_ms: int, keys: list[str], fix_deletes: bool) -> DataFrame:
    if keys == KEY:
        return live_rows(states, horizon_ms, keys)
    puts = states.filter("put_at is not null").drop("del_ms", "deleted")
    if not fix_deletes:
        return live_rows(puts.withColumns({"del_ms": F.lit(None).cast("long"), "deleted": F.lit(False)}), horizon_ms, keys)
    tombs = states.filter("put_at is null and deleted").select(*KEY, "del_ms", "deleted")
    held = join_groups(puts, tombs, KEY, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    return live_rows(held, horizon_ms, keys)


def _states(spark: SparkSession, path: str, key_mode: str) -> tuple[DataFrame, list[Row]]:
    found = segments(spark, path)
    if not found:
        raise ValueError(f"no finished batch below {path}")
    return _read(spark, path, found, _keys(key_mode)), found


def read_state(
    spark: SparkSession, path: str, horizon_ms: int = HORIZON_MS, key_mode: str = "plain", fix_deletes: bool = False
) -> DataFrame:
    """The live rows. ``fix_deletes``: deletes reach all rows of their id in a salted table too."""
    states, _ = _states(spark, path, key_mode)
    return _live(_merged(states, _keys(key_mode)), horizon_ms, _keys(key_mode), fix_deletes)


def read_id(
    spark: SparkSession, path: str, namespace: str, id: str, horizon_ms: int = HORIZON_MS, key_mode: str = "plain", fix_deletes: bool = False
) -> DataFrame:
    """The live rows of one id: only the files of its bucket are read."""
    states, found = _states(spark, path, key_mode)
    bucket = key_bucket(found[0].buckets, F.lit(namespace), F.lit(id))
    mine = states.filter((F.col("bucket") == bucket) & (F.col("namespace") == namespace) & (F.col("id") == id))
    return _live(_merged(mine, _keys(key_mode)), horizon_ms, _keys(key_mode), fix_deletes)


def compact_state(spark: SparkSession, path: str, horizon_ms: int = HORIZON_MS, lateness_ms: int | None = None, key_mode: str = "plain") -> None:
    """Merge all segments into one of the highest tier.

    A plain table then holds no put that a delete hides, as any write that
    could follow it is hidden too. With ``lateness_ms``, how far behind the
    newest row a row may still come, it also forgets the times of deletes that
    can hide no timed put any more. That there was a delete stays: it hides
    puts without a time, whenever they come.
    """
    keys = _keys(key_mode)
    found = segments(spark, path)
    if len(found) < 2 and not (found and found[0].tier == 0):
        return
    kept = _merged(_read(spark, path, found, keys), keys)
    if key_mode == "plain":
        alive = is_alive(F.col("put_at"), F.col("del_ms"), F.col("deleted"), horizon_ms)
        kept = kept.withColumns({"payload": F.when(alive, F.col("payload")), "put_at": F.when(alive, F.col("put_at"))})
    if lateness_ms is not None:
        newest = _read(spark, path, found, keys).agg(F.max(F.greatest("put_at.ts_ms", "del_ms"))).first()[0]
        if newest is not None:
            spent = F.col("del_ms") + horizon_ms < newest - lateness_ms
            # A salted table's puts still have to meet it.
            kept = kept.withColumn("del_ms", F.when(~spent, F.col("del_ms"))) if key_mode == "plain" else kept
    version = 1 + _versions(spark, path)[-1]
    tier = max(1, max(s.tier for s in found))
    _write(kept.filter("put_at is not null or deleted"), path, f"{version}-{tier}")
    last = max(s.last_batch for s in found)
    _commit(spark, path, version, [Row(segment=f"{version}-{tier}", tier=tier, last_batch=last, buckets=found[0].buckets)])
