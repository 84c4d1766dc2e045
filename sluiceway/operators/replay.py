"""Replaying stored messages to another collector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.functions.keys import at_position, stable_uuid

# Fixed value: stands for the key in a destination pattern.
KEY_PLACEHOLDER = "%k"


def in_sample(key: Column, rate: float, stable: bool = True, seed: int | None = None) -> Column:
    """Sampling test. The stable form decides by a hash of the key; a rate of 1 keeps all."""
    if rate >= 1:
        return F.lit(True)
    if not stable:
        return F.rand(seed) < rate
    share = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return share < rate


def sample_messages(df: DataFrame, rate: float, stable: bool = True, seed: int | None = None) -> DataFrame:
    """Keep a share of the stores; deletes always pass."""
    return df.filter((F.col("action") == "delete") | in_sample(F.col("id"), rate, stable, seed))


def replay_url(pattern: str, key: Column) -> Column:
    """``pattern`` with its first ``%k`` replaced by the key."""
    head, found, tail = pattern.partition(KEY_PLACEHOLDER)
    return F.concat(F.lit(head), key, F.lit(tail)) if found else F.lit(pattern)


def replay_key(copy_keys: bool, stable: bool = True) -> Column:
    """Key used at the destination: the source key, or a new one; deletes keep theirs."""
    position = at_position(*map(F.col, ("namespace", "shard", "seq", "ord")))
    new = stable_uuid(F.lit("replay"), *position) if stable else F.uuid()
    return F.col("id") if copy_keys else F.when(F.col("action") == "delete", F.col("id")).otherwise(new)


def replay_plan(
    actions: DataFrame,
    pattern: str,
    copy_keys: bool = True,
    rate: float = 1,
    deletes: bool = False,
    stable: bool = True,
    seed: int | None = None,
) -> DataFrame:
    """(method, url, body) per replayed record: POST for stores, DELETE for deletes.

    Sending them is the caller's part; message time is not carried over.
    """
    wanted = ["store", "delete"] if deletes else ["store"]
    kept = sample_messages(actions.filter(F.col("action").isin(wanted)), rate, stable, seed)
    is_delete = F.col("action") == "delete"
    return kept.select(
        "seq",
        "ord",
        F.when(is_delete, "DELETE").otherwise("POST").alias("method"),
        replay_url(pattern, replay_key(copy_keys, stable)).alias("url"),
        F.when(~is_delete, F.col("payload")).alias("body"),
    )
