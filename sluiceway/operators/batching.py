"""Write batches, archive file boundaries and batches lost to one bad record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sluiceway.operators.ordering import CHUNK, int_div, join_groups, running_totals
from sluiceway.session import materialize

def flush_batches(
    df: DataFrame,
    size: int = 100,
    group: tuple[str, ...] = ("namespace", "shard"),
    order: tuple[str, ...] = ("seq", "ord"),
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``batch``: every ``size`` records of a group, in log order, form one write."""
    if size <= 0:
        raise ValueError("the batch size must be positive")
    numbered = running_totals(df, list(group), list(order), {"_row": F.lit(1)}, chunk)
    return numbered.withColumn("batch", int_div(F.col("_row"), size)).drop("_row")


def poison_batches(
    df: DataFrame,
    size: int,
    max_bytes: int,
    n_bytes: str = "n_bytes",
    group: tuple[str, ...] = ("shard",),
    order: tuple[str, ...] = ("seq", "ord"),
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``batch`` and ``lost``: one record above ``max_bytes`` discards its whole batch."""
    batched = flush_batches(df, size, group, order, chunk)
    worst = F.max(n_bytes).over(W.partitionBy(*group, "batch"))
    return batched.withColumn("lost", F.coalesce(worst > max_bytes, F.lit(False)))


def record_bytes(key: Column, value: Column) -> Column:
    """Archive size of a record: key characters plus value bytes."""
    return F.length(key) + F.octet_length(value)


def plan_files(
    df: DataFrame,
    max_bytes: int = 536_870_912,
    n_bytes: str = "n_bytes",
    group: tuple[str, ...] = ("namespace", "ds", "shard"),
    order: tuple[str, ...] = ("seq", "ord"),
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``file_no``: a writer opens the next file once the current one holds ``max_bytes``.

    The check runs before each append, so a file closes at the first record
    boundary at or past the limit; 0 never rolls. Where a file starts depends
    on every earlier start; ``_file_starts`` finds them without a task that
    reads a whole group. Null group values are groups, null sizes count as 0.

    Runs jobs while the plan is built: ``df`` is written once, so give it no
    more columns than needed, and each level of the search is a written table.
    """
    if max_bytes < 0:
        raise ValueError("the file limit must not be negative")
    if max_bytes == 0:
        return df.withColumn("file_no", F.lit(0).cast("long"))
    keys = list(group)
    rows = materialize(df, "file-records")
    placed = running_totals(rows, keys, list(order), {"_at": F.coalesce(F.col(n_bytes), F.lit(0))}, chunk).withColumn(
        "_slot", _slot(F.col("_at"), max_bytes)
    )
    placed = materialize(placed, "file-positions")
    starts = _file_starts(placed.select(*keys, "_at", "_slot").distinct(), keys, max_bytes)
    # At most one file starts per slot: count the starts of earlier slots, then
    # compare with the one in the record's own slot.
    opened = starts.select(*keys, "_slot", F.col("_at").alias("_start"))
    slots = join_groups(placed.select(*keys, "_slot").distinct(), opened, [*keys, "_slot"], "left")
    before = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    slots = slots.withColumn("_opened", F.coalesce(F.count("_start").over(before), F.lit(0)))
    own = F.coalesce((F.col("_at") >= F.col("_start")).cast("int"), F.lit(0))
    return join_groups(placed, slots, [*keys, "_slot"]).select(*df.columns, (F.col("_opened") + own - 1).alias("file_no"))


def _slot(at: Column, max_bytes: int) -> Column:
    return int_div(at, max_bytes)


def _next_starts(points: DataFrame, keys: list[str], max_bytes: int) -> DataFrame:
    """For every byte position: ``nxt``, where the file after one starting there begins.

    That is the first position at least ``max_bytes`` further on: in the next
    slot, or else the first of the nearest later slot that has any.
    """
    by_slot = W.partitionBy(*keys).orderBy("_slot")
    slots = points.groupBy(*keys, "_slot").agg(F.min("_at").alias("_first"))
    one, two = F.lead("_slot", 1).over(by_slot), F.lead("_first", 2).over(by_slot)
    slots = slots.select(
        *keys,
        "_slot",
        F.when(one > F.col("_slot") + 1, F.lead("_first", 1).over(by_slot)).otherwise(two).alias("_beyond"),
    )
    seeks = join_groups(points, slots, [*keys, "_slot"]).select(
        *keys,
        (F.col("_slot") + 1).alias("_slot"),
        (F.col("_at") + max_bytes).alias("_want"),
        F.lit(None).cast("long").alias("_here"),
        F.col("_at").alias("_from"),
        "_beyond",
    )
    none = F.lit(None).cast("long")
    marks = points.select(
        *keys, "_slot", F.col("_at").alias("_want"), F.col("_at").alias("_here"),
        none.alias("_from"), none.alias("_beyond"),
    )
    # Descending, positions before seeks of the same value: the last position
    # seen is the smallest one at or above the value sought.
    down = (
        W.partitionBy(*keys, "_slot")
        .orderBy(F.desc("_want"), F.col("_from").asc_nulls_first())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    found = marks.unionByName(seeks).withColumn("_found", F.last("_here", ignorenulls=True).over(down))
    return found.filter("_from is not null").select(
        *keys, F.col("_from").alias("_at"), F.coalesce("_found", "_beyond").alias("nxt")
    )


def _file_starts(points: DataFrame, keys: list[str], max_bytes: int) -> DataFrame:
    """Positions at which files start, from the distinct byte positions of each group.

    A slot of ``max_bytes`` bytes holds at most one start. Level l joins the
    slots into blocks of 2**l. Its table says, for each position where the
    chain can enter a block, where it leaves the block, and comes from the level
    below by two joins; only positions reached from another block are kept,
    about half as many per level, so all levels together stay within twice the
    input. At the top one block spans the group and is entered at 0. Going
    down again, each level adds the entries of the half blocks.
    """

    def block(at: Column, level: int) -> Column:
        return int_div(at, max_bytes << level)

    table = materialize(_next_starts(points, keys, max_bytes), "file-jumps")
    top = (table.agg(F.max(_slot(F.col("_at"), max_bytes))).first()[0] or 0).bit_length()
    below = []
    for level in range(1, top + 1):
        leaves = block(F.col("nxt"), level) != block(F.col("_at"), level)
        entries = table.filter(leaves).select(*keys, F.col("nxt").alias("_at"))
        entries = entries.unionByName(table.filter("_at = 0").select(*keys, "_at")).distinct()
        second = table.select(*keys, F.col("_at").alias("nxt"), F.col("nxt").alias("_then"))
        stays = block(F.col("nxt"), level) == block(F.col("_at"), level)
        below.append(table)
        table = materialize(
            join_groups(join_groups(entries, table, [*keys, "_at"]), second, [*keys, "nxt"], "left").select(
                *keys, "_at", F.when(stays, F.col("_then")).otherwise(F.col("nxt")).alias("nxt")
            ),
            "file-jumps",
        )
    starts = table.filter("_at = 0").select(*keys, "_at")
    for table in reversed(below):
        starts = materialize(starts, "file-starts")
        onward = join_groups(starts, table, [*keys, "_at"]).filter("nxt is not null")
        starts = starts.unionByName(onward.select(*keys, F.col("nxt").alias("_at"))).distinct()
    return starts.withColumn("_slot", _slot(F.col("_at"), max_bytes))
