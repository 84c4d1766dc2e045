"""Exact running totals in log order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Log positions per sorted run. ``order[0]`` is an integer position that few
# rows share, so no window below sorts more than about this many rows.
CHUNK = 1 << 20


def int_div(number: Column, by: int) -> Column:
    """Whole quotient of a non-negative integer, also above 2**53 / ``by``."""
    return ((number - F.pmod(number, F.lit(by))) / by).cast("long")


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null meeting null; other columns must differ. The keys come once."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def running_totals(
    df: DataFrame, group: list[str], order: list[str], totals: dict[str, Column], chunk: int = CHUNK
) -> DataFrame:
    """Add, per entry of ``totals``, its sum over the rows before this one in its group.

    A window over a whole group would sort a hot group in one task. Rows are
    numbered inside runs of ``chunk`` log positions instead; the totals of the
    runs, one row each, are summed over the earlier runs and joined back. Null
    is a group like any other, and a null amount counts as 0.
    """
    runs = df.withColumn("_run", int_div(F.col(order[0]), chunk))
    keys = [*group, "_run"]
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*group).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    per_run = runs.groupBy(*keys).agg(*[F.coalesce(F.sum(c.cast("long")), zero).alias(f"_{n}") for n, c in totals.items()])
    offsets = per_run.select(
        *keys, *[F.coalesce(F.sum(f"_{n}").over(earlier), zero).alias(f"_before_{n}") for n in totals]
    )
    local = runs.select("*", *[F.coalesce(F.sum(c.cast("long")).over(inside), zero).alias(f"_in_{n}") for n, c in totals.items()])
    return join_groups(local, offsets, keys).select(
        *df.columns, *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(n) for n in totals]
    )
