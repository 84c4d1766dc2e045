"""Pairs of rows with the values of both sides, where one side may be in very many pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Pairs of one centre that meet in one task.
SALTED = 256


def with_both(pairs: DataFrame, values: DataFrame, value: str, *, sent: bool = False, led: bool = False) -> DataFrame:
    """(centre, member, first, second): ``pairs`` with ``value`` of ``values`` (id, value) for each end.

    A centre with many members is copied, so that each copy meets a bounded number of them.
    Values that are ``sent`` go to every task instead, and the pairs stay where they are; pairs that are ``led`` go to
    the values, so that only values in a pair are shuffled.
    """
    if sent:
        ends = [F.broadcast(values.select(F.col("id").alias(end), F.col(value).alias(name))) for end, name in (("centre", "first"), ("member", "second"))]
        return pairs.select("centre", "member").join(ends[0], "centre").join(ends[1], "member").select("centre", "member", "first", "second")
    hint = F.broadcast if led else lambda df: df
    degree = pairs.groupBy("centre").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("copies"))
    copies = hint(degree).join(values.withColumnRenamed(value, "first"), F.col("centre") == F.col("id")).select(
        "centre", "first", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    )
    dealt = pairs.join(degree, "centre").select(
        "centre", "member", F.pmod(F.xxhash64("member"), F.col("copies")).cast("int").alias("copy")
    )
    dealt = hint(dealt).join(values.withColumnRenamed(value, "second"), F.col("member") == F.col("id")).drop("id")
    return dealt.join(copies, ["centre", "copy"]).select("centre", "member", "first", "second")
