"""Counters, rates and distribution reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sluiceway.operators.admission import body_size, is_handled
from sluiceway.operators.validation import DEFAULT_MAX_VALUE, is_oversized
from sluiceway.session import materialize

QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def request_counts(classified: DataFrame) -> DataFrame:
    """(namespace, method, outcome, handled, root, n, n_bytes): what the request and response reports add up.

    ``handled`` rows have reached the submission step, which alone knows the
    namespace; ``root`` requests are answered without being counted.
    """
    n_bytes = F.when(F.col("method") == "DELETE", F.lit(0)).otherwise(body_size(F.col("body")))
    root = (F.col("outcome") == 200) & F.col("uri").isin("/", "")
    return classified.groupBy(
        "namespace", "method", "outcome", is_handled().alias("handled"), F.coalesce(root, F.lit(False)).alias("root")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(n_bytes).cast("long").alias("n_bytes"))


def request_report(counts: DataFrame) -> DataFrame:
    """Requests and body bytes per (namespace, method), namespace, method and overall, from ``request_counts``.

    ``level`` tells the totals apart (bit 2: namespace rolled up, bit 1: method).
    """
    sets = [[F.col("namespace"), F.col("method")], [F.col("namespace")], [F.col("method")], []]
    return counts.filter("handled").groupingSets(sets, F.col("namespace"), F.col("method")).agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("n").alias("n"),
        F.sum("n_bytes").cast("long").alias("n_bytes"),
    )


def response_report(counts: DataFrame) -> DataFrame:
    """Responses per namespace and code, and per code overall (``is_total``), from ``request_counts``.

    Earlier rejections than the submission step's count in the totals alone.
    """
    base = counts.filter("not root").select(F.when(F.col("handled"), F.col("namespace")).alias("namespace"), "outcome", "n")
    sets = [[F.col("namespace"), F.col("outcome")], [F.col("outcome")]]
    out = base.groupingSets(sets, F.col("namespace"), F.col("outcome")).agg(
        (F.grouping("namespace") == 1).alias("is_total"), F.sum("n").alias("n")
    )
    return out.filter("is_total or namespace is not null")


def request_metrics(classified: DataFrame) -> DataFrame:
    """``request_report`` of a table; the input is grouped once, the totals add up that small result."""
    return request_report(request_counts(classified))


def response_counts(classified: DataFrame) -> DataFrame:
    """``response_report`` of a table."""
    return response_report(request_counts(classified))


def message_counts(gated: DataFrame, limit: int = DEFAULT_MAX_VALUE) -> DataFrame:
    """(namespace, action, big, n, n_bytes): what the consumer and sink reports add up; ``big`` stores are oversized."""
    big = F.coalesce((F.col("action") == "store") & is_oversized(F.col("payload"), limit), F.lit(False))
    return gated.groupBy("namespace", "action", big.alias("big")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("long").alias("n_bytes")
    )


def _sum_of(which: Column) -> Column:
    return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))


def consumer_report(counts: DataFrame) -> DataFrame:
    """Messages consumed per topic, and how many of them were invalid, from ``message_counts``."""
    return counts.groupBy(F.col("namespace").alias("topic")).agg(
        F.sum("n").alias("consumed"), _sum_of(F.col("action") == "invalid").alias("invalid")
    )


def sink_report(counts: DataFrame) -> DataFrame:
    """Per namespace: rows stored, deleted, dropped as oversized and refused, from ``message_counts``."""
    store = F.col("action") == "store"
    return counts.groupBy("namespace").agg(
        _sum_of(store & ~F.col("big")).alias("stored"),
        _sum_of(F.col("action") == "delete").alias("deleted"),
        _sum_of(store & F.col("big")).alias("oversized"),
        _sum_of(F.col("action") == "invalid").alias("failed"),
    )


def consumer_metrics(gated: DataFrame, topic: str = "namespace") -> DataFrame:
    """Messages consumed per topic, and how many of them were invalid."""
    return gated.groupBy(F.col(topic).alias("topic")).agg(
        F.count(F.lit(1)).alias("consumed"), F.count_if(F.col("action") == "invalid").alias("invalid")
    )


def sink_metrics(gated: DataFrame, limit: int = DEFAULT_MAX_VALUE) -> DataFrame:
    """``sink_report`` of a table."""
    return sink_report(message_counts(gated, limit))


def rate_series(df: DataFrame, seconds: int = 60, ts_ms: str = "ts_ms", n_bytes: str = "n_bytes") -> DataFrame:
    """Records and bytes per namespace and time bucket, with per-second rates."""
    bucket = F.col(ts_ms) - F.pmod(F.col(ts_ms), F.lit(seconds * 1000))
    out = df.groupBy("namespace", bucket.alias("bucket_ms")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(n_bytes), F.lit(0)).alias("n_bytes")
    )
    return out.withColumns({"n_per_sec": F.col("n") / seconds, "bytes_per_sec": F.col("n_bytes") / seconds})


def frequency(df: DataFrame, code: str) -> DataFrame:
    return df.groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def latency_report(df: DataFrame, value: str) -> DataFrame:
    """One row: n, min, mean, max, population stddev and exact interpolated quantiles.

    A quantile is the value at its rank, found by ``order_statistics``, or lies
    between the two values around it. Runs jobs while the plan is built.
    """
    x = F.col(value).cast("double")
    stats = df.agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"), F.stddev_pop(x).alias("stddev")
    )
    n = df.agg(F.count(x)).first()[0]
    positions = {f"p{round(q * 100)}": q * max(0, n - 1) for q in QUANTILES}
    wanted = sorted({int(p) + d for p in positions.values() for d in (0, 1)})
    ranked = order_statistics(df.select(x.alias("value")), wanted)
    at = {r["rank"]: r["value"] for r in ranked.collect()}  # two values per quantile

    def between(position: float) -> float | None:
        low, part = at.get(int(position)), position - int(position)
        high = at.get(int(position) + 1, low)
        return low if low == high or not part else low + part * (high - low)

    return stats.select("*", *[F.lit(between(p)).cast("double").alias(c) for c, p in positions.items()])


def order_statistics(values: DataFrame, ranks: list[int]) -> DataFrame:
    """The ``value`` at each 0-based rank of the sorted column, for any number of values.

    Values are counted first, so repeats collapse before the sort; the counts
    are range-partitioned, and only partitions that hold a wanted rank are
    ordered, each by itself.
    """
    counts = values.filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    # Written once: a second evaluation could draw other range bounds.
    parts = materialize(
        counts.repartitionByRange("value").select("value", "n", F.spark_partition_id().alias("part")),
        "value-ranges",
    )
    # One row per range partition, so the window and the broadcast are as small
    # as the shuffle is wide.
    sizes = parts.groupBy("part").agg(F.sum("n").alias("size"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    wanted = F.array(*[F.lit(r).cast("long") for r in ranks])
    start, end = F.col("start"), F.col("start") + F.col("size")
    hit = F.filter(wanted, lambda r: (r >= start) & (r < end))
    sizes = sizes.withColumn("ranks", hit).filter(F.size("ranks") > 0).select("part", "start", "ranks")
    inside = W.partitionBy("part").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = parts.join(F.broadcast(sizes), "part").withColumn("upto", F.col("start") + F.sum("n").over(inside))
    mine = F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    return ordered.select(F.explode(mine).alias("rank"), "value")
