"""Namespace fan-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

Writer = Callable[[DataFrame, int], None]


def route(df: DataFrame, routes: dict[str, str]) -> DataFrame:
    """Add ``route``: the name of the first pattern that matches the whole namespace, else null."""
    target = F.lit(None).cast("string")
    for pattern, name in reversed(routes.items()):
        matches = F.col("namespace").rlike(f"^(?:{pattern})" + r"\z")
        target = F.when(matches, F.lit(name)).otherwise(target)
    return df.withColumn("route", target)


def check_routes(routes: dict[str, str], writers: dict[str, Writer]) -> None:
    """Fail before any row is read where a route names no writer."""
    unknown = sorted(set(routes.values()) - set(writers))
    if unknown:
        raise ValueError(f"no writer for route {', '.join(unknown)}")


def write_routed(routed: DataFrame, writers: dict[str, Writer], batch_id: int) -> None:
    """Hand each writer the rows of its route. Persist ``routed`` first: each writer scans it."""
    for name, write in writers.items():
        write(routed.filter(F.col("route") == name), batch_id)
