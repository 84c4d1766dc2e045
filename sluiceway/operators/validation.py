"""Payload validation, operation gate and value size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.operators.pin import pin
from sluiceway.schemas import CREATE_UPDATE, DELETE

DEFAULT_MAX_VALUE = 10_485_760

Validator = tuple[str, Callable[[Column], Column]]


def validate(df: DataFrame, validators: list[Validator] | None, payload: str = "payload") -> DataFrame:
    """Add ``valid`` and ``first_failed`` (name of the first validator that rejects).

    All validators must accept. None given accepts every row, an empty list
    accepts no row.
    """
    if validators is None:
        return df.withColumns({"valid": F.lit(True), "first_failed": F.lit(None).cast("string")})
    if not validators:
        return df.withColumns({"valid": F.lit(False), "first_failed": F.lit("no_validator")})
    failed = None
    for name, test in validators:
        rejects = ~F.coalesce(test(F.col(payload)), F.lit(False))
        failed = F.when(rejects, name) if failed is None else failed.when(rejects, name)
    return df.withColumn("first_failed", failed).withColumn("valid", F.col("first_failed").isNull())


def gate_operations(df: DataFrame, validators: list[Validator] | None = None) -> DataFrame:
    """Add ``action``: store, delete, invalid (payload rejected) or ignored.

    An upsert needs an id and a payload, a delete an id. Payloads are
    validated only where the action is a store. A row that brings a ``reason``
    was refused before: it keeps the reason and is invalid.
    """
    before = F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")
    operation = F.coalesce(F.col("operation"), F.lit(CREATE_UPDATE))
    is_store = before.isNull() & (operation == CREATE_UPDATE) & F.col("id").isNotNull() & F.col("payload").isNotNull()
    checked = validate(
        df.withColumn("_candidate", F.when(is_store, F.col("payload"))), validators, payload="_candidate"
    )
    action = (
        F.when(before.isNotNull(), "invalid")
        .when(is_store, F.when(F.col("valid"), "store").otherwise("invalid"))
        .when((operation == DELETE) & F.col("id").isNotNull(), "delete")
        .otherwise("ignored")
    )
    reason = F.coalesce(before, F.when(is_store & ~F.col("valid"), F.col("first_failed")))
    return pin(checked, {"action": action, "reason": reason}).drop("_candidate", "valid", "first_failed")


def is_oversized(value: Column, limit: int = DEFAULT_MAX_VALUE) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)) > limit


def reject_oversized(df: DataFrame, limit: int = DEFAULT_MAX_VALUE, value: str = "payload") -> DataFrame:
    """Drop rows whose value is larger than ``limit`` bytes; rows without one (deletes) pass."""
    return df.filter(~is_oversized(F.col(value), limit))
