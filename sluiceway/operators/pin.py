"""Columns that are evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pin(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add ``columns``, keeping later filters on them above their evaluation.

    Catalyst pushes a filter below a projection by copying the projected
    expression into it, once per mention. For a parsed or validated column that
    repeats the costly part, and large expressions outgrow code generation. A
    generator with exactly one output row is not crossed by such filters.
    """
    one_row = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(one_row))
