"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Words are maximal runs without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column | str) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), F.lit(WORD), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names, as asked for or with underscores before, that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
