"""Policy files: ``rule=value`` lines, a rule may hold one ``*``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed pattern: blank means nothing but characters up to the space.
_BLANK = r"^[\x00-\x20]*\z"


def with_wildcard_parts(df: DataFrame) -> DataFrame:
    """Add ``prefix``/``suffix`` around the first ``*``; both null for an exact rule."""
    star = F.instr("rule", "*")
    rule: Column = F.col("rule")
    return df.withColumn("prefix", F.when(star > 0, F.substring(rule, F.lit(1), star - 1))).withColumn(
        "suffix", F.when(star > 0, F.substring(rule, star + 1, F.length(rule)))
    )


def load_policy(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    """Rules of the policy file(s) under ``path``; the last line of a repeated rule wins.

    The value ends at a second ``=``. A line with no value stops the load, or
    with ``mode="permissive"`` gives a null value.
    """
    line = F.col("line")
    lines = (
        spark.read.text(path)
        .select(
            F.col("value").alias("line"),
            # Line order: within one split the id rises line by line.
            F.struct(
                F.col("_metadata.file_path"),
                F.col("_metadata.file_block_start"),
                F.monotonically_increasing_id().alias("line_no"),
            ).alias("at"),
        )
        .filter(~line.startswith("#") & ~line.rlike(_BLANK))
    )
    has_value = line.rlike("=+[^=]")
    bad = (
        F.raise_error(F.concat(F.lit("policy line without a value: "), line))
        if mode == "failfast"
        else F.lit(None).cast("string")
    )
    parts = F.split(line, "=", -1)
    rules = lines.select(
        F.get(parts, F.lit(0)).alias("rule"), F.when(has_value, F.get(parts, F.lit(1))).otherwise(bad).alias("value"), "at"
    )
    return with_wildcard_parts(rules.groupBy("rule").agg(F.max_by("value", "at").alias("value")))


def policy_frame(spark: SparkSession, rules: dict[str, str]) -> DataFrame:
    """The same rows from a dict."""
    return with_wildcard_parts(spark.createDataFrame(list(rules.items()), "rule string, value string"))
