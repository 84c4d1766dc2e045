"""Quality rules: one table of thresholds compiled into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.llm.text import words_of

# Frequent function words of the languages in view (fixed values).
STOP_WORDS = (
    "the of and to in is that it for on with as by this be are was "
    "de la que el en y los las del se un con para su al "
    "et les des le une du dans est pas par sur au avec qui pour "
    "der die das und ist von mit den ein eine nicht auf zu im für sich dem als"
).split()

# (rule, measure, least, most): a document fails a rule when the measure lies outside.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("too_short", "n_words", 50, None),
    ("repeated_words", "repeat_ratio", None, 0.5),
    ("symbols", "symbol_ratio", None, 0.1),
    ("duplicate_lines", "dup_line_ratio", None, 0.4),
    ("word_length", "mean_word_chars", 2.5, 12),
    ("stop_words", "stop_ratio", 0.01, None),
]

# Bits of a packed window key that hold the position.
POSITION_BITS = 24


def _measures(df: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    stops = "|".join(STOP_WORDS)
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select("*", words_of(text).alias("_words"), lines.alias("_lines"))
    windows = F.transform(
        F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    df = df.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count(body, F.lit(rf"(?i)(?<![^\s])(?:{stops})(?![^\s.,;:!?])")).cast("long").alias("_stops"),
        windows.alias("_windows"),
    ).drop("_words", "_lines")
    return _repeats(df)


def _repeats(df: DataFrame) -> DataFrame:
    """``n_repeat_words``: words inside three-word windows that the text holds more than once.

    Most texts repeat no window, which a set of hashes tells. The others sort
    (hash, position) pairs, packed into one number each while positions fit:
    equal neighbours in that order, compared by their full hashes, repeat.
    """
    mask = (1 << POSITION_BITS) - 1
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    packed = F.transform("_windows", lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
    pairs = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    fits = F.size("_windows") <= mask
    df = df.select(
        "*",
        F.when(repeats & fits, F.sort_array(packed)).alias("_packed"),
        F.when(repeats & ~fits, pairs).alias("_pairs"),
    )

    def at(n: Column) -> Column:
        return n.bitwiseAND(F.lit(mask)).cast("int")

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(
            (F.shiftright(x, POSITION_BITS) == F.shiftright(y, POSITION_BITS))
            & (F.get("_windows", at(x)) == F.get("_windows", at(y))),
            F.lit(False),
        )

    few = F.filter("_packed", lambda x, j: same(x, F.get("_packed", j - 1)) | same(x, F.get("_packed", j + 1)))
    many = F.filter(
        "_pairs",
        lambda x, j: F.coalesce(x["h"] == F.get("_pairs", j - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get("_pairs", j + 1)["h"], F.lit(False)),
    )
    starts = F.coalesce(F.transform(few, at), F.transform(many, lambda x: x["i"]), F.array().cast("array<int>"))
    covered = F.aggregate(
        F.sort_array(starts),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return df.select("*", covered.alias("n_repeat_words")).drop("_windows", "_packed", "_pairs")


def quality_rules(
    docs: DataFrame, *, text: str = "text", id: str = "doc_id", rules: list[tuple[str, str, float | None, float | None]] = RULES
) -> DataFrame:
    """Measures of every whole text, the rules it fails and whether it is kept.

    Returns ``id``, the counts, the ratios, ``failed`` (names of failed rules,
    in table order) and ``kept``. A null text counts as empty; ratios of a text
    without words or lines are 0 (mean word length null, which no rule fails).
    Repeated rows stay repeated rows. Other columns of ``docs`` are not read.
    """
    df = _measures(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), "_text")

    def ratio(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    df = df.select(
        F.col("_id").alias(id),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        "n_repeat_words",
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).alias("mean_word_chars"),
        ratio("_stops", "n_words").alias("stop_ratio"),
    )
    failed = []
    for name, measure, least, most in rules:
        value, out = F.col(measure), F.lit(False)
        if least is not None:
            out = out | (value < least)
        if most is not None:
            out = out | (value > most)
        failed.append(F.when(F.coalesce(out, F.lit(False)), F.lit(name)))
    df = df.select("*", F.filter(F.array(*failed), lambda f: f.isNotNull()).alias("failed"))
    return df.select("*", (F.size("failed") == 0).alias("kept"))
