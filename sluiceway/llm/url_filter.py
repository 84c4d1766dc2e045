"""URL filters: rules where they fit, gradient-boosted trees on lexical features elsewhere."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

# (verdict, host, path start)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Words in a host that label a URL for blocking where no rule does.
BLOCK_TERMS = ["casino", "bets", "pills", "ads", "track"]
# At most so many labelled URLs are fitted on, those with the smallest digests.
TRAIN_ROWS = 20_000
FEATURES = [
    "url_chars", "host_chars", "path_chars", "host_labels", "host_hyphens", "depth", "digit_ratio", "entropy",
    "parameters", "parameter_chars", "fragment", "secure", "suffix_rate", "suffix_share",
]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to a slash, question or number sign, and on to the latter two.

    Both are empty for null and where there is no ``://``.
    """
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of equally long ones the first in the table.

    A rule fits its host and all subdomains where the path starts with the rule's.
    """
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = None
    for verdict, name, start in ranked:
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for the empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    # Runs in the sorted characters are the counts.
    counts = F.aggregate(
        F.array_sort(chars),
        F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total")),
        lambda a, c: F.when(a["last"] == c, F.struct(c.alias("last"), (a["run"] + 1.0).alias("run"), a["total"].alias("total"))).otherwise(
            F.struct(c.alias("last"), F.lit(1.0).alias("run"), (a["total"] + _xlogx(a["run"])).alias("total"))
        ),
        lambda a: a["total"] + _xlogx(a["run"]),
    )
    return F.greatest(F.log2(n) - counts / n, F.lit(0.0))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def _lexical(df: DataFrame, url: str) -> DataFrame:
    """``df`` with host, path, matched rule, suffix and the features of the URL text."""
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = split_url(F.col(url))
    df = df.select("*", host.alias("_host"), path.alias("_path"))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.length(text), F.lit(1))
    return df.select(
        "*",
        matching_rule(F.col("_host"), F.col("_path")).alias("_found"),
        F.substring_index("_host", ".", -1).alias("_suffix"),
        F.length(text).cast("double").alias("url_chars"),
        F.length("_host").cast("double").alias("host_chars"),
        F.length("_path").cast("double").alias("path_chars"),
        F.regexp_count("_host", F.lit(r"\.")).cast("double").alias("host_labels"),
        F.regexp_count("_host", F.lit("-")).cast("double").alias("host_hyphens"),
        F.regexp_count("_path", F.lit("/")).cast("double").alias("depth"),
        (F.regexp_count(text, F.lit("[0-9]")) / n).alias("digit_ratio"),
        _entropy(text).alias("entropy"),
        F.regexp_count(query, F.lit("[^&=]+=")).cast("double").alias("parameters"),
        F.length(query).cast("double").alias("parameter_chars"),
        F.contains(text, F.lit("#")).cast("double").alias("fragment"),
        text.startswith("https://").cast("double").alias("secure"),
    )


def rule_labels(df: DataFrame, terms: list[str] = BLOCK_TERMS) -> Column:
    """1 (block), 0 (allow) or null: by the rule that fits, else block for a term in the host."""
    verdict = F.col("_found")["verdict"]
    term = F.col("_host").rlike(rf"(?:^|[.-])(?:{'|'.join(terms)})(?:[.-]|$)")
    return F.when(verdict.isNotNull(), (verdict == "block").cast("double")).when(term, F.lit(1.0))


def url_filter(
    pages: DataFrame,
    *,
    id: str = "page_id",
    url: str = "url",
    rules: list[tuple[str, str, str]] = RULES,
    labels=rule_labels,
    train_rows: int = TRAIN_ROWS,
    trees: int = 8,
    depth: int = 3,
    seed: int = 0,
) -> DataFrame:
    """A verdict for every URL: the longest rule's, else that of boosted trees.

    The trees see lexical features and statistics of the host's last label:
    its smoothed share of blocked URLs among the labelled ones and its share of
    all URLs, both counted over the whole table. ``labels(df)`` gives the label
    of a training URL or null; at most ``train_rows`` of the distinct labelled
    URLs, those with the smallest digests, are fitted on. Without URLs of both
    labels nothing is fitted and the score is 0.

    Returns ``id``, host, path, rule (null without one), score (0 to 1, higher:
    block) and verdict. A null URL has empty host and path. Repeated rows are
    kept and agree.
    """
    source = pages.select(F.col(id).alias("_id"), F.col(url).cast("string").alias("_url"))
    df = _lexical(source, "_url")
    if rules is not RULES:
        df = df.withColumn("_found", matching_rule(F.col("_host"), F.col("_path"), rules))
    df = df.select("*", labels(df).alias("_label"))
    # One row per suffix, then one per labelled suffix class: joined, not broadcast.
    total = df.agg(F.count("*").alias("_all"))
    suffixes = df.groupBy("_suffix").agg(
        F.count("*").alias("_n"), F.count("_label").alias("_labelled"), F.sum("_label").alias("_blocked")
    )
    suffixes = suffixes.select(
        "_suffix",
        ((F.coalesce("_blocked", F.lit(0.0)) + 1) / (F.col("_labelled") + 2)).alias("suffix_rate"),
        (F.col("_n") / F.lit(float(max(1, total.first()["_all"])))).alias("suffix_share"),
    )
    df = df.join(suffixes, "_suffix")
    train = (
        df.where(F.col("_label").isNotNull())
        .select("_url", "_label", *FEATURES)
        .dropDuplicates(["_url"])
        .orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "_url")), "_url")
        .limit(train_rows)
    )
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    fitted = None
    rows = assembler.transform(train).select("_features", "_label").cache()
    if rows.select("_label").distinct().count() == 2:
        trainer = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=depth, maxBins=32, seed=seed)
        fitted = trainer.fit(rows)
    rows.unpersist()
    if fitted is None:
        scored = df.select("*", F.lit(0.0).alias("score"))
    else:
        scored = fitted.transform(assembler.transform(df)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("_found")["verdict"], F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(
        F.col("_id").alias(id),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_found")["rule"].alias("rule"),
        "score",
        verdict.alias("verdict"),
    )
