"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
import public_tokenizers
from sluiceway.llm import alignment, best_fit, decontaminate, html_diff, licences, line_dedup, near_dedup
from sluiceway.llm import quality, sharding, toxicity, url_filter, whitening
from sluiceway.llm.oracles import ORACLES
from sluiceway.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "weight", "clauses")


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_diff.extract_text(table(spark, sf_dir, "pages"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in packed sequences."""
    return corpus_pipeline.pack(spark, table(spark, sf_dir, "documents"), sf_dir)


@query
def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return licences.licence_scan(table(spark, sf_dir, "documents")).drop("matches")


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines that stay."""
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "text", "n_lines", "n_removed", "n_chars_left", "n_chars_lines", (~line_dedup.used_up()).alias("kept")
    )


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document holds a benchmark item, and which."""
    docs = table(spark, sf_dir, "documents")
    leaks = decontaminate.benchmark_leaks(docs, table(spark, sf_dir, "benchmark"))
    held = leaks.groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.max("share").alias("overlap"), F.array_sort(F.collect_list("item_id")).alias("item_ids")
    )
    held = held.withColumnRenamed("doc_id", "held")
    return docs.select("doc_id").join(held, F.col("doc_id").eqNullSafe(F.col("held")), "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.col("n_items").isNull().alias("kept"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("overlap", F.lit(0.0)).alias("overlap"),
        F.coalesce(F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ","), F.lit("")).alias("item_ids"),
    )


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    judged = quality.quality_rules(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *counts, base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document, and its shard were there one more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.shard_of(F.col("doc_id"), 9).alias("grown_shard"),
    )


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the leading components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between both tokenizers' tokens of every document, and how frequent they are."""
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = alignment.align(table(spark, sf_dir, "documents"), a, b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    slim = aligned.select("doc_id", "n_a", "n_b", "n_links", digest.alias("groups_sha256"), "pairs", "times")
    counts = ["doc_id", "n_a", "n_b", "n_links", "groups_sha256"]
    scored = alignment.score_links(materialize(slim, "aligned", compression="zstd"), counts)
    return scored.withColumn("n_groups", F.col("n_links"))


@query
def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in few sequences."""
    pieces = best_fit.pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through all stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
