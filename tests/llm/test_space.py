"""What the operators leave on disk, and how many rows their searches make."""

import os

from pyspark.sql import functions as F

from sluiceway.llm import line_dedup, near_dedup, search
from sluiceway.llm.pairs import with_both
from sluiceway.session import materialize, passing, shared_dir


def _tables(spark):
    folder = f"{shared_dir(spark).removeprefix('file://')}/sluiceway-{spark.sparkContext.applicationId}"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("\n").split("\n") if "/shuffle_" in f}


def test_only_what_the_result_reads_stays(spark):
    line = "the {} brown fox jumps over the lazy dog and runs through the wide open field near the old mill"
    docs = spark.createDataFrame([(i, line.format(w) + f"\nown {i * 7919}") for i, w in enumerate(["quick", "quick", "quack", "slow"])], "doc_id long, text string")
    for operator, most in ((line_dedup.dedup_lines, 1), (near_dedup.near_duplicates, 2)):
        before = _tables(spark)
        out = operator(docs)
        assert len(_tables(spark) - before) <= most
        assert out.count() == 4


def test_blocks_keep_what_is_asked_for(spark):
    before = _tables(spark)
    with passing(spark):
        with passing(spark):
            kept = materialize(spark.range(3), "kept", keep=True)
            materialize(spark.range(3), "gone")
        assert {name.split("-")[0] for name in _tables(spark) - before} == {"kept"}
        assert kept.count() == 3
    assert _tables(spark) == before


def test_shuffle_files_go_with_the_write(spark):
    before = _shuffle_files(spark)
    table = materialize(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not _shuffle_files(spark) - before
    assert table.count() == 7


def test_a_pair_is_made_at_its_first_key(spark):
    rows = spark.createDataFrame([(i, [k for k in range(12) if (i + k) % 3 or k > 6]) for i in range(20)], "id long, hs array<bigint>")
    leads, holders = search._unfolded(rows, "_below"), search._unfolded(rows.withColumnRenamed("id", "other"), "_other_below")
    once = leads.join(holders, "h").where((F.col("id") < F.col("other")) & ~F.arrays_overlap("_below", "_other_below"))
    assert once.count() == once.select("id", "other").distinct().count() == 190
    none, parts = spark.createDataFrame([], "centre long, member long"), spark.createDataFrame([], "node long, component long")
    found = search.search_links(rows, rows.withColumnRenamed("id", "other"), none, parts, F.lit(True), lambda pairs: materialize(pairs.where("centre % 2 = member % 2"), "links"))
    assert {(r.node, r.component) for r in found.collect()} == {(i, i % 2) for i in range(20)}


def test_a_clique_is_joined_before_all_its_pairs_are_made(spark):
    n, calls = 300, []
    leads = spark.range(n).select("id", F.lit(1).alias("h"))
    none, parts = spark.createDataFrame([], "centre long, member long"), spark.createDataFrame([], "node long, component long")

    def compare(pairs):
        calls.append(pairs.count())
        return pairs

    found = search.search_links(leads, leads.withColumnRenamed("id", "other"), none, parts, F.lit(True), compare)
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(n)}
    assert sum(calls) < n * (n - 1) // 4


def test_pairs_get_the_same_values_either_way(spark):
    values = spark.range(50).select("id", F.concat(F.lit("v"), "id").alias("v"))
    pairs = spark.createDataFrame([(0, m) for m in range(1, 40)] + [(1, 2), (5, 4)], "centre long, member long")
    want = sorted((c, m, f"v{c}", f"v{m}") for c, m in [(0, m) for m in range(1, 40)] + [(1, 2), (5, 4)])
    for how in ({}, {"sent": True}, {"led": True}):
        assert sorted(map(tuple, with_both(pairs, values, "v", **how).collect())) == want
