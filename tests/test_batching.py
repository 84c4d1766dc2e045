import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sluiceway.operators.batching import flush_batches, plan_files, poison_batches
from sluiceway.operators.ordering import running_totals


def brute_files(rows, limit):
    used, no, out = {}, {}, {}
    for ns, ds, shard, seq, n in sorted(rows, key=lambda r: r[3]):
        g = (ns, ds, shard)
        if g not in used:
            used[g], no[g] = 0, 0
        elif limit and used[g] >= limit:
            used[g], no[g] = 0, no[g] + 1
        used[g] += n
        out[g + (seq,)] = no[g]
    return out


SCHEMA = "namespace string, ds string, shard long, seq long, n_bytes long"


@pytest.mark.parametrize("limit", [0, 1, 7, 100, 10_000])
def test_files_equal_an_ordered_pass(spark, limit):
    rng = random.Random(limit)
    sizes = [0, 0, 1, 3, 8, 20, 99, 100, 101, 450]
    # One group holds most rows; seq has gaps; empty records share a position.
    groups = [("hot", "d", 0)] * 8 + [("a", "d", 0), ("a", "e", 1), (None, "d", 0), (None, None, None), ("a", None, 1)]
    rows = [(*rng.choice(groups), seq * 3, rng.choice(sizes)) for seq in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    planned = plan_files(df, limit, order=("seq",), chunk=64)
    got = {(r.namespace, r.ds, r.shard, r.seq): r.file_no for r in planned.collect()}
    assert got == brute_files(rows, limit)


def test_files_of_no_rows(spark):
    assert plan_files(spark.createDataFrame([], SCHEMA), 10, order=("seq",)).count() == 0


def test_null_groups_and_sizes_are_kept(spark):
    rows = [(None, "d", 0, 1, 5), (None, "d", 0, 2, None), ("a", None, 0, 3, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.seq for r in plan_files(df, 5, order=("seq",)).collect()) == [1, 2, 3]
    assert sorted((r.seq, r.batch) for r in flush_batches(df, 1, ("namespace", "ds"), ("seq",)).collect()) == [(1, 0), (2, 1), (3, 0)]


def test_negative_file_limit(spark):
    with pytest.raises(ValueError):
        plan_files(spark.createDataFrame([], SCHEMA), -1)


@pytest.mark.parametrize("chunk", [1, 10, 1 << 20])
def test_running_totals_do_not_depend_on_the_run_length(spark, chunk):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), seq, rng.randint(0, 9)) for seq in range(200)]
    df = spark.createDataFrame(rows, "g string, seq long, n long")
    got = {r.seq: r.before for r in running_totals(df, ["g"], ["seq"], {"before": F.col("n")}, chunk).collect()}
    sums, expected = defaultdict(int), {}
    for g, seq, n in rows:
        expected[seq] = sums[g]
        sums[g] += n
    assert got == expected


def test_flush_batches_count_in_log_order(spark):
    df = spark.range(25).select(F.lit("ns").alias("namespace"), F.lit(0).alias("shard"), F.col("id").alias("seq"), F.lit(0).alias("ord"))
    got = {r.seq: r.batch for r in flush_batches(df, 10, chunk=4).collect()}
    assert got == {i: i // 10 for i in range(25)}


def test_a_bad_record_loses_its_batch(spark):
    # 12 good records; then 2 good, 1 bad, 10 good, in batches of 10 and limit 500
    first = [(0, i, 100) for i in range(12)]
    second = [(1, i, 1000 if i == 2 else 100) for i in range(13)]
    df = spark.createDataFrame(first + second, "shard long, seq long, n_bytes long")
    out = poison_batches(df, 10, 500, order=("seq",), chunk=8)
    kept = [(r.shard, r.seq) for r in out.filter("not lost").collect()]
    assert len([k for k in kept if k[0] == 0]) == 12
    assert sorted(k[1] for k in kept if k[0] == 1) == [10, 11, 12]
    assert len(kept) == 15
