"""The rolling archive and the ledger against an ordered pass in plain Python."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sluiceway.sinks import ledger, rolling

SCHEMA = "namespace string, id string, ts_ms long, shard long, seq long, ord int, action string, payload binary"
DAY = 86_400_000


def stores(n, seed=1):
    """Two shards and two days, null namespaces too; one group takes most rows."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        group = ("hot", 0, 0) if rng.random() < 0.6 else (rng.choice(["hot", None]), rng.randint(0, 1), rng.randint(0, 1))
        payload = None if rng.random() < 0.05 else bytearray(b"x" * rng.choice([0, 3, 9, 40]))
        rows.append((group[0], f"k{seq % 7}", group[2] * DAY + 5, group[1], seq, 0, rng.choice(["store", "store", "delete"]), payload))
    return rows


def size(row):
    return 0 if row[7] is None else len(row[1]) + len(row[7])


def brute(batches, limit):
    """Records and bytes of each file, by the rule that a full file closes before the next record."""
    state, files = {}, defaultdict(list)
    for rows in batches:
        for r in sorted((r for r in rows if r[6] == "store"), key=lambda r: (r[4], r[5])):
            group = (r[0], f"1970-01-0{1 + r[2] // DAY}", r[3])
            number, held = state.get(group, (0, 0))
            if limit and held >= limit:
                number, held = number + 1, 0
            state[group] = number, held + size(r)
            files[*group, number].append((r[4], size(r)))
    return files


@pytest.mark.parametrize("limit", [0, 60])
def test_files_roll_across_batches(spark, tmp_path, limit):
    rows, path = stores(240), str(tmp_path / "archive")
    batches = [rows[k::3] for k in range(3)]
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SCHEMA)
        rolling.write_rolling(df, path, i, limit)
        if i == 1:  # a batch that is written again
            rolling.write_rolling(df, path, i, limit)
    got = defaultdict(list)
    for r in rolling.read_rolling(spark, path).collect():
        n_bytes = 0 if r.value is None else len(r.key) + len(r.value)
        got[r.namespace, str(r.ds), r.shard, r.file_no].append((r.seq, n_bytes))
    want = brute(batches, limit)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert len(list((tmp_path / "archive" / "open").iterdir())) <= 2


def test_a_batch_without_stores(spark, tmp_path):
    path = str(tmp_path / "archive")
    with pytest.raises(ValueError):
        rolling.read_rolling(spark, path)
    one = [("a", "k", 5, 0, 1, 0, "store", bytearray(b"abc"))]
    for i, rows in enumerate(([], one, [], [r[:4] + (9,) + r[5:] for r in one])):
        rolling.write_rolling(spark.createDataFrame(rows, SCHEMA), path, i, 4)
    assert sorted((r.file_no, r.seq) for r in rolling.read_rolling(spark, path).collect()) == [(0, 1), (1, 9)]


ROWS = "namespace string, shard long, seq long, ord int, id string"


def test_intervals(spark):
    rows = [("a", 0, s, 0, "x") for s in [*range(5, 30), *range(40, 43), 60, 60]] + [("a", 1, 7, 0, "x"), (None, 0, 5, 0, "x"), (None, None, 6, None, "x"), ("a", 0, 5, 1, "x")]
    for chunk in (4, 7, 1000):
        got = ledger.intervals_of(spark.createDataFrame(rows, ROWS), chunk).collect()
        assert {(r.namespace, r.shard, r.ord, r.low, r.high) for r in got} == {
            ("a", 0, 0, 5, 29), ("a", 0, 0, 40, 42), ("a", 0, 0, 60, 60), ("a", 1, 0, 7, 7), (None, 0, 0, 5, 5), (None, None, None, 6, 6), ("a", 0, 1, 5, 5),
        }


@pytest.mark.parametrize("chunk", [8, 1 << 20])
def test_redelivered_in_any_order_reach_no_sink_twice(spark, tmp_path, chunk):
    rng, path = random.Random(2), str(tmp_path / "ledger")
    sent = [(rng.choice(["a", "b", None]), s % 3, s, 0, f"i{s}") for s in range(200)]
    order = sent[:]
    rng.shuffle(order)
    batches = [order[k::4] for k in range(4)]
    for i in range(1, 4):
        batches[i] = batches[i] + rng.sample(order, 60) + batches[i][:5] + [("a", 0, None, 0, "no position")]
    seen = []
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, ROWS)
        fresh = sorted((r.id for r in ledger.drop_redelivered(df, path, i, chunk).collect()))
        ledger.commit_ledger(df, path, i, chunk)
        # The batch again, as after a crash between its sinks and the next offset.
        assert sorted(r.id for r in ledger.drop_redelivered(df, path, i, chunk).collect()) == fresh
        ledger.commit_ledger(df, path, i, chunk)
        seen += [f for f in fresh if f != "no position"]
    assert sorted(seen) == sorted(r[4] for r in sent)


def test_ledger_is_as_large_as_its_gaps(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for i, (low, high) in enumerate([(0, 50_000), (50_000, 120_000), (130_000, 140_000), (120_000, 130_000)]):
        df = spark.range(low, high).select(F.lit("a").alias("namespace"), F.lit(0).cast("long").alias("shard"), F.col("id").alias("seq"), F.lit(0).alias("ord"))
        ledger.commit_ledger(df, path, i, 1 << 14)
        assert ledger.read_ledger(spark, path).count() == (2 if i == 2 else 1)
    assert ledger.read_ledger(spark, path).first()[3:] == (0, 139_999) and len(list((tmp_path / "ledger").iterdir())) == 2


def test_files_far_below_a_megabyte_share_folders(spark, tmp_path):
    """The folders of a batch are as many as its groups, not as its files; those of the default size have their own."""
    rows, path = stores(240), str(tmp_path / "small")
    for i in range(2):
        rolling.write_rolling(spark.createDataFrame(rows[i::2], SCHEMA), path, i, 9)
    files = rolling.read_rolling(spark, path).groupBy(*rolling.GROUP).agg(F.max("file_no").alias("m")).collect()
    assert sum(r.m + 1 for r in files) > 5 * len(files)
    for i in range(2):
        assert len(list((tmp_path / "small" / "files" / f"batch={i}").glob("*/*/*/file_no=*"))) <= len(files)
    large = [("a", "k", 5, 0, s, 0, "store", bytearray(b"x" * (1 << 20))) for s in range(3)]
    rolling.write_rolling(spark.createDataFrame(large, SCHEMA), str(tmp_path / "large"), 0, 1 << 20)
    assert len(list((tmp_path / "large").glob("files/*/*/*/*/file_no=*"))) == 3


def test_a_ledger_of_gaps_is_read_in_order(spark, tmp_path):
    """Every other position of one shard arrives first: each of the rest meets one interval, not all of them."""
    path, n = str(tmp_path / "ledger"), 300_000
    at = F.col("id") % 2 == 0
    place = [F.lit("a").alias("namespace"), F.lit(0).cast("long").alias("shard"), F.col("id").alias("seq"), F.lit(0).alias("ord"), F.col("id").cast("string").alias("id")]
    ledger.commit_ledger(spark.range(n).filter(at).select(*place), path, 0)
    began = time.monotonic()
    assert ledger.drop_redelivered(spark.range(n).select(*place), path, 1).count() == n // 2
    assert time.monotonic() - began < 60
