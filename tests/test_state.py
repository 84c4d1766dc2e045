import random

import pytest
from pyspark.sql import functions as F

from sluiceway.operators import state
from sluiceway.sinks import batches, state_table
from sluiceway.streaming.state import keyed_state_stream

SCHEMA = "namespace string, id string, ts_ms long, seq long, ord int, action string, payload binary, shard long"
H = 100


def actions(n=400, seed=3):
    """One id takes a third of all rows; times tie and run out of order."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        doc = "a0" if rng.random() < 0.34 else rng.choice(["b0", "c1", "d2", "e3"]) + str(rng.randint(0, 20))
        kind = rng.choice(["store", "store", "store", "delete", "ignored", "invalid"])
        rows.append(("ns", doc, rng.randint(0, 2000), seq, 0, kind, bytearray(str(seq).encode()), seq % 3))
    return rows


def brute(rows, horizon):
    puts, dels = {}, {}
    for ns, doc, ts, seq, ord_, kind, payload, _ in rows:
        if kind == "store" and (doc not in puts or (ts, seq, ord_) > puts[doc][:3]):
            puts[doc] = (ts, seq, ord_, bytes(payload))
        if kind == "delete":
            dels[doc] = max(ts, dels.get(doc, ts))
    return {d: (p[0], p[3]) for d, p in puts.items() if d not in dels or p[0] > dels[d] + horizon}


def rows_of(df):
    return {r.id: (r.ts_ms, bytes(r.payload)) for r in df.collect()}


@pytest.mark.parametrize("horizon", [0, H, state.HORIZON_MS])
def test_state_equals_brute_force(spark, horizon):
    rows = actions()
    got = rows_of(state.keyed_state(spark.createDataFrame(rows, SCHEMA), horizon))
    assert got == brute(rows, horizon)


def test_a_delete_wins_a_tie(spark):
    rows = [("ns", "a", 5, 1, 0, "delete", None, 0), ("ns", "a", 5, 2, 0, "store", bytearray(b"x"), 0)]
    assert state.keyed_state(spark.createDataFrame(rows, SCHEMA), 0).count() == 0


def test_dropped_versions(spark):
    rows = actions()
    df = spark.createDataFrame(rows, SCHEMA)
    dels = [(r[1], r[2]) for r in rows if r[5] == "delete"]
    expected = sorted(
        r[3] for r in rows if r[5] == "store" and not any(d == r[1] and r[2] <= t + H for d, t in dels)
    )
    assert sorted(r.seq for r in state.drop_deleted(df, H).collect()) == expected


def test_no_store_is_lost(spark):
    """Untimed stores rank lowest and any delete hides them; shards break ties; salted, they keep their raw id."""
    b = bytearray(b"x")
    rows = [
        ("ns", "aa", None, 1, 0, "store", b, 0), ("ns", "ab", None, 1, 0, "store", b, 0), ("ns", "ab", 5, 1, 0, "store", b, 0),
        ("ns", "ac", None, 1, 0, "store", b, 0), ("ns", "ac", 1, 2, 0, "delete", None, 0),
        ("ns", "ad", 5, 1, 0, "store", b, 0), ("ns", "ad", 5, 1, 0, "store", bytearray(b"y"), 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: (r.ts_ms, bytes(r.payload)) for r in state.keyed_state(df, 0).collect()}
    assert got == {"aa": (None, b"x"), "ab": (5, b"x"), "ad": (5, b"y")}
    keyed = state.keyed_state(df, 0, "salted").collect()
    assert len(keyed) == 5 and bytes(next(r.row_key for r in keyed if r.id == "aa")) == b"aa"


def test_compaction_forgets_deleted_payloads_and_spent_deletes(spark, tmp_path):
    path, day = str(tmp_path / "state"), 86_400_000
    rows = [
        ("ns", "gone", 1, 1, 0, "store", bytearray(b"secret"), 0), ("ns", "gone", 2, 2, 0, "delete", None, 0),
        ("ns", "here", 30 * day, 3, 0, "store", bytearray(b"kept"), 0), ("ns", "late", 29 * day, 4, 0, "delete", None, 0),
    ]
    state_table.upsert_state(spark.createDataFrame(rows, SCHEMA), path, 0)
    state_table.compact_state(spark, path, lateness_ms=day)
    base = spark.read.parquet(f"{path}/segments/segment={state_table.segments(spark, path)[0].segment}")
    assert sorted((r.id, r.payload and bytes(r.payload), r.del_ms, r.deleted) for r in base.collect()) == [
        ("gone", None, None, True), ("here", b"kept", None, False), ("late", None, 29 * day, True),
    ]
    assert [r.id for r in state_table.read_state(spark, path).collect()] == ["here"]


def test_compaction_keeps_deletes_of_untimed_puts(spark, tmp_path):
    """An untimed put stays hidden by a delete whose time is forgotten, with or without compaction."""
    day = 86_400_000
    first = [("ns", "a", 1, 1, 0, "delete", None, 0), ("ns", "b", 40 * day, 2, 0, "store", bytearray(b"b"), 0)]
    then = [("ns", "a", None, 3, 0, "store", bytearray(b"a"), 0), ("ns", "c", None, 4, 0, "store", bytearray(b"c"), 0)]
    for compact in (False, True):
        path = str(tmp_path / f"state{compact}")
        state_table.upsert_state(spark.createDataFrame(first, SCHEMA), path, 0)
        if compact:
            state_table.compact_state(spark, path, lateness_ms=day)
        state_table.upsert_state(spark.createDataFrame(then, SCHEMA), path, 1)
        assert sorted(r.id for r in state_table.read_state(spark, path).collect()) == ["b", "c"]


def test_segments_merge_by_tiers_and_retire(spark, tmp_path):
    rows, path = actions(420), str(tmp_path / "state")
    for i in range(10):
        state_table.upsert_state(spark.createDataFrame(rows[i::10], SCHEMA), path, i, buckets=8, fanout=3)
        assert rows_of(state_table.read_state(spark, path, H)) == brute([r for k in range(i + 1) for r in rows[k::10]], H)
    assert [s.tier for s in state_table.segments(spark, path)] == [2, 0]
    # Only segments of the last two manifests are left, however many batches there were.
    assert len(list((tmp_path / "state" / "segments").iterdir())) <= 4 and len(list((tmp_path / "state" / "manifest").iterdir())) <= 2


def test_point_reads_touch_one_bucket(spark, tmp_path):
    rows, path = actions(), str(tmp_path / "state")
    for i in range(3):
        state_table.upsert_state(spark.createDataFrame(rows[i::3], SCHEMA), path, i, buckets=16)
    whole, want = state_table.read_state(spark, path, H), brute(rows, H)
    for doc in ("a0", "b01", "c11", "nowhere"):
        one = state_table.read_id(spark, path, "ns", doc, H)
        assert rows_of(one) == {d: v for d, v in want.items() if d == doc}
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan
    folders = {f.split("bucket=")[1].split("/")[0] for f in whole.inputFiles()}
    assert len(folders) > 8
    # A small batch writes only its keys' buckets.
    state_table.upsert_state(spark.createDataFrame(rows[:1], SCHEMA), path, 3, buckets=16, fanout=9)
    last = state_table.segments(spark, path)[-1].segment
    assert len([f for f in (tmp_path / "state" / "segments" / f"segment={last}").iterdir() if f.name.startswith("bucket=")]) <= 1


def test_deletes_reach_salted_rows_on_files(spark, tmp_path):
    day, path = 86_400_000, str(tmp_path / "state")
    steps = [
        [("ns", "ab", 1, 1, 0, "store", bytearray(b"1"), 0), ("ns", "ab", 9 * day, 2, 0, "store", bytearray(b"2"), 0)],
        [("ns", "ab", 5, 3, 0, "delete", None, 0), ("ns", "zz", 1, 4, 0, "store", bytearray(b"3"), 0), (None, "ad", 1, 5, 0, "store", bytearray(b"4"), 0)],
        [(None, "ad", 2, 6, 0, "delete", None, 0), (None, "ae", 1, 7, 0, "store", bytearray(b"5"), 0)],
    ]
    for i, part in enumerate(steps):
        state_table.upsert_state(spark.createDataFrame(part, SCHEMA), path, i, "salted")
    for again in (False, True):
        read = lambda **o: sorted(r.seq for r in state_table.read_state(spark, path, key_mode="salted", **o).collect())
        assert read() == [1, 2, 5, 7] and read(fix_deletes=True) == [2, 7]
        df = spark.createDataFrame(sum(steps, []), SCHEMA)
        assert read(fix_deletes=True) == sorted(r.seq for r in state.keyed_state(df, key_mode="salted", fix_deletes=True).collect())
        assert [r.seq for r in state_table.read_id(spark, path, "ns", "ab", key_mode="salted", fix_deletes=True).collect()] == [2]
        if not again:
            state_table.compact_state(spark, path, key_mode="salted")


def test_deletes_hide_null_namespaces_too(spark):
    b = bytearray(b"x")
    rows = [(None, "a", 1, 1, 0, "store", b, 0), (None, "a", 2, 2, 0, "delete", None, 0), (None, "b", 1, 3, 0, "store", b, 0), ("ns", "a", 1, 4, 0, "store", b, 0), ("ns", "a", None, 5, 0, "delete", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.seq for r in state.drop_deleted(df, H).collect()) == [3, 4] == sorted(r.seq for r in state.keyed_state(df, H).collect())


def test_salted_rows_escape_deletes_unless_fixed(spark):
    day = 86_400_000
    rows = [
        ("ns", "ab", 1, 1, 0, "store", bytearray(b"1"), 0),
        ("ns", "ab", 2 * day, 2, 0, "store", bytearray(b"2"), 0),
        ("ns", "ab", 5, 3, 0, "delete", None, 0),
        ("ns", "zz", 1, 4, 0, "store", bytearray(b"3"), 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.seq for r in state.keyed_state(df, 0, "salted").collect()) == [1, 2]
    assert [r.seq for r in state.keyed_state(df, 0, "salted", fix_deletes=True).collect()] == [2]
    assert [r.seq for r in state.with_row_keys(df).filter("reason = 'unsaltable'").collect()] == [4]
    with pytest.raises(ValueError):
        state.keyed_state(df, key_mode="other")


def test_upserts_in_any_order_repeated_and_compacted(spark, tmp_path):
    rows = actions()
    path = str(tmp_path / "state")
    parts = [spark.createDataFrame(rows[i::4], SCHEMA) for i in (2, 0, 3, 1)]
    with pytest.raises(ValueError):
        state_table.read_state(spark, path)
    for i, part in enumerate(parts[:2]):
        state_table.upsert_state(part, path, i)
    state_table.compact_state(spark, path, H)
    state_table.upsert_state(parts[1], path, 1)  # a repeated batch
    for i, part in enumerate(parts[2:], 2):
        state_table.upsert_state(part, path, i)
    assert rows_of(state_table.read_state(spark, path, H)) == brute(rows, H)
    state_table.compact_state(spark, path, H)
    state_table.compact_state(spark, path, H)
    assert [s.last_batch for s in state_table.segments(spark, path)] == [3]
    assert rows_of(state_table.read_state(spark, path, H)) == brute(rows, H)


def test_unfinished_batches_are_not_read(spark, tmp_path):
    path = str(tmp_path / "b")
    batches.write_batch(spark.range(3), path, 7)
    (tmp_path / "b" / "batch=8").mkdir()
    assert batches.committed_batches(spark, path) == [7]
    assert batches.read_batches(spark, path).count() == 3
    assert batches.read_batches(spark, path, after=7) is None


def run(stream, out, progress):
    q = (
        stream.writeStream.outputMode("update")
        .foreachBatch(lambda df, i: batches.write_batch(df, out, i))
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


@pytest.mark.parametrize("lateness", [None, "3650 days"])
def test_stream_equals_batch_across_a_restart(spark, tmp_path, lateness):
    """Files in shuffled time order, the query stopped and resumed in between."""
    rows = actions(240)
    src, out, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))

    def stream():
        df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        return keyed_state_stream(df, H, lateness)

    for i in (2, 0):
        spark.createDataFrame(rows[i::4], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run(stream(), out, progress)
    for i in (3, 1):
        spark.createDataFrame(rows[i::4], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run(stream(), out, progress)
    live = batches.latest_updates(spark, out, ["namespace", "id"]).filter("alive")
    got = rows_of(live.select("id", F.col("put_ms").alias("ts_ms"), "payload"))
    assert got == brute(rows, H)
    if lateness:
        done = batches.read_batches(spark, out).groupBy("reason").agg(F.sum("n").alias("n")).collect()
        assert [(r.reason, r.n) for r in done] == [(None, sum(r[5] in ("store", "delete") for r in rows))]


def test_tombstones_expire(spark, tmp_path):
    """Once the watermark passes D + horizon, the tombstone leaves the state."""
    src, out, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))
    steps = [
        [("ns", "a", 1_000, 1, 0, "delete", None, 0)],
        [("ns", "b", 50_000, 2, 0, "store", bytearray(b"x"), 0)],
        [("ns", "b", 60_000, 3, 0, "store", bytearray(b"y"), 0)],
        [("ns", "a", 60_001, 4, 0, "store", bytearray(b"z"), 0)],
    ]
    for rows in steps:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        run(keyed_state_stream(df, H, "1 second"), out, progress)
    latest = {r.id: r for r in batches.latest_updates(spark, out, ["namespace", "id"]).collect()}
    assert latest["a"].alive and latest["a"].del_ms is None
    assert bytes(latest["b"].payload) == b"y"


def test_untimed_rows_in_an_expiring_stream(spark, tmp_path):
    """Stores without a time equal the batch, whatever the watermark; a third of all rows have none."""
    src, out, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))
    rows = [r[:2] + (None if r[3] % 3 == 0 else r[2],) + r[3:] for r in actions(240)]
    rows += [("ns", "gone", 1, 900, 0, "delete", None, 0), ("ns", "only", None, 901, 0, "store", None, 0)]
    late = [("ns", "new", None, 1_002, 0, "store", bytearray(b"n"), 0), ("ns", "gone", None, 1_003, 0, "store", bytearray(b"g"), 0), ("ns", "only", None, 1_004, 0, "delete", None, 0)]
    steps = [rows, [("ns", "z", 50_000, 1_000, 0, "store", bytearray(b"z"), 0)], [("ns", "z", 60_000, 1_001, 0, "store", bytearray(b"y"), 0)], late]
    for part in steps:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        run(keyed_state_stream(df, H, "1 second"), out, progress)
    live = batches.latest_updates(spark, out, ["namespace", "id"]).filter("alive")
    seen = lambda df, ms: sorted((r.id, r[ms] or 0, r[ms] is None, r.payload and bytes(r.payload)) for r in df.collect())
    want = state.keyed_state(spark.createDataFrame(sum(steps, []), SCHEMA), H)
    got = seen(live, "put_ms")
    assert got == seen(want, "ts_ms") and any(untimed for _, _, untimed, _ in got)
    assert {"new", "only"} <= {g[0] for g in got} and "gone" not in {g[0] for g in got}


def test_late_rows_come_out_with_a_reason(spark, tmp_path):
    """Rows behind the watermark change nothing and are counted, the others are applied; none goes missing."""
    src, out, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))
    steps = [
        [("ns", "a", 1_000, 1, 0, "store", bytearray(b"1"), 0), ("ns", "b", 50_000, 2, 0, "store", bytearray(b"2"), 0)],
        [("ns", "b", 60_000, 3, 0, "store", bytearray(b"3"), 0)],
        [("ns", "a", 2_000, 4, 0, "store", bytearray(b"4"), 0), ("ns", "a", 3_000, 5, 0, "delete", None, 0), ("ns", "c", 9_000, 6, 0, "store", bytearray(b"6"), 0), ("ns", "c", None, 7, 0, "store", bytearray(b"7"), 0), ("ns", "c", 59_500, 8, 0, "store", bytearray(b"8"), 0)],
    ]
    for rows in steps:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        run(keyed_state_stream(df, H, "1 second"), out, progress)
    rows = batches.read_batches(spark, out)
    late = {(r.id, r.put_ms, r.del_ms, r.n) for r in rows.filter("reason = 'late'").collect()}
    assert late == {("a", 2_000, None, 1), ("a", None, 3_000, 1), ("c", 9_000, None, 1)} or late == {("a", 2_000, None, 1), ("a", None, 3_000, 1)}
    assert rows.agg(F.sum("n")).first()[0] == 8
    assert rows_of(batches.latest_updates(spark, out, ["namespace", "id"]).filter("alive").select("id", F.col("put_ms").alias("ts_ms"), "payload")) == {
        "a": (1_000, b"1"), "b": (60_000, b"3"), "c": (59_500, b"8"),
    }
