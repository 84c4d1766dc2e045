import json
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sluiceway.operators import metrics, policy, records, replay, validation
from sluiceway.plans import fixtures as fx
from sluiceway.plans.oracles import ORACLES
from sluiceway.plans.queries import JSON, QUERIES, ROUTES
from sluiceway.schemas import REQUESTS
from sluiceway.session import materialize, shared_dir
from sluiceway.sinks import archive, batches, log, routing, state_table
from sluiceway.sources import envelope, kv_archive
from sluiceway.sources.messages import read_messages
from sluiceway.sources.policy_file import load_policy, policy_frame
from sluiceway.streaming import ingest, metrics as live


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_policy_file(spark, tmp_path):
    (tmp_path / "p").write_text("# note\n\n \t \na.x=1\nfoo_*.baz=7=9\na.x=2\nk==v\n=v\n spaced = s \n")
    got = {r.rule: (r.value, r.prefix, r.suffix) for r in load_policy(spark, str(tmp_path / "p")).collect()}
    assert got == {
        "a.x": ("2", None, None), "foo_*.baz": ("7", "foo_", ".baz"), "k": ("", None, None),
        "": ("v", None, None), " spaced ": (" s ", None, None),
    }


@pytest.mark.parametrize("line", ["noequals", "k=", "=", "k=="])
def test_policy_line_without_value(spark, tmp_path, line):
    (tmp_path / "p").write_text(line + "\n")
    with pytest.raises(Exception, match="without a value"):
        load_policy(spark, str(tmp_path / "p")).collect()
    assert load_policy(spark, str(tmp_path / "p"), "permissive").first().value is None


RULES = {
    "foo_*.baz": "7", "a.k": "exact", "*.k": "any", "a*.k": "pre", "ab*c.k": "long", "ab*.k": "short", "x*x.k": "no overlap",
    "*z.k": "suffix", "q*": "open", "ns.k*": "over",
}
NAMES = ["foo_bar", "a", "abc", "abxc", "abx", "x", "xx", "az", "z", "qq", "ns", "other"]


def expected_rule(name, rules):
    if name in rules:
        return rules[name]
    hits = []
    for rule, value in rules.items():
        if "*" in rule:
            pre, suf = rule.split("*", 1)
            if name.startswith(pre) and name.endswith(suf) and len(name) >= len(pre) + len(suf):
                hits.append((-len(pre), -len(suf), rule, value))
    return min(hits)[3] if hits else None


@pytest.mark.parametrize("key", [".k", ".baz"])
def test_policy_precedence_joined_and_inline(spark, key):
    names = spark.createDataFrame([(n,) for n in NAMES + NAMES[:3]], "namespace string")
    rules = policy_frame(spark, RULES)
    expected = {n: expected_rule(n + key, RULES) or "none" for n in NAMES}
    joined = policy.resolve_policy(names, rules, key, "none")
    assert {r.namespace: r.value for r in joined.collect()} == expected
    flags = policy_frame(spark, {r: "true" if v in ("long", "exact", "7") else "no" for r, v in RULES.items()})
    inline = policy.attach_settings(names, flags, {"f": (key, "true")})
    expected = {n: v in ("long", "exact", "7", "none") for n, v in expected.items()}
    assert {r.namespace: r.f for r in inline.collect()} == expected
    plan = plan_of(joined)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("more", [0, 5000])
def test_policies_of_any_size(spark, tmp_path, more):
    """The same answers, in a batch and on a stream, with few rules and with thousands; no value means the default."""
    rules = policy_frame(spark, {"a.f": "TRUE", "b*.f": "no", "c.f": None} | {f"*x{i}.f": "no" for i in range(more)})
    spark.createDataFrame([("a",), ("b1",), ("c",), (None,), ("zx7",)], "namespace string").write.parquet(f"{tmp_path}/in")
    names = spark.read.parquet(f"{tmp_path}/in")
    expected = {"a": True, "b1": False, "c": True, None: True, "zx7": not more}
    batch = policy.attach_settings(names, rules, {"f": (".f", "true")})
    assert {r.namespace: r.f for r in batch.collect()} == expected
    stream = policy.attach_settings(spark.readStream.schema(names.schema).parquet(f"{tmp_path}/in"), rules, {"f": (".f", "true")})
    run = stream.writeStream.format("memory").queryName(f"flags{more}").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r.namespace: r.f for r in spark.table(f"flags{more}").collect()} == expected
    assert "Exchange" not in plan_of(batch) and "Join" not in plan_of(batch)


def test_empty_and_missing_validators(spark):
    df = spark.createDataFrame([(bytearray(b"{}"),), (bytearray(b"x"),)], "payload binary")
    assert [r.valid for r in validation.validate(df, None).collect()] == [True, True]
    assert [r.valid for r in validation.validate(df, []).collect()] == [False, False]
    chain = [("json", JSON[0][1]), ("never", lambda p: F.lit(False))]
    assert [r.first_failed for r in validation.validate(df, chain).collect()] == ["never", "json"]


def test_oversized_values(spark):
    df = spark.createDataFrame([(bytearray(b"acceptable"),), (bytearray(b"x" * 51),), (None,)], "payload binary")
    assert [r.payload and bytes(r.payload) for r in validation.reject_oversized(df, 50).collect()] == [b"acceptable", None]


def test_envelopes(spark, sf_dir):
    messages = fx.messages(spark, sf_dir)
    encoded = envelope.encode_messages(messages)
    decoded = envelope.decode_messages(encoded).drop("reason").select(*messages.columns)
    assert decoded.exceptAll(messages).count() == 0 and messages.exceptAll(decoded).count() == 0
    odd = encoded.limit(1).withColumn("value", F.lit(b"\xff\xff")).unionByName(encoded.limit(1).withColumn("value", F.lit(b"")))
    out = envelope.decode_messages(odd).collect()
    assert sorted((r.reason or "", r.namespace, r.id, r.operation) for r in out) == [
        ("", "", None, "CREATE_UPDATE"), ("undecodable", None, None, None)
    ]
    with pytest.raises(Exception, match="undecodable"):
        envelope.decode_messages(odd, "failfast").collect()


def test_topics_are_pruned(spark, sf_dir, tmp_path):
    path = str(tmp_path / "log")
    messages = fx.messages(spark, sf_dir)
    log.publish(messages, path)
    read = read_messages(spark, "testpilot_.+", path)
    assert read.count() == messages.filter("namespace like 'testpilot%'").count() > 0
    assert "PartitionFilters: [isnotnull(topic" in plan_of(read)
    assert read_messages(spark, "testpilot", path).count() == 0
    stream = read_messages(spark, "metrics", path, stream=True)
    assert stream.isStreaming


def test_archives(spark, tmp_path):
    rows = [("n", "k1", 0, "store", bytearray(b"v1")), ("n", "k2", 86_400_000, "store", bytearray(b"v2")), ("n", "k3", 0, "delete", None)]
    df = spark.createDataFrame(rows, "namespace string, id string, ts_ms long, action string, payload binary")
    archive.write_archive(df, str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert sorted((str(r.ds), r.key) for r in back.collect()) == [("1970-01-01", "k1"), ("1970-01-02", "k2")]
    today = archive.archive_rows(df, "ingest").select("ds").distinct().collect()
    assert len(today) <= 2 and today[0].ds > "2000"
    for as_bytes in (False, True):
        path = str(tmp_path / f"seq{as_bytes}")
        pairs = df.filter("payload is not null").select(F.col("id").alias("key"), F.col("payload").alias("value"))
        archive.export_kv(pairs, path, as_bytes)
        got = kv_archive.read_kv_archive(spark, path, as_bytes).collect()
        assert sorted((r.key, bytes(r.value) if as_bytes else r.value.encode()) for r in got) == [("k1", b"v1"), ("k2", b"v2")]


def test_destinations(spark):
    df = spark.createDataFrame([("a/b/c",)], "k string")
    cases = {"http://x/%k": "http://x/a/b/c", "http://x": "http://x", "foo %k bar": "foo a/b/c bar", "%k!": "a/b/c!", "%k %k": "a/b/c %k"}
    assert [df.select(replay.replay_url(p, F.col("k"))).first()[0] for p in cases] == list(cases.values())


def test_replay(spark):
    rows = [("ns", f"id{i}", 0, i // 2, 0, "store", bytearray(b"x"), i % 2) for i in range(500)]
    rows += [("ns", f"id{i}", 0, 500 + i, 0, "delete", None, 0) for i in range(50)]
    df = spark.createDataFrame(rows, "namespace string, id string, ts_ms long, seq long, ord int, action string, payload binary, shard long")
    assert replay.replay_plan(df, "%k").count() == 500
    assert replay.replay_plan(df, "%k", deletes=True).filter("method = 'DELETE'").count() == 50
    for stable in (True, False):
        n = replay.replay_plan(df, "%k", rate=0.1, stable=stable, seed=1).count()
        assert 1 <= n <= 499
    moved = replay.replay_plan(df, "%k", copy_keys=False, deletes=True).collect()
    assert all(len(r.url) == 36 for r in moved if r.method == "POST") and len({r.url for r in moved}) == 550
    assert {r.url for r in moved if r.method == "DELETE"} == {f"id{i}" for i in range(50)}


def test_quantiles_are_exact(spark):
    inf = float("inf")
    for values, p75, p50 in (([1.0, 2.0, 3.0, 4.0, inf], 4.0, 3.0), ([4.0], 4.0, 4.0), ([1.0, 2.0], 1.75, 1.5), ([None, None], None, None)):
        report = metrics.latency_report(spark.createDataFrame([(v,) for v in values], "value double"), "value").first()
        assert (report.p75, report.p50) == (p75, p50)


def test_earlier_reasons_survive_the_gate(spark):
    df = spark.createDataFrame([(None, None, None, "undecodable"), ("a", bytearray(b"{}"), None, None)], "id string, payload binary, operation string, reason string")
    got = {(r.action, r.reason) for r in validation.gate_operations(df, JSON).collect()}
    assert got == {("invalid", "undecodable"), ("store", None)}


def test_long_numbers_stay_as_sent(spark):
    number = "1234567890" * 5
    cases = {'{"n": %s}' % number: '{"n": %s,"ingest_ts":7}' % number, "{ }": '{ "ingest_ts":7}', '{"ingest_ts":1}': '{"ingest_ts":7}', "[1]": None}
    df = spark.createDataFrame([(bytearray(k.encode()), 7) for k in cases], "payload binary, ts_ms long")
    assert [r.payload and bytes(r.payload).decode() for r in records.with_ingest_ts(df).collect()] == list(cases.values())


def test_routes_need_writers(spark, sf_dir, tmp_path):
    stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="replay2"):
        ingest.run_ingest(stream, str(tmp_path / "o"), policy=fx.policy(spark), namespaces=fx.NAMESPACES, routes={"telemetry": "replay2"})


def test_every_message_reaches_one_writer(spark, sf_dir, tmp_path):
    """A consumer with all kinds of writers, the caller's own among them."""
    messages = materialize(fx.messages(spark, sf_dir), "messages")
    routes = {"telemetry": "state_salted", "metrics": "archive_stamped", "testpilot_0": "replay", "testpilot_1": "log", "testpilot_2": "mine"}
    src, out, mine = str(tmp_path / "in"), str(tmp_path / "out"), []
    messages.coalesce(2).write.parquet(src)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(src)
    own = {"mine": lambda df, i: mine.append(df.count())}
    ingest.run_consumer(stream.withColumn("reason", F.lit(None).cast("string")), out, routes=routes, writers=own).awaitTermination()
    refused = batches.read_batches(spark, f"{out}/quarantine")
    assert {r.reason for r in refused.select("reason").distinct().collect()} == {"unroutable"}
    assert refused.filter("payload is not null and id is not null").count() > 0
    n = {r.namespace: r["count"] for r in messages.groupBy("namespace").count().collect()}
    assert sum(mine) == n["testpilot_2"] and refused.count() == n["marketplace_apps"]
    assert batches.read_batches(spark, f"{out}/log").count() == n["testpilot_1"]
    assert batches.read_batches(spark, f"{out}/replay").count() == n["testpilot_0"]
    stamped = batches.read_batches(spark, f"{out}/archive_stamped").select(F.col("value").cast("string").alias("v"))
    assert stamped.filter("v like '%\"ingest_ts\":%'").count() > 0
    assert state_table.read_state(spark, f"{out}/state_salted", key_mode="salted").count() > 0


def test_request_totals_need_one_grouping_of_the_input(spark, sf_dir):
    plan = plan_of(metrics.request_metrics(fx.classified(spark, sf_dir)))
    assert plan.index("Expand") < plan.index("inline")  # above the first aggregate, not on the rows


def test_plans_read_only_needed_columns(spark, sf_dir):
    df = contract.queries()["oversized_values"](spark, sf_dir)
    plan = plan_of(df)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
    plan = plan_of(contract.queries()["request_outcomes"](spark, sf_dir))
    assert "ReadSchema: struct<event_id:bigint,event_type:string,props:string>" in plan


def test_the_log_position_is_the_identity(spark):
    df = spark.createDataFrame([("n", 0, 1, 0, "a"), ("n", 0, 1, 0, "a"), ("n", 1, 1, 0, "a")], "namespace string, shard long, seq long, ord int, id string")
    assert records.dedupe_redelivered(df).count() == 2


def test_routes(spark):
    df = spark.createDataFrame([("telemetry",), ("xtelemetry",), ("testpilot_",), ("testpilot_1",)], "namespace string")
    got = {r.namespace: r.route for r in routing.route(df, ROUTES).collect()}
    assert got == {"telemetry": "state", "xtelemetry": None, "testpilot_": None, "testpilot_1": "archive"}


def snapshot(spark, path):
    state = state_table.read_state(spark, f"{path}/state")
    parts = [
        state.select("namespace", "id", F.md5("payload").alias("v")),
        batches.read_batches(spark, f"{path}/archive").select("namespace", F.col("key").alias("id"), F.md5("value").alias("v")),
        batches.read_batches(spark, f"{path}/quarantine").select("namespace", F.col("seq").cast("string").alias("id"), F.col("reason").alias("v")),
    ]
    return [sorted(map(json.dumps, map(tuple, p.collect()))) for p in parts]


def test_ingest_resumes_and_repeats(spark, sf_dir, tmp_path):
    """Two runs over a growing folder equal one batch, and a repeated batch id changes nothing."""
    settings = dict(policy=fx.policy(spark), namespaces=fx.NAMESPACES, routes=ROUTES, limit=fx.MAX_BODY, validators=JSON)
    requests = materialize(fx.requests(spark, sf_dir), "requests")
    src, out, whole = (str(tmp_path / d) for d in ("in", "out", "whole"))
    for part in ("seq % 3 = 1", "seq % 3 <> 1"):
        requests.filter(part).coalesce(2).write.mode("append").parquet(src)
        stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(src)
        ingest.run_ingest(stream, out, task_rows=200, **settings).awaitTermination()
    ingest.write_outputs(ingest.prepare(requests, **settings), 0, whole)
    first = snapshot(spark, whole)
    assert snapshot(spark, out) == first and all(first)
    ingest.write_outputs(ingest.prepare(requests, **settings), 0, whole)
    assert snapshot(spark, whole) == first


def test_batches_without_rows(spark, tmp_path):
    """A batch of which nothing is stored still leaves readable outputs."""
    data = [(0, 0, 0, "POST", "/submit/bogus", "1.1.1.1", {}, bytearray(b"x"))]
    rows = ingest.prepare(spark.createDataFrame(data, REQUESTS), fx.policy(spark), fx.NAMESPACES, ROUTES)
    ingest.write_outputs(rows, 0, str(tmp_path))
    assert batches.read_batches(spark, f"{tmp_path}/archive", schema=archive.ARCHIVE).count() == 0
    assert state_table.read_state(spark, f"{tmp_path}/state").count() == 0
    assert [r.reason for r in batches.read_batches(spark, f"{tmp_path}/quarantine").collect()] == ["namespace"]
    with pytest.raises(ValueError):
        batches.latest_updates(spark, f"{tmp_path}/none", ["id"])


def test_ingest_opens_bodies_after_the_size_limit(spark, tmp_path):
    body, h = zlib.compress(b'{"k": 1}' * 100), {"content-encoding": ["deflate"]}
    rows = [(0, h, body), (1, h, b"junk"), (2, h, zlib.compress(b"")), (3, {}, b'{"k": 2}'), (4, {}, b"x" * 101)]
    data = [(i, 0, i, "POST", "/submit/metrics", "1.1.1.1", hd, bytearray(b)) for i, hd, b in rows]
    out = ingest.prepare(
        spark.createDataFrame(data, REQUESTS), fx.policy(spark), fx.NAMESPACES, ROUTES, limit=100, max_value=500, inflated=True
    )
    got = {r.seq: (r.reason, r.action, None if r.payload is None else len(r.payload)) for r in out.collect()}
    assert got == {
        0: ("oversized", "invalid", 800), 1: ("corrupt_body", "invalid", None), 2: ("empty_body", "invalid", 0),
        3: (None, "store", 8), 4: ("body_too_large", "invalid", 101),
    }


def test_live_rates_in_update_mode(spark, sf_dir):
    stream = spark.readStream.format("rate").load().select(F.lit("n").alias("namespace"), F.col("timestamp").alias("ts"), F.col("value").alias("n_bytes"))
    assert live.stream_metrics(stream).isStreaming
    assert log.to_console(stream.select(F.col("namespace").alias("key"), F.col("namespace").alias("value"))) is not None


class FakeSession:
    """Stands for a session with given settings."""

    def __init__(self, master, **conf):
        self.sparkContext = self
        self.master = master
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


def test_shared_folder_comes_from_the_session():
    assert shared_dir(FakeSession("yarn", spark_checkpoint_dir="/shared/x/")) == "/shared/x"
    with pytest.raises(ValueError):
        shared_dir(FakeSession("yarn"))
    assert shared_dir(FakeSession("local[2]")) == shared_dir(FakeSession("local[2]"))


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["namespace", "outcome", "reason", "n"] and out.count() > 0
    assert set(ORACLES) == set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_outcomes_as_published(spark):
    rows = contract.queries()["request_outcomes"](spark, "/root/testdata/sf0.01").groupBy("outcome", "reason").agg(F.sum("n").alias("n"))
    got = {(r.outcome, r.reason): r.n for r in rows.collect()}
    assert got == {
        (201, None): 5919, (404, "namespace"): 1957, (403, "delete_denied"): 531, (400, "empty_body"): 337, (404, "id"): 320,
        (403, "get_denied"): 226, (404, "endpoint"): 170, (413, "body_too_large"): 150, (200, None): 245, (403, "method_denied"): 145,
    }


def test_a_slice_is_a_batch_of_files_by_its_rows(spark, monkeypatch):
    """Test streams have more files where there are more rows, and still one batch for each slice."""
    from sluiceway.plans import queries

    monkeypatch.setattr(queries, "FILE_ROWS", 10)
    rows = spark.range(200).select("id", (queries.FIRST_MS + F.col("id") % 5 * queries.SLICE_MS).alias("at"))
    stream = queries.arrivals(rows, "many", F.col("at"))
    path = queries.finished(stream.withColumn("file", F.input_file_name()), "many", "append")
    got = queries.batches.read_batches(spark, path).groupBy("batch").agg(F.countDistinct("at").alias("slices"), F.countDistinct("file").alias("files"), F.count("*").alias("n")).collect()
    assert sorted((r.batch, r.slices, r.files, r.n) for r in got) == [(b, 1, 4, 40) for b in range(5)]
