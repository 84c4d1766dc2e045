"""Registered queries: each one operator over a whole test table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType

from sluiceway.functions import address, keys, paths, payload
from sluiceway.operators import (
    admission,
    batching,
    messages as expansion,
    metrics,
    policy as policies,
    records,
    replay,
    state,
    validation,
)
from sluiceway.plans import fixtures as fx
from sluiceway.session import configure, materialize, workspace
from sluiceway.sinks import archive, batches, log, rolling, routing, state_table
from sluiceway.sources import envelope, kv_archive, messages as log_source, policy_file
from sluiceway.streaming import ingest, meters, metrics as live, state as live_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

JSON = [("json", payload.valid_json)]
ROUTES = {"telemetry|metrics": "state", "testpilot_.+": "archive"}
# Rules that overlap, for the precedence order.
OVERLAPPING = fx.RULES | {
    "testpilot_1*.id.validation": "FALSE",
    "*.id.validation": "no",
    "*_apps.id.validation": "true",
    "tele*.allow.delete.access": "True",
}
# Test streams arrive slice by slice of event time, in no order within a slice,
# so that no row comes later than the length of one.
SLICE_MS = 6 * 86_400_000
SLICES = 5
FIRST_MS = 1_704_067_200_000  # 2024-01-01, where the test events begin
LATENESS = "6 days"
# Rows per file of a test stream; a batch has as many files as its slice, so
# that its tasks grow in number with the input.
FILE_ROWS = 50_000


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(configure(spark), sf_dir)

    QUERIES[f.__name__] = run
    return f


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


def text(c: str) -> Column:
    return F.col(c).cast("string")


def n_rows() -> Column:
    return F.count(F.lit(1)).alias("n")


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.gate_operations(fx.messages(spark, sf_dir), JSON)


def ds(ts_ms: str = "ts_ms") -> Column:
    return F.date_format(keys.utc_time(F.col(ts_ms)), "yyyy-MM-dd")


# --- sources ---------------------------------------------------------------


@query
def source_topic_pattern(spark, sf_dir):
    path = workspace(spark, "log")
    log.publish(fx.messages(spark, sf_dir), path)
    read = log_source.read_messages(spark, "testpilot_.+|marketplace_.+", path)
    return read.groupBy("topic").agg(n_rows(), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


@query
def envelope_decode(spark, sf_dir):
    decoded = envelope.decode_messages(envelope.encode_messages(fx.messages(spark, sf_dir)))
    return _message_text(decoded).withColumn("reason", F.col("reason"))


@query
def seqfile_roundtrip(spark, sf_dir):
    path = workspace(spark, "pairs")
    archive.export_kv(_turns(spark, sf_dir), path)
    back = kv_archive.read_kv_archive(spark, path)
    return back.select("key", F.md5("value").alias("digest"), F.octet_length("value").alias("n_bytes"))


@query
def policy_load(spark, sf_dir):
    e = F.col("event_id")
    number = e.cast("string")
    line = (
        F.when(e % 7 == 0, F.concat(F.lit("# note "), number))
        .when(e % 7 == 1, "  ")
        .when(e % 7 == 2, F.concat(F.lit("ns"), number, F.lit(".allow.delete.access=true=ignored")))
        .when(e % 7 == 3, F.concat(F.lit("grp"), number, F.lit("_*.id.validation=false")))
        .otherwise(F.concat(F.lit("ns"), number, F.lit(".id.validation="), F.col("event_type")))
    )
    path = workspace(spark, "rules")
    fx.events(spark, sf_dir).select(line.alias("value")).write.text(path)
    return policy_file.load_policy(spark, path)


# --- projections -----------------------------------------------------------


@query
def path_elements(spark, sf_dir):
    urls = fx.table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("row_id"), F.col("url").alias("uri")
    )
    uris = fx.requests(spark, sf_dir).select(F.lit("request").alias("kind"), F.col("seq").alias("row_id"), "uri")
    split = urls.unionByName(uris).withColumn("path", paths.path_elements(F.col("uri")))
    return split.select("kind", "row_id", joined("path").alias("path"), F.size("path").alias("depth"))


@query
def path_depth_stats(spark, sf_dir):
    path = paths.path_elements(F.col("url"))
    pages = fx.table(spark, sf_dir, "pages").select(path.alias("path"))
    return pages.groupBy(F.size("path").alias("depth")).agg(
        n_rows(),
        F.count(paths.path_element(F.col("path"), 2)).alias("with_third"),
        F.max(F.length(paths.path_element(F.col("path"), 1))).alias("longest_second"),
    )


@query
def api_version_counts(spark, sf_dir):
    first = paths.path_element(paths.path_elements(F.col("uri")), 0)
    return (
        fx.requests(spark, sf_dir)
        .select(first.alias("first"))
        .groupBy("first", paths.is_api_version(F.col("first")).alias("is_version"))
        .agg(n_rows())
    )


@query
def request_fields(spark, sf_dir):
    return admission.parse_requests(fx.requests(spark, sf_dir)).select(
        "seq", "api_version", "endpoint", "namespace", "id", joined("partition").alias("partition"),
        F.size("partition").alias("n_partitions"),
    )


@query
def assigned_ids(spark, sf_dir):
    parsed = admission.parse_requests(fx.requests(spark, sf_dir)).withColumn("given", F.col("id").isNotNull())
    return admission.assign_ids(parsed).select("seq", "given", "id")


@query
def client_addr(spark, sf_dir):
    addr = address.client_addr(admission.header("x-forwarded-for"), F.col("remote_addr"))
    return fx.requests(spark, sf_dir).select("seq", addr.alias("addr"))


@query
def client_addr_bytes(spark, sf_dir):
    sent = admission.with_client_addr(fx.requests(spark, sf_dir))
    return sent.select("seq", F.hex("ip_addr").alias("addr_hex"))


def _message_text(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c == "reason"]
    return df.select(
        "seq", "ord", "namespace", "id", F.hex("ip_addr").alias("ip_hex"), text("payload").alias("payload"),
        "ts_ms", "operation", "api_version", joined("partition").alias("partition"), *rest,
    )


@query
def to_messages(spark, sf_dir):
    return _message_text(fx.messages(spark, sf_dir))


@query
def obsolete_deletes(spark, sf_dir):
    return fx.messages(spark, sf_dir).filter("ord > 0").select("seq", "ord", "namespace", "id")


@query
def effective_encoding(spark, sf_dir):
    given, kind = admission.header("content-encoding"), admission.header("content-type")
    return (
        fx.requests(spark, sf_dir)
        .groupBy(
            given.alias("content_encoding"), kind.alias("content_type"),
            payload.effective_encoding(given, kind).alias("effective"),
        )
        .agg(n_rows())
    )


@F.pandas_udf(BinaryType())
def _deflated(body: pd.Series, wbits: pd.Series) -> pd.Series:
    """Bodies as a client would compress them; 0 leaves the body as it is."""

    def one(data, bits):
        if not bits:
            return data
        stream = zlib.compressobj(wbits=bits)
        return stream.compress(data) + stream.flush()

    return pd.Series([one(d, int(b)) for d, b in zip(body, wbits)])


@query
def inflate_payloads(spark, sf_dir):
    """Compress each document with one of four encodings, cut some short, and decode."""
    d = F.col("doc_id")
    wbits = F.when(d % 4 == 0, 31).when(d % 4 == 1, 15).when(d % 4 == 2, -15).otherwise(0)
    encoding = F.when(d % 4 == 0, "gzip").when(d % 4 < 3, "deflate")
    packed = fx.table(spark, sf_dir, "documents").select(
        d.alias("seq"),
        _deflated(F.col("text").cast("binary"), wbits).alias("body"),
        F.create_map(
            F.lit("content-encoding"), F.when(encoding.isNotNull(), F.array(encoding)),
            F.lit("content-type"), F.array(F.lit("application/json")),
        ).alias("headers"),
    )
    packed = packed.withColumn("body", F.when(F.col("seq") % 97 == 0, _cut_short()).otherwise(F.col("body")))
    return admission.inflate_payloads(packed).select(
        "seq", F.md5("body").alias("digest"), "inflate_failed"
    )


def _cut_short() -> Column:
    coded = F.col("headers")["content-encoding"].isNotNull()
    short = F.substring(F.col("body"), F.lit(1), F.octet_length("body") - 3)
    return F.when(coded, short).otherwise(F.col("body"))


@query
def salted_rowkey(spark, sf_dir):
    key = keys.salted_key(F.col("id"), F.col("ts_ms"))
    return fx.messages(spark, sf_dir).select("seq", "ord", F.hex(key).alias("row_key"))


@query
def display_rowkey(spark, sf_dir):
    key = keys.salted_key(F.col("id"), F.col("ts_ms"))
    return fx.messages(spark, sf_dir).select("seq", "ord", keys.display_key(key).alias("row_key"))


@query
def json_ingest_ts(spark, sf_dir):
    stamped = records.with_ingest_ts(fx.messages(spark, sf_dir).filter("ord = 0"))
    body = text("payload")
    return stamped.select(
        "seq",
        F.get_json_object(body, "$.k").cast("long").alias("k"),
        F.get_json_object(body, "$.ingest_ts").cast("long").alias("ingest_ts"),
        "reason",
    )


@query
def replay_dest(spark, sf_dir):
    url = replay.replay_url("http://replay.example.org/submit/%k/again", F.col("id"))
    return fx.messages(spark, sf_dir).select("seq", "ord", url.alias("url"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
        F.col("text").alias("value"),
    )


@query
def record_sizes(spark, sf_dir):
    sizes = records.record_sizes(_turns(spark, sf_dir), with_values=True)
    return sizes.select("key", "key_len", "value_len", "value")


@query
def replay_rekey(spark, sf_dir):
    return gated(spark, sf_dir).filter("action in ('store', 'delete')").select(
        "seq", "ord", "action", "id", replay.replay_key(copy_keys=False).alias("new_id")
    )


# --- admission and validation ----------------------------------------------


@query
def body_limit(spark, sf_dir):
    kept = admission.max_body(fx.requests(spark, sf_dir), fx.MAX_BODY)
    return kept.select("seq", F.octet_length("body").alias("n_bytes"))


@query
def namespace_whitelist(spark, sf_dir):
    ns = F.col("namespace")
    # Names that contain a valid name, or stop short of one, besides the plain ones.
    name = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("x"), ns, F.lit("x"))).when(
        F.col("seq") % 5 == 1, F.substring_index(ns, "_", 1)
    ).otherwise(ns)
    named = admission.parse_requests(fx.requests(spark, sf_dir)).select(name.alias("namespace"))
    return named.groupBy("namespace").agg(n_rows()).select(
        "namespace", "n",
        admission.valid_namespace(ns, fx.NAMESPACES).alias("valid"),
        admission.valid_namespace(ns, fx.NAMESPACES, anchored=True).alias("valid_anchored"),
    )


@query
def uuid_validation(spark, sf_dir):
    doc, s = F.col("id"), F.col("seq")
    shape = (
        F.when(s % 5 == 0, F.upper(doc))
        .when(s % 5 == 1, F.concat(doc, F.lit("0")))
        .when(s % 5 == 2, F.concat_ws("-", s.cast("string"), F.lit("2-3-4-5")))
        .when(s % 5 == 3, F.replace(doc, F.lit("-"), F.lit("")))
        .otherwise(doc)
    )
    shaped = admission.parse_requests(fx.requests(spark, sf_dir)).select("seq", shape.alias("id"))
    return shaped.filter("id is not null").select(
        "seq", "id", keys.valid_uuid(doc).alias("lenient"), keys.valid_uuid(doc, strict=True).alias("strict")
    )


def _any_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests classified with every namespace let in and no body too large."""
    open_to_all = admission.classify_requests(fx.requests(spark, sf_dir), fx.policy(spark), [".+"])
    return open_to_all.filter("namespace is not null")


@query
def id_policy(spark, sf_dir):
    ok = ~F.col("reason").eqNullSafe("id")
    return _any_namespace(spark, sf_dir).groupBy("namespace", ok.alias("id_ok")).agg(n_rows())


@query
def method_acl(spark, sf_dir):
    denied = F.coalesce(F.col("reason").isin("get_denied", "delete_denied", "method_denied"), F.lit(False))
    known = _any_namespace(spark, sf_dir).filter("reason is distinct from 'id'")
    return known.groupBy("namespace", "method", (~denied).alias("allowed")).agg(n_rows())


@query
def user_agents(spark, sf_dir):
    agent = F.create_map(F.lit("user-agent"), F.when(F.col("seq") % 5 != 0, F.array(F.concat(F.lit("client/"), F.col("seq") % 7))))
    sent = fx.requests(spark, sf_dir).withColumn("headers", F.map_concat("headers", agent))
    return admission.parse_requests(sent).groupBy("user_agent").agg(n_rows())


@query
def request_outcomes(spark, sf_dir):
    return fx.classified(spark, sf_dir).groupBy("namespace", "outcome", "reason").agg(n_rows())


@query
def json_validation(spark, sf_dir):
    body, s = text("body"), F.col("seq")
    variant = (
        F.when(s % 6 == 0, F.concat(F.lit("["), body, F.lit("]")))
        .when(s % 6 == 1, F.concat(body, F.lit(","), body))
        .when(s % 6 == 2, F.concat(body, F.lit(" "), s.cast("string")))
        .when(s % 6 == 3, s.cast("string"))
        .when(s % 6 == 4, F.concat(body, F.lit(',0] "x"')))
        .otherwise(body)
    )
    return fx.requests(spark, sf_dir).select("seq", payload.valid_json(variant).alias("valid"))


@query
def validation_chain(spark, sf_dir):
    chain = [
        *JSON,
        ("small", lambda p: F.octet_length(p) <= 9),
        ("has_k", lambda p: payload.text(p).contains('"k"')),
    ]
    checked = validation.validate(fx.messages(spark, sf_dir).filter("payload is not null"), chain)
    return checked.groupBy("namespace", "valid", "first_failed").agg(n_rows())


@query
def operation_gate(spark, sf_dir):
    holes = fx.messages(spark, sf_dir).withColumns(
        {
            "id": F.when(F.col("seq") % 41 != 0, F.col("id")),
            "payload": F.when(F.col("seq") % 47 != 0, F.col("payload")),
            "operation": F.when((F.col("operation") == "DELETE") | (F.col("seq") % 3 == 0), F.col("operation")),
        }
    )
    return validation.gate_operations(holes, JSON).groupBy("operation", "action", "reason").agg(n_rows())


@query
def oversized_values(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("payload"))
    return validation.reject_oversized(docs, fx.MAX_VALUE).select("doc_id", F.octet_length("payload").alias("n_bytes"))


@query
def replay_sample(spark, sf_dir):
    kept = replay.sample_messages(gated(spark, sf_dir).filter("action in ('store', 'delete')"), 0.3)
    return kept.select("seq", "ord", "action", "id")


@query
def replay_plan(spark, sf_dir):
    plan = replay.replay_plan(
        gated(spark, sf_dir), "http://replay.example.org/submit/%k", rate=0.5, deletes=True
    )
    return plan.withColumn("body", text("body"))


# --- policy and tombstone joins --------------------------------------------


@query
def policy_resolution(spark, sf_dir):
    names = admission.parse_requests(fx.requests(spark, sf_dir))
    rules = policy_file.policy_frame(spark, OVERLAPPING)
    checks = policies.resolve_policy(names, rules, admission.ID_VALIDATION, "true")
    deletes = policies.resolve_policy(names, rules, admission.ALLOW_DELETE, "false")
    return checks.unionByName(deletes).withColumn("flag", policies.as_flag(F.col("value")))


@query
def tombstone_antijoin(spark, sf_dir):
    return state.drop_deleted(gated(spark, sf_dir)).select("seq", "ord", "namespace", "id", "ts_ms")


# --- aggregates ------------------------------------------------------------


@query
def request_metrics(spark, sf_dir):
    return metrics.request_metrics(fx.classified(spark, sf_dir))


@query
def response_counts(spark, sf_dir):
    return metrics.response_counts(fx.classified(spark, sf_dir))


@query
def consumer_metrics(spark, sf_dir):
    return metrics.consumer_metrics(gated(spark, sf_dir))


@query
def sink_metrics(spark, sf_dir):
    return metrics.sink_metrics(gated(spark, sf_dir), limit=8)


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.messages(spark, sf_dir).withColumn("n_bytes", F.octet_length("payload"))


@query
def rate_series(spark, sf_dir):
    return metrics.rate_series(_sized(spark, sf_dir), 60)


@query
def latency_report(spark, sf_dir):
    report = metrics.latency_report(fx.events(spark, sf_dir), "value")
    return report.select("n", *[F.round(c, 6).alias(c) for c in report.columns if c != "n"])


@query
def code_frequency(spark, sf_dir):
    return metrics.frequency(fx.events(spark, sf_dir), "event_type")


# --- batching --------------------------------------------------------------


@query
def flush_batches(spark, sf_dir):
    rows = fx.messages(spark, sf_dir).select("namespace", "shard", "seq", "ord")
    return batching.flush_batches(rows, fx.BATCH)


@query
def flush_batches_null_groups(spark, sf_dir):
    rows = fx.messages(spark, sf_dir).select(
        F.when(F.col("seq") % 5 != 0, F.col("namespace")).alias("namespace"),
        F.when(F.col("seq") % 3 != 0, F.col("shard")).alias("shard"), "seq", "ord", F.col("shard").alias("from"),
    )
    return batching.flush_batches(rows, fx.BATCH, order=("seq", "from", "ord"))


@query
def file_roll_plan(spark, sf_dir):
    n_bytes = batching.record_bytes(F.col("id"), F.col("payload"))
    rows = gated(spark, sf_dir).filter("action = 'store'").select(
        "namespace", ds().alias("ds"), "shard", "seq", "ord", n_bytes.alias("n_bytes")
    )
    # The test groups are short, so the files are too.
    planned = batching.plan_files(rows, fx.ROLL_BYTES // 4)
    return planned.groupBy("namespace", "ds", "shard", "file_no").agg(
        n_rows(), F.sum("n_bytes").alias("n_bytes"), F.min("seq").alias("first_seq")
    )


@query
def poison_batches(spark, sf_dir):
    sizes = fx.requests(spark, sf_dir).select("shard", "seq", F.octet_length("body").alias("n_bytes"))
    return batching.poison_batches(sizes, fx.BATCH, fx.MAX_BODY, order=("seq",))


# --- keyed state -----------------------------------------------------------


@query
def latest_by_key(spark, sf_dir):
    columns = ["namespace", "id", "ts_ms", "seq", "ord", "shard", "operation", text("payload").alias("payload")]
    rows = fx.messages(spark, sf_dir).select(*columns)
    return state.latest_by_key(rows)


def _state_text(df: DataFrame) -> DataFrame:
    return df.select("namespace", "id", "ts_ms", "seq", text("payload").alias("payload"))


@query
def keyed_state(spark, sf_dir):
    return _state_text(state.keyed_state(gated(spark, sf_dir)))


@query
def keyed_state_salted(spark, sf_dir):
    table = state.keyed_state(gated(spark, sf_dir), key_mode="salted")
    return table.select("namespace", "id", F.hex("row_key").alias("row_key"), "ts_ms", "seq")


@query
def keyed_state_salted_fixed(spark, sf_dir):
    table = state.keyed_state(gated(spark, sf_dir), key_mode="salted", fix_deletes=True)
    return table.select("namespace", "id", F.hex("row_key").alias("row_key"), "ts_ms", "seq")


def _odd_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated messages of which some have no time and some an id that allows no salted key."""
    s = F.col("seq")
    return gated(spark, sf_dir).withColumns(
        {"id": F.when(s % 31 == 0, F.concat(F.lit("zz"), s)).otherwise(F.col("id")), "ts_ms": F.when(s % 7 != 0, F.col("ts_ms"))}
    )


@query
def keyed_state_untimed(spark, sf_dir):
    return _state_text(state.keyed_state(_odd_stores(spark, sf_dir)))


@query
def salted_refusals(spark, sf_dir):
    keyed = state.with_row_keys(_odd_stores(spark, sf_dir))
    size = F.octet_length("row_key")
    return keyed.groupBy("action", "reason").agg(n_rows(), F.count("row_key").alias("keyed"), F.sum(size).alias("key_bytes"))


# --- sinks -----------------------------------------------------------------


@query
def archive_by_day(spark, sf_dir):
    path = workspace(spark, "archive")
    archive.write_archive(gated(spark, sf_dir), path)
    back = spark.read.schema(archive.ARCHIVE).parquet(path)
    return back.groupBy("namespace", "ds").agg(n_rows(), F.sum(F.octet_length("value")).alias("n_bytes"))


@query
def publish_layout(spark, sf_dir):
    path = workspace(spark, "published")
    log.publish(fx.messages(spark, sf_dir), path)
    per_id = log_source.read_messages(spark, ".+", path).groupBy("topic", "id").agg(
        F.count(F.lit(1)).alias("m"), F.min("shard").alias("low"), F.max("shard").alias("high")
    )
    return per_id.groupBy("topic").agg(
        F.sum("m").alias("n"), F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("low") != F.col("high")).alias("n_split_ids")
    )


@query
def namespace_routing(spark, sf_dir):
    return routing.route(fx.messages(spark, sf_dir), ROUTES).groupBy("namespace", "route").agg(n_rows())


@query
def quarantine_reasons(spark, sf_dir):
    return expansion.quarantine(fx.classified(spark, sf_dir)).groupBy("reason").agg(n_rows())


# --- streams ---------------------------------------------------------------


def arrivals(df: DataFrame, tag: str, at: Column, redelivered: DataFrame | None = None) -> DataFrame:
    """``df`` as a file stream that arrives in slices of event time ``at`` (milliseconds)."""
    spark = df.sparkSession
    path = workspace(spark, tag)
    rows = df if redelivered is None else df.unionByName(redelivered)
    slices = F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.floor((at - FIRST_MS) / SLICE_MS)))
    rows = materialize(rows.withColumn("_slice", slices), f"{tag}-rows")
    # All slices have the same number of files, or batches would not be slices.
    smallest = min((r["count"] for r in rows.groupBy("_slice").count().collect()), default=0)
    files = max(2, smallest // FILE_ROWS)
    for k in range(SLICES):
        rows.filter(F.col("_slice") == k).drop("_slice").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def finished(stream: DataFrame, tag: str, mode: str = "update") -> str:
    """Run a stream over all that has arrived; the folder of its batches."""
    path = workspace(stream.sparkSession, tag)
    run = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(lambda df, i: batches.write_batch(df, path, i))
        .option("checkpointLocation", workspace(stream.sparkSession, f"{tag}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return path


def _streamed_state(spark: SparkSession, sf_dir: str, lateness: str | None) -> DataFrame:
    actions = gated(spark, sf_dir).select("namespace", "id", "ts_ms", "seq", "ord", "action", "payload", "shard")
    stream = live_state.keyed_state_stream(arrivals(actions, "actions", F.col("ts_ms")), lateness=lateness)
    table = batches.latest_updates(spark, finished(stream, "state"), ["namespace", "id"])
    return table.filter("alive").select(
        "namespace", "id", F.col("put_ms").alias("ts_ms"), F.col("put_seq").alias("seq"), text("payload").alias("payload")
    )


@query
def keyed_state_stream(spark, sf_dir):
    return _streamed_state(spark, sf_dir, None)


@query
def keyed_state_stream_expiring(spark, sf_dir):
    return _streamed_state(spark, sf_dir, LATENESS)


@query
def dedupe_stream(spark, sf_dir):
    rows = fx.messages(spark, sf_dir).withColumn("ts", keys.utc_time(F.col("ts_ms"))).drop("ip_addr", "partition")
    stream = arrivals(rows, "redelivered", F.col("ts_ms"), redelivered=rows.filter("seq % 20 = 0"))
    once = records.dedupe_redelivered(stream, LATENESS)
    path = finished(once.select("namespace", "shard", "seq", "ord", "id"), "deduped", "append")
    return batches.read_batches(spark, path).drop("batch")


@query
def stream_rates(spark, sf_dir):
    rows = _sized(spark, sf_dir).withColumn("ts", keys.utc_time(F.col("ts_ms")))
    stream = live.stream_metrics(
        arrivals(rows.select("namespace", "ts", "n_bytes"), "rates", F.unix_millis("ts")), 60, LATENESS
    )
    return batches.latest_updates(spark, finished(stream, "windows"), ["namespace", "bucket_ms"])


@query
def ingest_e2e(spark, sf_dir):
    """Rows that each output of the whole path holds at the end."""
    path = workspace(spark, "ingest")
    ingest.run_ingest(
        arrivals(fx.requests(spark, sf_dir), "requests", F.col("recv_ms")),
        path,
        policy=fx.policy(spark),
        namespaces=fx.NAMESPACES,
        routes=ROUTES,
        limit=fx.MAX_BODY,
        validators=JSON,
    ).awaitTermination()
    return _held(spark, path)


def _held(spark: SparkSession, path: str) -> DataFrame:
    live_rows = state_table.read_state(spark, f"{path}/state").groupBy("namespace").agg(n_rows())
    stored = batches.read_batches(spark, f"{path}/archive", schema=archive.ARCHIVE).groupBy("namespace").agg(n_rows())
    refused = batches.read_batches(spark, f"{path}/quarantine").groupBy("reason").agg(n_rows())
    parts = [(live_rows, "state", "namespace"), (stored, "archive", "namespace"), (refused, "quarantine", "reason")]
    out = [df.select(F.lit(sink).alias("sink"), F.col(c).alias("item"), "n") for df, sink, c in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def consume_e2e(spark, sf_dir):
    """The same from a log of envelopes, some of them corrupt, the state compacted on the way."""
    path = workspace(spark, "consume")
    encoded = envelope.encode_messages(fx.messages(spark, sf_dir))
    corrupt = (F.col("seq") % 50 == 0) & (F.col("ord") == 0)
    encoded = encoded.withColumn("value", F.when(corrupt, F.unhex(F.lit("FFFF"))).otherwise(F.col("value")))
    stream = envelope.decode_messages(arrivals(encoded, "envelopes", FIRST_MS + F.pmod(F.xxhash64("key"), F.lit(SLICES)) * SLICE_MS))
    ingest.run_consumer(stream, path, routes=ROUTES, validators=JSON, compact_every=2).awaitTermination()
    return _held(spark, path)


def _in_slices(encoded: DataFrame, tag: str, also: DataFrame | None = None) -> DataFrame:
    """Envelopes as a stream in which they arrive in no order, those of ``also`` once more in another slice."""
    turn = lambda more: FIRST_MS + F.pmod(F.xxhash64("key") + more, F.lit(SLICES)) * SLICE_MS
    rows = encoded.withColumn("_at", turn(0))
    again = None if also is None else also.withColumn("_at", turn(2))
    return arrivals(rows, tag, F.col("_at"), redelivered=again).drop("_at")


@query
def consume_redelivered(spark, sf_dir):
    """What the sinks hold after a log with messages delivered again, in another batch and in the same one."""
    path = workspace(spark, "consume-once")
    encoded = envelope.encode_messages(fx.messages(spark, sf_dir))
    corrupt = (F.col("seq") % 50 == 0) & (F.col("ord") == 0)
    encoded = encoded.withColumn("value", F.when(corrupt, F.unhex(F.lit("FFFF"))).otherwise(F.col("value")))
    again = encoded.filter("seq % 20 = 0").union(encoded.filter("seq % 60 = 0"))
    stream = envelope.decode_messages(_in_slices(encoded, "delivered", again))
    ingest.run_consumer(stream, path, routes=ROUTES, validators=JSON, once=True).awaitTermination()
    return _held(spark, path)


@query
def consume_salted_e2e(spark, sf_dir):
    """Every message in exactly one output of a salted table: its rows after all deletes, and what was refused."""
    path = workspace(spark, "consume-salted")
    s = F.col("seq")
    odd = fx.messages(spark, sf_dir).withColumns(
        {"id": F.when(s % 31 == 0, F.concat(F.lit("zz"), s)).otherwise(F.col("id")), "ts_ms": F.when(s % 7 != 0, F.col("ts_ms"))}
    )
    stream = arrivals(odd, "odd", FIRST_MS + F.pmod(s, F.lit(SLICES)) * SLICE_MS)
    ingest.run_consumer(stream, path, routes={".+": "state_salted"}, validators=JSON, compact_every=3).awaitTermination()
    live_rows = state_table.read_state(spark, f"{path}/state_salted", key_mode="salted", fix_deletes=True)
    refused = batches.read_batches(spark, f"{path}/quarantine")
    rows = live_rows.groupBy("namespace").agg(n_rows()).select(F.lit("state").alias("sink"), F.col("namespace").alias("item"), "n")
    return rows.unionByName(refused.groupBy("reason").agg(n_rows()).select(F.lit("quarantine").alias("sink"), F.col("reason").alias("item"), "n"))


@query
def rolling_archive(spark, sf_dir):
    """Files of an archive that rolls by size, read back after a stream whose batches share each day's files."""
    path = workspace(spark, "rolling")
    puts = gated(spark, sf_dir).filter("action = 'store'").select("namespace", "id", "ts_ms", "shard", "seq", "ord", "action", "payload")
    stream = arrivals(puts, "rolled", FIRST_MS + F.pmod(F.col("seq"), F.lit(SLICES)) * SLICE_MS)
    run = (
        stream.writeStream.foreachBatch(lambda df, i: rolling.write_rolling(df, path, i, fx.ROLL_BYTES // 4))
        .option("checkpointLocation", workspace(spark, "rolling-progress"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    files = rolling.read_rolling(spark, path)
    return files.groupBy("namespace", "ds", "shard", "file_no").agg(
        n_rows(), F.sum(batching.record_bytes(F.col("key"), F.col("value"))).cast("long").alias("n_bytes"), F.min("seq").alias("first_seq")
    )


@query
def keyed_state_stream_late(spark, sf_dir):
    """Per namespace: live keys, rows applied and rows refused as late, when some rows come in the last slice only."""
    rows = _odd_stores(spark, sf_dir).filter("action in ('store', 'delete')")
    rows = rows.select("namespace", "id", "ts_ms", "seq", "ord", "action", "payload", "shard")
    late = (F.col("seq") % 20 == 0) & (F.col("ts_ms") < FIRST_MS + 3 * SLICE_MS)
    at = F.when(late, FIRST_MS + (SLICES - 1) * SLICE_MS).otherwise(F.coalesce("ts_ms", F.lit(FIRST_MS)))
    path = finished(live_state.keyed_state_stream(arrivals(rows, "late-actions", at), lateness=LATENESS), "late-state")
    done = batches.read_batches(spark, path).groupBy("namespace").agg(
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("n_applied"),
        F.coalesce(F.sum(F.when(F.col("reason") == "late", F.col("n"))), F.lit(0)).alias("n_late"),
    )
    alive = batches.latest_updates(spark, path, ["namespace", "id"]).filter("alive").groupBy("namespace").agg(n_rows().alias("n_alive"))
    return done.join(alive, "namespace", "left").withColumn("n_alive", F.coalesce("n_alive", F.lit(0)))


@query
def live_meters(spark, sf_dir):
    """The four reports after a stream of requests, whose counts are carried from batch to batch."""
    path = workspace(spark, "meters")
    classified = admission.classify_requests(
        arrivals(fx.requests(spark, sf_dir), "metered", F.col("recv_ms")), fx.policy(spark), fx.NAMESPACES, fx.MAX_BODY
    )

    def write(df: DataFrame, batch_id: int) -> None:
        meters.meter_requests(df, path, batch_id)
        meters.meter_messages(validation.gate_operations(expansion.to_messages(df), JSON), path, batch_id, limit=8)

    run = (
        classified.writeStream.foreachBatch(write)
        .option("checkpointLocation", workspace(spark, "meters-progress"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    requests, rows = meters.read_counts(spark, f"{path}/requests"), meters.read_counts(spark, f"{path}/messages")
    responses = metrics.response_report(requests).filter("not is_total")
    named = [
        ("request", metrics.request_report(requests).filter("level = 0"), F.col("method"), {"n": "n", "bytes": "n_bytes"}),
        ("response", responses, F.col("outcome").cast("string"), {"n": "n"}),
        ("consumer", metrics.consumer_report(rows).withColumnRenamed("topic", "namespace"), F.lit(None).cast("string"), {"n": "consumed", "invalid": "invalid"}),
        ("sink", metrics.sink_report(rows), F.lit(None).cast("string"), {c: c for c in ("stored", "deleted", "oversized", "failed")}),
    ]
    parts = [
        df.select(F.lit(meter).alias("meter"), "namespace", item.alias("item"), F.lit(name).alias("measure"), F.col(c).alias("value"))
        for meter, df, item, measures in named
        for name, c in measures.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def sinks_by_configuration(spark, sf_dir):
    """Rows and payload bytes that each configured sink holds: payloads alone, a caller's own writer, stamped JSON, a replay plan."""
    path = workspace(spark, "sinks")

    def own(df: DataFrame, batch_id: int) -> None:
        batches.write_batch(df.select("namespace", "id", "action", "payload"), f"{path}/own", batch_id)

    routes = {"telemetry": "records", "metrics": "own", "testpilot_.+": "archive_stamped", "marketplace_.+": "replay"}
    stream = arrivals(fx.messages(spark, sf_dir), "configured", F.col("ts_ms"))
    ingest.run_consumer(stream, path, routes=routes, validators=JSON, writers={"own": own}).awaitTermination()
    bodies = {"records": "payload", "own": "payload", "archive_stamped": "value", "replay": "body"}
    parts = [
        batches.read_batches(spark, f"{path}/{sink}").agg(
            F.lit(sink).alias("sink"),
            n_rows(),
            F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("n_bytes"),
            F.count_if(F.decode(body, "UTF-8").contains('"ingest_ts":')).alias("n_stamped"),
        )
        for sink, body in bodies.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
