"""The whole path on a stream: requests, or messages of a log, to state, archive, other sinks and quarantine."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from sluiceway.functions.payload import merge_timestamp
from sluiceway.operators.admission import DEFAULT_MAX_BODY, classify_requests, inflate_admitted
from sluiceway.operators.messages import to_messages
from sluiceway.operators.replay import replay_plan
from sluiceway.operators.state import refuse_unsaltable
from sluiceway.operators.validation import DEFAULT_MAX_VALUE, Validator, gate_operations, is_oversized
from sluiceway.sinks.archive import write_archive
from sluiceway.sinks.batches import batch_path, write_batch
from sluiceway.sinks.ledger import commit_ledger, drop_redelivered
from sluiceway.sinks.log import publish_layout
from sluiceway.sinks.rolling import ROLL_BYTES, write_rolling
from sluiceway.sinks.routing import Writer, check_routes, route, write_routed
from sluiceway.sinks.state_table import compact_state, upsert_state

TASK_ROWS = 1_000_000
# What a refused row keeps, so that it can be read and sent again.
REFUSED = ["seq", "shard", "ord", "namespace", "id", "ip_addr", "payload", "ts_ms", "operation", "api_version", "partition", "reason"]


def dispatch(
    messages: DataFrame,
    routes: dict[str, str],
    max_value: int = DEFAULT_MAX_VALUE,
    validators: list[Validator] | None = None,
) -> DataFrame:
    """Messages with ``action``, ``route`` and, for all that is refused, ``reason``.

    Stateless, for a table or a stream. Rows that bring a reason keep it.
    ``routes`` maps namespace patterns to the names of writers.
    """
    gated = route(gate_operations(messages, validators), routes)
    big = (F.col("action") == "store") & is_oversized(F.col("payload"), max_value)
    lost = F.when(F.col("route").isNull(), "unroutable")
    return gated.withColumns(
        {
            "reason": F.coalesce("reason", F.when(big, "oversized"), lost),
            "action": F.when(big, "invalid").otherwise(F.col("action")),
        }
    )


def prepare(
    requests: DataFrame,
    policy: DataFrame,
    namespaces: list[str],
    routes: dict[str, str],
    limit: int = DEFAULT_MAX_BODY,
    max_value: int = DEFAULT_MAX_VALUE,
    validators: list[Validator] | None = None,
    inflated: bool = False,
) -> DataFrame:
    """Requests to dispatched messages, and everything refused on the way, in one pass."""
    classified = classify_requests(requests, policy, namespaces, limit)
    if inflated:
        classified = inflate_admitted(classified)
    return dispatch(to_messages(classified, keep_rejected=True), routes, max_value, validators)


def file_writers(path: str, spread: int | None = None, replay_to: str = "%k", roll_bytes: int = ROLL_BYTES) -> dict[str, Writer]:
    """Writers by name; each writes below its own folder, named by the batch id, so a retry overwrites it.

    state and state_salted: keyed tables. archive: by day; archive_stamped: the
    message time in each JSON payload, what is no object left as it is;
    archive_rolling: by day and shard, in files that roll by size. replay:
    the plan to send stores again. log: messages by topic. records: payloads alone.
    """

    def to_archive(name: str, stamped: bool) -> Writer:
        def write(df: DataFrame, batch_id: int) -> None:
            if stamped:
                merged = F.encode(merge_timestamp(F.col("payload"), F.col("ts_ms")), "UTF-8")
                df = df.withColumn("payload", F.coalesce(merged, "payload"))
            write_archive(df, batch_path(f"{path}/{name}", batch_id), mode="overwrite", spread=spread)

        return write

    return {
        "state": lambda df, i: upsert_state(df, f"{path}/state", i),
        "state_salted": lambda df, i: upsert_state(df, f"{path}/state_salted", i, "salted"),
        "archive": to_archive("archive", False),
        "archive_stamped": to_archive("archive_stamped", True),
        "archive_rolling": lambda df, i: write_rolling(df, f"{path}/archive_rolling", i, roll_bytes),
        "replay": lambda df, i: write_batch(replay_plan(df, replay_to, deletes=True), f"{path}/replay", i),
        "log": lambda df, i: write_batch(publish_layout(df), f"{path}/log", i),
        "records": lambda df, i: write_batch(df.filter("action = 'store'").select("namespace", "payload"), f"{path}/records", i),
    }


def write_outputs(
    rows: DataFrame,
    batch_id: int,
    path: str,
    task_rows: int = TASK_ROWS,
    writers: dict[str, Writer] | None = None,
    used: set[str] | None = None,
) -> None:
    """Write the sinks and the quarantine of one batch of dispatched rows.

    ``writers`` are added to the file writers, or stand in for them by name;
    only those named in ``used`` are called. An archive day is spread over as
    many tasks as keep each near ``task_rows`` rows even if the day holds the
    whole batch.
    """
    # What allows no row key is refused before the outputs part, so that it reaches the quarantine.
    rows = refuse_unsaltable(rows, (F.col("route") == "state_salted") & F.col("reason").isNull())
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        known = file_writers(path, spread=1 + rows.count() // task_rows) | (writers or {})
        wanted = {n: w for n, w in known.items() if n in (used or ("state", "archive"))}
        write_routed(rows.filter("reason is null"), wanted, batch_id)
        write_batch(rows.filter("reason is not null").select(*REFUSED), f"{path}/quarantine", batch_id)
    finally:
        rows.unpersist()


def _start(
    rows: DataFrame,
    path: str,
    routes: dict[str, str],
    trigger: dict | None,
    task_rows: int,
    writers: dict[str, Writer] | None,
    compact_every: int,
    lateness_ms: int | None,
    once: bool,
) -> StreamingQuery:
    check_routes(routes, file_writers(path) | (writers or {}))
    used = set(routes.values())

    def write(df: DataFrame, batch_id: int) -> None:
        if once:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            write_outputs(drop_redelivered(df, f"{path}/ledger", batch_id), batch_id, path, task_rows, writers, used)
            commit_ledger(df, f"{path}/ledger", batch_id)
            df.unpersist()
        else:
            write_outputs(df, batch_id, path, task_rows, writers, used)
        if compact_every and batch_id % compact_every == compact_every - 1:
            for name, mode in (("state", "plain"), ("state_salted", "salted")):
                if name in used:
                    compact_state(df.sparkSession, f"{path}/{name}", lateness_ms=lateness_ms, key_mode=mode)

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_ingest(
    requests: DataFrame,
    path: str,
    trigger: dict | None = None,
    task_rows: int = TASK_ROWS,
    writers: dict[str, Writer] | None = None,
    compact_every: int = 0,
    lateness_ms: int | None = None,
    once: bool = False,
    **settings,
) -> StreamingQuery:
    """Start the stream of requests; ``settings`` as for ``prepare``. Its progress is kept below ``path``.

    ``writers`` adds sinks by name. Every ``compact_every`` batches the state is
    compacted; ``lateness_ms`` says how late rows may come, so that compaction
    can forget the times of old deletes. With ``once`` messages that are
    delivered again, whenever and in whatever order, reach no sink a second time.
    """
    return _start(prepare(requests, **settings), path, settings["routes"], trigger, task_rows, writers, compact_every, lateness_ms, once)


def run_consumer(
    messages: DataFrame,
    path: str,
    trigger: dict | None = None,
    task_rows: int = TASK_ROWS,
    writers: dict[str, Writer] | None = None,
    compact_every: int = 0,
    lateness_ms: int | None = None,
    once: bool = False,
    **settings,
) -> StreamingQuery:
    """Start the stream of decoded log messages; ``settings`` as for ``dispatch``, the rest as for ``run_ingest``."""
    return _start(dispatch(messages, **settings), path, settings["routes"], trigger, task_rows, writers, compact_every, lateness_ms, once)

