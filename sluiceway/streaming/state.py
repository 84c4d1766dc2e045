"""Keyed state as a stateful stream, with tombstones that expire."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluiceway.operators.state import HORIZON_MS, KEY, ORDER, is_alive, partial_state

# Bytes of rows that are combined at a time.
BULK_BYTES = 32 << 20

PARTIAL = T.StructType(
    [
        T.StructField("namespace", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("newest_ms", T.LongType()),
        T.StructField("put_ms", T.LongType()),
        T.StructField("put_seq", T.LongType()),
        T.StructField("put_ord", T.IntegerType()),
        T.StructField("put_shard", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("del_ms", T.LongType()),
        T.StructField("is_put", T.BooleanType()),
        T.StructField("times", T.ArrayType(T.LongType())),
    ]
)
OUTPUT = T.StructType(
    [f for f in PARTIAL if f.name not in ("newest_ms", "put_ord", "put_shard", "is_put", "times")]
    + [T.StructField("alive", T.BooleanType()), T.StructField("reason", T.StringType()), T.StructField("n", T.LongType())]
)


def _in_bulk(batches):
    """Arrow batches put together up to ``BULK_BYTES``: the larger, the more rows of a key meet."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BULK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _combine(batches):
    """The last put and the last delete per key and run of Arrow batches, each with its own time.

    A hot key so reaches its task pre-merged, and whether a row is late does
    not depend on which others it was merged with: ``times`` has those of all
    merged rows. Rows without a time, which are never late, are merged by
    themselves. The time of the batch's newest row goes on in a row of its own,
    so that it moves the watermark while no other row is dropped by it.
    """
    whole = pc.ScalarAggregateOptions(skip_nulls=False)
    for t in _in_bulk(batches):
        t = t.append_column("at", t["ts_ms"]).append_column("rank", pc.fill_null(t["ts_ms"], -(1 << 63)))
        t = t.sort_by([(c, "ascending") for c in ("rank", *ORDER[1:])])
        is_put, timed = pc.equal(t["action"], "store"), pc.is_valid(t["ts_ms"])
        for some in (timed, pc.invert(timed)):
            puts = t.filter(pc.and_(is_put, some)).group_by(KEY, use_threads=False)
            puts = puts.aggregate([*[(c, "last", whole) for c in (*ORDER, "payload")], ("at", "list")])
            dels = t.filter(pc.and_(pc.invert(is_put), some)).group_by(KEY, use_threads=False)
            dels = dels.aggregate([("ts_ms", "last", whole), ("at", "list")])
            names = {"ts_ms_last": "put_ms", "seq_last": "put_seq", "ord_last": "put_ord", "shard_last": "put_shard", "payload_last": "payload", "at_list": "times"}
            dels = dels.rename_columns({"ts_ms_last": "del_ms", "at_list": "times"})
            for part, kind in ((puts.rename_columns(names), True), (dels, False)):
                part = part.append_column("is_put", pa.array([kind] * len(part), pa.bool_()))
                columns = [part[f.name] if f.name in part.column_names else pa.nulls(len(part)) for f in PARTIAL]
                yield from pa.table(columns, names=PARTIAL.names).cast(to_arrow_schema(PARTIAL)).to_batches()
        if (newest := pc.max(t["ts_ms"])).is_valid:
            tick = [[newest.as_py()] if f.name == "newest_ms" else [None] for f in PARTIAL]
            yield from pa.table(tick, names=PARTIAL.names).cast(to_arrow_schema(PARTIAL)).to_batches()


class _KeyState(StatefulProcessor):
    """Newest put, unless a delete hides it, newest delete of one key, and whether there ever was one."""

    def __init__(self, horizon_ms: int):
        self._horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._kept = handle.getValueState(
            "kept", "put_ms long, put_seq long, put_ord int, put_shard long, payload binary, del_ms long, has_put boolean, deleted boolean"
        )

    def _hidden(self, put_ms, del_ms, deleted) -> bool:
        if put_ms is None:
            return deleted
        return del_ms is not None and put_ms <= del_ms + self._horizon_ms

    @staticmethod
    def _rank(put) -> tuple:
        return (put[0] is not None, put[0] or 0, *put[1:4])

    def handleInputRows(self, key, rows, timerValues):
        old = self._kept.get()
        put, tomb, has_put, deleted = (tuple(old[:5]), *old[5:]) if old else ((None,) * 5, None, False, False)
        old_tomb, watermark, applied = tomb, timerValues.getCurrentWatermarkInMs(), 0
        for r in rows:
            if r.times is None:
                continue
            behind = [t for t in r.times if 0 < watermark and t is not None and t <= watermark]
            late = len(behind)
            applied += len(r.times) - late
            if late:
                # The merged row is the last one: it is late if all are. Else only the time of the newest late one is known.
                last = late == len(r.times)
                yield Row(
                    namespace=key[0], id=key[1], put_ms=max(behind) if r.is_put else None, put_seq=r.put_seq if last else None,
                    payload=r.payload if last else None, del_ms=None if r.is_put else max(behind), alive=False, reason="late", n=late,
                )
                if last:
                    continue
            if r.is_put:
                new = (r.put_ms, r.put_seq, r.put_ord, r.put_shard, r.payload)
                if not has_put or self._rank(new) > self._rank(put):
                    put, has_put = new, True
            if r.del_ms is not None and (tomb is None or r.del_ms > tomb):
                tomb = r.del_ms
        if not applied:
            return
        deleted = deleted or tomb is not None
        if has_put and self._hidden(put[0], tomb, deleted):
            put, has_put = (None,) * 5, False  # later deletes only hide more
        if has_put or deleted:
            self._kept.update((*put, tomb, has_put, deleted))
        if tomb != old_tomb:
            if old_tomb is not None:
                self._handle.deleteTimer(old_tomb + self._horizon_ms)
            self._handle.registerTimer(tomb + self._horizon_ms)
        yield Row(
            namespace=key[0], id=key[1], put_ms=put[0], put_seq=put[1], payload=put[4], del_ms=tomb,
            alive=has_put, reason=None, n=applied,
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Past the horizon no later write with a time can be hidden: forget when, not that, the key was deleted."""
        kept = self._kept.get()
        if kept and kept[5] is not None and kept[5] + self._horizon_ms == expiredTimerInfo.getExpiryTimeInMs():
            self._kept.update((*kept[:5], None, *kept[6:]))
        return iter(())

    def close(self) -> None:
        pass


def keyed_state_stream(
    actions: DataFrame, horizon_ms: int = HORIZON_MS, lateness: str | None = None
) -> DataFrame:
    """Update-mode stream of the changed keys; the newest row per key equals the batch result.

    Without ``lateness`` this is the batch aggregation run as a stream: all in
    the JVM, merged per key before the shuffle, any row order, but tombstones
    stay in the state for good.

    With it, the time of a tombstone leaves the state once the horizon has passed. Rows with a time may
    then come at most ``lateness`` behind the newest one: a put later than that
    could show again a key whose tombstone has expired. Later rows change
    nothing and come out with reason ``late``; ``n`` says of these, and of the
    other rows that come out, how many rows of the input they stand for
    (puts, and deletes, of a key in a run of Arrow batches are merged to the last,
    which alone has its payload), so that every row is either applied or late. Rows without a time are never
    late; as any delete hides such a put, however old, a flag of each deleted
    key stays.
    """
    if lateness is None:
        alive = is_alive(F.col("put_at"), F.col("del_ms"), F.col("deleted"), horizon_ms)
        return partial_state(actions).select(
            *KEY,
            F.col("put_at.ts_ms").alias("put_ms"),
            F.col("put_at.seq").alias("put_seq"),
            "payload",
            "del_ms",
            alive.alias("alive"),
        )
    wanted = actions.filter(F.col("action").isin("store", "delete")).select(
        *KEY, *ORDER, "action", "payload"
    )
    combined = wanted.mapInArrow(_combine, PARTIAL).withColumn("at", F.timestamp_millis("newest_ms"))
    return (
        combined.withWatermark("at", lateness)
        .groupBy(*KEY)
        .transformWithState(
            _KeyState(horizon_ms), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime"
        )
    )
