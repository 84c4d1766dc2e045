"""Binary message envelopes (protocol buffers).

Python touches rows only here, in Arrow batches; the message class is built
from a descriptor inside the task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sluiceway.schemas import CREATE_UPDATE, DELETE, MESSAGES

# Field numbers and wire types of the envelope.
FIELDS = [
    ("namespace", 2, "STRING"),
    ("id", 3, "STRING"),
    ("ip_addr", 4, "BYTES"),
    ("payload", 5, "BYTES"),
    ("timestamp", 6, "SINT64"),
    ("operation", 7, "ENUM"),
    ("api_version", 8, "STRING"),
    ("partition", 9, "STRING"),
]
OPERATIONS = [CREATE_UPDATE, DELETE]

ENCODED = T.StructType(
    [f for f in MESSAGES if f.name in ("seq", "shard", "ord")]
    + [
        T.StructField("topic", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.BinaryType()),
    ]
)
DECODED = T.StructType(MESSAGES.fields + [T.StructField("reason", T.StringType())])


def _envelope():
    """The message class; made once per task."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    kinds = descriptor_pb2.FieldDescriptorProto
    spec = descriptor_pb2.FileDescriptorProto(name="envelope.proto", package="envelope", syntax="proto2")
    message = spec.message_type.add(name="Message")
    operation = message.enum_type.add(name="Operation")
    for number, name in enumerate(OPERATIONS):
        operation.value.add(name=name, number=number)
    for name, number, kind in FIELDS:
        field = message.field.add(name=name, number=number, type=getattr(kinds, f"TYPE_{kind}"))
        field.label = kinds.LABEL_REPEATED if name == "partition" else kinds.LABEL_OPTIONAL
        if kind == "ENUM":
            field.type_name = ".envelope.Message.Operation"
            field.default_value = CREATE_UPDATE
    pool = descriptor_pool.DescriptorPool()
    pool.Add(spec)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("envelope.Message"))


def _encode_row(envelope, row: dict) -> bytes:
    message = envelope()
    for name in ("namespace", "id", "ip_addr", "payload", "api_version"):
        if row[name] is not None:
            setattr(message, name, row[name])
    if row["ts_ms"] is not None:
        message.timestamp = row["ts_ms"]
    if row["operation"] is not None:
        message.operation = OPERATIONS.index(row["operation"])
    message.partition.extend(row["partition"] or [])
    return message.SerializeToString()


def _decode_row(envelope, value: bytes | None) -> dict | None:
    from google.protobuf.message import DecodeError

    if value is None:
        return None
    try:
        message = envelope.FromString(value)
    except DecodeError:
        return None

    def given(field):
        return getattr(message, field) if message.HasField(field) else None

    return {
        "namespace": message.namespace,
        "id": given("id"),
        "ip_addr": given("ip_addr"),
        "payload": given("payload"),
        "ts_ms": given("timestamp"),
        "operation": OPERATIONS[message.operation],
        "api_version": given("api_version"),
        "partition": list(message.partition),
    }


def encode_messages(df: DataFrame) -> DataFrame:
    """(seq, shard, ord, topic, key, value) with the envelope bytes as ``value``."""

    def encode(batches):
        envelope = _envelope()
        for batch in batches:
            value = pa.array([_encode_row(envelope, r) for r in batch.to_pylist()], pa.binary())
            names = ["seq", "shard", "ord", "namespace", "id"]
            columns = [batch.column(n) for n in names] + [value]
            yield pa.RecordBatch.from_arrays(columns, ENCODED.names)

    return df.select(*MESSAGES.names).mapInArrow(encode, ENCODED)


def decode_messages(df: DataFrame, mode: str = "permissive") -> DataFrame:
    """Typed messages from ``value``.

    permissive: an undecodable row keeps its log position and, as payload, its
    bytes, and gets reason ``undecodable``. failfast: it stops the job.
    """
    if mode not in ("permissive", "failfast"):
        raise ValueError(f"unknown mode {mode!r}")
    names = [n for n in DECODED.names if n not in ("seq", "shard", "ord", "reason")]

    def decode(batches):
        envelope = _envelope()
        for batch in batches:
            values = batch.column("value").to_pylist()
            rows = [_decode_row(envelope, v) for v in values]
            if mode == "failfast" and None in rows:
                raise ValueError(f"undecodable message at seq {batch.column('seq')[rows.index(None)]}")
            columns = {n: batch.column(n) for n in ("seq", "shard", "ord")}
            columns |= {n: [r[n] if r else None for r in rows] for n in names}
            columns["payload"] = [r["payload"] if r else v for r, v in zip(rows, values)]
            columns["reason"] = [None if r else "undecodable" for r in rows]
            types = {"ip_addr": pa.binary(), "payload": pa.binary(), "ts_ms": pa.int64(), "partition": pa.list_(pa.string())}
            arrays = [
                c if isinstance(c, pa.Array) else pa.array(c, types.get(n, pa.string()))
                for n, c in ((n, columns[n]) for n in DECODED.names)
            ]
            yield pa.RecordBatch.from_arrays(arrays, DECODED.names)

    order = F.col("ord") if "ord" in df.columns else F.lit(0)
    return df.select("seq", "shard", order.cast("int").alias("ord"), "value").mapInArrow(decode, DECODED)
