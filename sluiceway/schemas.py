"""Row shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

CREATE_UPDATE = "CREATE_UPDATE"
DELETE = "DELETE"

REQUESTS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("shard", T.LongType()),
        T.StructField("recv_ms", T.LongType()),
        T.StructField("method", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("remote_addr", T.StringType()),
        # lower-cased header name -> every value sent under that name
        T.StructField("headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("body", T.BinaryType()),
    ]
)

# seq/shard are the log coordinates; ord numbers the messages that one request
# expands to (0 = the submission, 1.. = the documents it makes obsolete).
MESSAGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("shard", T.LongType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("ip_addr", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("operation", T.StringType()),
        T.StructField("api_version", T.StringType()),
        T.StructField("partition", T.ArrayType(T.StringType())),
    ]
)

POLICY = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("suffix", T.StringType()),
    ]
)
