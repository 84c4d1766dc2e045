"""Requests and messages derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluiceway.functions.keys import uuid_text
from sluiceway.operators.admission import classify_requests
from sluiceway.operators.messages import to_messages
from sluiceway.session import configure
from sluiceway.sources.policy_file import policy_frame

NAMESPACES = ["telemetry", "testpilot_*", "marketplace_*", "metrics"]
RULES = {
    "metrics.allow.delete.access": "true",
    "marketplace_*.id.validation": "false",
    "testpilot_*.id.validation": "true",
}
# Small limits, so that every branch fires on the test tables.
MAX_BODY = 64
MAX_VALUE = 8192
ROLL_BYTES = 500
BATCH = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _doc_id(number: Column) -> Column:
    return uuid_text(F.md5((number % 2500).cast("string")))


def requests_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event, headers as columns. ``seq`` counts within a shard."""
    e = F.col("event_id")
    named = events(spark, sf_dir).withColumns(
        {
            "id0": _doc_id(e),
            "id1": _doc_id(e + 1),
            "id2": _doc_id(e + 2),
            "ns": F.expr(
                """CASE event_type WHEN 'click' THEN 'telemetry'
                   WHEN 'view' THEN concat('testpilot_', event_id % 3)
                   WHEN 'purchase' THEN 'marketplace_apps' WHEN 'signup' THEN 'metrics' ELSE 'bogus' END"""
            ),
        }
    )
    return named.selectExpr(
        "event_id div 8 AS seq",
        "event_id % 8 AS shard",
        "unix_millis(ts) AS recv_ms",
        """CASE WHEN event_id % 11 = 0 THEN 'DELETE' WHEN event_id % 29 = 0 THEN 'GET'
           WHEN event_id % 43 = 0 THEN 'OPTIONS' WHEN event_id % 31 = 0 THEN 'PUT' ELSE 'POST' END AS method""",
        """CASE WHEN event_id % 101 = 0 THEN '/' ELSE concat(
             IF(event_id % 3 = 0, '/1.0', ''), IF(event_id % 37 = 0, '/fetch/', '/submit/'), ns,
             CASE WHEN event_id % 23 = 0 THEN '' WHEN event_id % 17 = 0 THEN '/fakeid'
                  ELSE concat('/', id0, IF(event_id % 5 = 0, '/p1/p2', '')) END) END AS uri""",
        "concat('172.16.0.', user_id % 250) AS remote_addr",
        """CASE event_id % 4 WHEN 0 THEN concat('10.0.', event_id % 256, '.7, 10.9.9.9')
           WHEN 1 THEN concat('192.168.1.', event_id % 256) END AS x_forwarded_for""",
        """CASE WHEN event_id % 7 = 0 THEN concat(id1, ', ', id2, ',,') WHEN event_id % 49 = 1 THEN ','
           WHEN event_id % 49 = 2 THEN '' END AS x_obsolete_document""",
        "IF(event_id % 6 = 0, 'application/json+zlib; v=1', 'application/json') AS content_type",
        "IF(event_id % 12 = 0, 'gzip', NULL) AS content_encoding",
        """CASE WHEN event_id % 19 = 0 THEN '' WHEN event_id % 13 = 0 THEN '{ "k : 7 }'
           WHEN event_id % 13 = 1 THEN concat(props, ' x')
           WHEN event_id % 53 = 0 THEN concat('{"pad":"', repeat('x', 100), '"}') ELSE props END AS body""",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in the request shape: a header map and a binary body."""

    headers = ", ".join(
        f"'{name.replace('_', '-')}', IF({name} IS NULL, NULL, array({name}))"
        for name in ("x_forwarded_for", "x_obsolete_document", "content_type", "content_encoding")
    )
    return requests_flat(spark, sf_dir).selectExpr(
        "seq", "shard", "recv_ms", "method", "uri", "remote_addr", f"map({headers}) AS headers", "binary(body) AS body"
    )


def policy(spark: SparkSession) -> DataFrame:
    return policy_frame(spark, RULES)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_requests(requests(spark, sf_dir), policy(spark), NAMESPACES, limit=MAX_BODY)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_messages(classified(spark, sf_dir))
