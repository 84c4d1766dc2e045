"""Request parsing and the admission decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.functions.address import address_bytes, client_addr
from sluiceway.functions.keys import fresh_id, valid_uuid
from sluiceway.functions.paths import is_api_version, path_element, path_elements
from sluiceway.functions.payload import effective_encoding, inflate
from sluiceway.operators.pin import pin
from sluiceway.operators.policy import attach_settings

DEFAULT_MAX_BODY = 1_048_576
SUBMIT = "submit"
ID_VALIDATION = ".id.validation"
ALLOW_DELETE = ".allow.delete.access"


# A request's place in the log: seq counts within a shard.
REQUEST_POSITION = ("namespace", "shard", "seq")


def header(name: str, index: int = 0) -> Column:
    """First (or ``index``-th) value of a header."""
    return F.get(F.col("headers")[name], F.lit(index))


def parse_requests(df: DataFrame) -> DataFrame:
    """Split ``uri`` into api_version, endpoint, namespace, id and partition."""
    path = F.col("_path")
    shift = F.when(is_api_version(path_element(path, 0)), 1).otherwise(0)
    at = F.col("_shift")
    return (
        df.withColumn("_path", path_elements(F.col("uri")))
        .withColumn("_shift", shift)
        .withColumns(
            {
                "api_version": F.when(at == 1, path_element(path, 0)),
                "endpoint": path_element(path, at),
                "namespace": path_element(path, at + 1),
                "id": path_element(path, at + 2),
                "partition": F.slice(path, at + 4, F.greatest(F.size(path) - at - 3, F.lit(0))),
                "user_agent": header("user-agent"),
            }
        )
        .drop("_path", "_shift")
    )


def assign_ids(df: DataFrame, stable: bool = True) -> DataFrame:
    """Give rows without an id one derived from their log position (or a random one)."""
    return df.withColumn("id", F.coalesce(F.col("id"), fresh_id(*map(F.col, REQUEST_POSITION), stable=stable)))


def body_size(body: Column) -> Column:
    return F.coalesce(F.octet_length(body), F.lit(0))


def max_body(df: DataFrame, limit: int = DEFAULT_MAX_BODY) -> DataFrame:
    """Drop requests whose body is larger than ``limit`` bytes."""
    if limit <= 0:
        raise ValueError("the body limit must be positive")
    return df.filter(body_size(F.col("body")) <= limit)


def valid_namespace(namespace: Column, patterns: list[str], anchored: bool = False) -> Column:
    """Whitelist test; ``*`` is one or more characters, other regex syntax stays live.

    The pattern may match anywhere in the name unless ``anchored``.
    """
    if not patterns:
        raise ValueError("no valid namespace given")
    regex = "(" + "|".join(p.replace("*", ".+") for p in patterns) + ")"
    if anchored:
        regex = "^" + regex + r"\z"
    return F.coalesce(namespace.rlike(regex), F.lit(False))


def classify_requests(
    df: DataFrame,
    policy: DataFrame,
    namespaces: list[str],
    limit: int = DEFAULT_MAX_BODY,
    strict_ids: bool = False,
    anchored: bool = False,
) -> DataFrame:
    """Parse requests and add ``outcome`` (status code) and ``reason`` (null unless rejected).

    The first rule that fires decides, cheap rules first.
    """
    if limit <= 0:
        raise ValueError("the body limit must be positive")
    parsed = attach_settings(
        parse_requests(df),
        policy,
        {"check_id": (ID_VALIDATION, "true"), "may_delete": (ALLOW_DELETE, "false")},
    )
    size, uri, ns, doc, method = (
        body_size(F.col("body")),
        F.col("uri"),
        F.col("namespace"),
        F.col("id"),
        F.col("method"),
    )
    is_write = method.isin("POST", "PUT")
    rules = [
        (size > limit, 413, "body_too_large"),
        (uri.isin("/", ""), 200, None),
        (~valid_namespace(ns, namespaces, anchored), 404, "namespace"),
        (F.col("check_id") & doc.isNotNull() & ~valid_uuid(doc, strict_ids), 404, "id"),
        (method == "GET", 403, "get_denied"),
        ((method == "DELETE") & ~F.col("may_delete"), 403, "delete_denied"),
        (~(is_write | (method == "DELETE")), 403, "method_denied"),
        (F.coalesce(F.col("endpoint"), F.lit("")) != SUBMIT, 404, "endpoint"),
        (is_write & (size == 0), 400, "empty_body"),
        (is_write, 201, None),
        (method == "DELETE", 200, None),
    ]
    # One verdict number decides; outcome and reason only look it up.
    verdict = F.when(rules[0][0], 0)
    for n, (test, _, _) in enumerate(rules[1:], 1):
        verdict = verdict.when(test, n)
    last = len(rules)
    codes = F.array(*[F.lit(code) for _, code, _ in rules], F.lit(500))
    reasons = F.array(*[F.lit(why).cast("string") for _, _, why in rules], F.lit("method_missing"))
    decided = parsed.withColumn("_verdict", verdict.otherwise(last)).drop("check_id", "may_delete")
    return pin(
        decided, {"outcome": F.get(codes, F.col("_verdict")), "reason": F.get(reasons, F.col("_verdict"))}
    ).drop("_verdict")


def is_handled() -> Column:
    """Reached the submission step as POST, PUT or DELETE: 201, 400 and 200 deletes."""
    return F.col("outcome").isin(201, 400) | ((F.col("outcome") == 200) & ~F.col("uri").isin("/", ""))


def inflate_payloads(df: DataFrame) -> DataFrame:
    """Decode compressed bodies; adds ``inflate_failed``.

    Size limits apply to the compressed body, so run this after them. A
    corrupt body becomes null. Only compressed bodies go through Python.
    """
    encoding = effective_encoding(header("content-encoding"), header("content-type"))
    coded = F.lower(encoding).isin("gzip", "x-gzip", "deflate", "x-deflate")
    out = df.withColumn("_coded", F.coalesce(coded, F.lit(False))).withColumn(
        "_plain", inflate(F.when(F.col("_coded"), F.col("body")))
    )
    return (
        out.withColumn(
            "inflate_failed", F.col("_coded") & F.col("body").isNotNull() & F.col("_plain").isNull()
        )
        .withColumn("body", F.when(F.col("_coded"), F.col("_plain")).otherwise(F.col("body")))
        .drop("_coded", "_plain")
    )


def inflate_admitted(classified: DataFrame) -> DataFrame:
    """Decode the bodies of classified requests and correct the outcome of what that shows.

    A corrupt body of an admitted request is a server error (500
    ``corrupt_body``), one that is empty once decoded a bad request.
    """
    opened = inflate_payloads(classified)
    corrupt = F.col("reason").isNull() & is_handled() & F.col("inflate_failed")
    emptied = (F.col("outcome") == 201) & ~F.col("inflate_failed") & (body_size(F.col("body")) == 0)
    return pin(
        opened,
        {
            "outcome": F.when(corrupt, 500).when(emptied, 400).otherwise(F.col("outcome")),
            "reason": F.when(corrupt, "corrupt_body").when(emptied, "empty_body").otherwise(F.col("reason")),
        },
    ).drop("inflate_failed")


def with_client_addr(df: DataFrame) -> DataFrame:
    """Add ``ip_addr``: bytes of the forwarded address, or of the socket address if that is no IP literal."""
    addr = client_addr(header("x-forwarded-for"), F.col("remote_addr"))
    found = F.coalesce(address_bytes("_addr"), address_bytes("remote_addr"))
    return df.withColumn("_addr", addr).withColumn("ip_addr", found).drop("_addr")
