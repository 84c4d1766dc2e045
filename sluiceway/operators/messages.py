"""Admitted requests -> messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluiceway.functions.keys import fresh_id
from sluiceway.operators.admission import REQUEST_POSITION, is_handled, with_client_addr
from sluiceway.schemas import CREATE_UPDATE, DELETE, MESSAGES

OBSOLETE = "x-obsolete-document"


def _listed_ids(value: Column) -> Column:
    """Ids of one header value: trailing empty entries drop, an empty value is one empty id."""
    kept = F.regexp_replace(value, r",+\z", "")
    ids = F.transform(F.split(kept, ","), lambda v: F.regexp_replace(v, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""))
    return F.when((kept == "") & (value != ""), F.array().cast("array<string>")).otherwise(ids)


def obsolete_ids(values: Column) -> Column:
    """Every id named by an obsolete-document header, in order."""
    present = F.filter(values, lambda v: v.isNotNull())
    return F.coalesce(F.flatten(F.transform(present, _listed_ids)), F.array().cast("array<string>"))


def to_messages(classified: DataFrame, stable_ids: bool = True, keep_rejected: bool = False) -> DataFrame:
    """Messages of the admitted requests.

    A POST or PUT gives its upsert and then one delete per obsolete document
    it names; these deletes do not need delete permission. A DELETE gives one
    delete. One scan: each request is expanded in place.

    ``keep_rejected`` also lets each rejected request through as one row
    without operation, with the id and body it brought and its reason in an
    extra column ``reason``, so that one pass can serve the quarantine too.
    """
    own_id = F.coalesce(F.col("id"), fresh_id(*map(F.col, REQUEST_POSITION), stable=stable_ids))
    is_delete = F.col("method") == "DELETE"

    def item(doc: Column, operation: Column, payload: Column) -> Column:
        return F.struct(doc.alias("id"), operation.alias("operation"), payload.alias("payload"))

    no_payload = F.lit(None).cast("binary")
    own = F.array(
        item(
            own_id,
            F.when(is_delete, DELETE).otherwise(CREATE_UPDATE),
            F.when(is_delete, no_payload).otherwise(F.col("body")),
        )
    )
    values = F.col("headers")[OBSOLETE]
    # Requests without the header skip the array functions.
    named = F.when(
        values.isNotNull() & ~is_delete,
        F.concat(own, F.transform(obsolete_ids(values), lambda v: item(v, F.lit(DELETE), no_payload))),
    ).otherwise(own)
    admitted = is_handled() & (F.col("outcome") != 400)
    extra = []
    if keep_rejected:
        no_text = F.lit(None).cast("string")
        as_sent = F.array(item(F.col("id"), no_text, F.col("body")))
        named = F.when(F.col("reason").isNotNull(), as_sent).otherwise(named)
        admitted = admitted | F.col("reason").isNotNull()
        extra = [F.col("reason")]
    names = [*MESSAGES.names, *[c for c in ("reason",) if keep_rejected]]
    return with_client_addr(classified.filter(admitted)).select(
        *extra,
        "seq",
        "shard",
        F.col("recv_ms").alias("ts_ms"),
        "namespace",
        "api_version",
        "partition",
        "ip_addr",
        F.posexplode(named).alias("ord", "m"),
    ).select(
        "seq",
        "shard",
        "ord",
        "namespace",
        "m.id",
        "ip_addr",
        "m.payload",
        "ts_ms",
        "m.operation",
        "api_version",
        "partition",
        *names[len(MESSAGES.names) :],
    ).select(*names)


def quarantine(classified: DataFrame) -> DataFrame:
    """Rejected rows, each with its reason."""
    return classified.filter(F.col("reason").isNotNull())
