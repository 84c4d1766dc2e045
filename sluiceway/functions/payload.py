"""Payload encoding and JSON."""

from __future__ import annotations

import json
import re
import zlib

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType, BooleanType

# Fixed value: media type that implies a deflated body.
ZLIB_JSON = "application/json+zlib"


def text(payload: Column) -> Column:
    """Payload bytes as a string; text columns pass through."""
    return payload.cast("string")


def effective_encoding(content_encoding: Column, content_type: Column) -> Column:
    """Content encoding, with ``deflate`` filled in for zlib JSON that names none."""
    return F.when(content_encoding.isNull() & content_type.startswith(ZLIB_JSON), "deflate").otherwise(
        content_encoding
    )


def _inflate_one(data):
    """Whole body out of gzip, zlib or raw deflate; None when corrupt or cut short."""
    if data is None:
        return None
    for wbits in (zlib.MAX_WBITS | 32, -zlib.MAX_WBITS):
        stream = zlib.decompressobj(wbits)
        try:
            out = stream.decompress(data) + stream.flush()
        except zlib.error:
            continue
        if stream.eof:
            return out
    return None


@F.pandas_udf(BinaryType())
def inflate(body: pd.Series) -> pd.Series:
    return body.map(_inflate_one)


def valid_json(payload: Column, mode: str = "strict") -> Column:
    """Well-formed JSON test.

    strict: exactly one JSON value, natively. The parser stops after one value,
    so the payload is parsed as the first of two array elements; the second is
    the payload's own digest, which no payload can contain, hence a payload
    with trailing text or several values never leaves it at position 1.

    token_stream: any run of JSON values, also none at all (an Arrow UDF).
    """
    if mode == "token_stream":
        return _json_token_stream(text(payload))
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    body = text(payload)
    mark = F.md5(body)
    framed = F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"'), mark, F.lit('"]')))
    return F.coalesce(
        F.is_valid_utf8(body) & (F.try_variant_get(framed, "$[1]", "string") == mark), F.lit(False)
    )


def _reject_constant(name):
    raise ValueError(name)


_SPACE = re.compile(r"[ \t\n\r]*")


def _tokens_ok(body):
    if body is None:
        return False
    decoder = json.JSONDecoder(
        parse_constant=_reject_constant, parse_int=len, parse_float=len, object_pairs_hook=len
    )
    pos = _SPACE.match(body).end()
    try:
        while pos < len(body):
            _, end = decoder.raw_decode(body, pos)
            pos = _SPACE.match(body, end).end()
            # Numbers and words need a space before the next value.
            if pos == end < len(body) and body[end - 1] not in '"]}':
                return False
    except (ValueError, RecursionError):
        return False
    return True


@F.pandas_udf(BooleanType())
def _json_token_stream(body: pd.Series) -> pd.Series:
    return body.map(_tokens_ok).astype("boolean")


def merge_timestamp(payload: Column, ts_ms: Column, field: str = "ingest_ts") -> Column:
    """The payload's JSON object with ``field`` set to ``ts_ms``; null when it is no object.

    The field is written before the closing brace, so all else stays as sent,
    long numbers included. Only an object that has the field already, or that
    other text follows, is taken apart; its numbers of more than 38 digits
    become floating-point.
    """
    body = text(payload)
    members = F.try_parse_json(body).try_cast("map<string,variant>")
    stamp = F.create_map(F.lit(field), ts_ms.cast("variant"))
    rebuilt = F.to_json(F.map_concat(F.map_filter(members, lambda k, _: k != field), stamp))
    mark = F.concat(F.when(F.cardinality(members) > 0, ",").otherwise(""), F.lit(json.dumps(field) + ":"), F.coalesce(ts_ms.cast("string"), F.lit("null")))
    open_object = F.regexp_replace(body, r"(?s)\}[ \t\r\n]*\z", "")
    written = ~F.map_contains_key(members, field) & valid_json(body)
    return F.when(written, F.concat(open_object, mark, F.lit("}"))).when(members.isNotNull(), rebuilt)
