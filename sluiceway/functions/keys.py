"""Document ids and row keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed patterns: the lenient form takes five short hex groups, the strict one 8-4-4-4-12.
LENIENT_UUID = r"^[0-9a-fA-F]{1,8}(-[0-9a-fA-F]{1,4}){3}-[0-9a-fA-F]{1,12}\z"
STRICT_UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"


def valid_uuid(col: Column, strict: bool = False) -> Column:
    return col.rlike(STRICT_UUID if strict else LENIENT_UUID)


def uuid_text(digest: Column) -> Column:
    """32 hex digits in UUID form, computed in one pass over ``digest``."""
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")


def stable_uuid(*parts: Column) -> Column:
    """UUID text that depends only on ``parts``, so a retried task repeats it."""
    return uuid_text(F.md5(F.concat_ws(":", *parts)))


def at_position(*position: Column) -> list[Column]:
    """Text of a log position, nulls told apart from each other's neighbours."""
    return [F.coalesce(p.cast("string"), F.lit("")) for p in position]


def fresh_id(*position: Column, stable: bool = True) -> Column:
    """Id for a record that brings none, from its whole log position. ``stable=False`` draws a random one."""
    return stable_uuid(F.lit("id"), *at_position(*position)) if stable else F.uuid()


def utc_time(ts_ms: Column) -> Column:
    return F.timestamp_millis(ts_ms)


def salted_key(id_col: Column, ts_ms: Column) -> Column:
    """``[salt byte][yyyyMMdd][id]``; null where no key exists.

    The salt byte is the number in the first two characters of the id, minus
    128. Ids that do not start with hex digits have no key: route those rows
    to quarantine.
    """
    head = F.substring(id_col, 1, 2)
    salt = F.pmod(F.conv(head, 16, 10).cast("int") + 128, F.lit(256))
    key = F.concat(
        F.unhex(F.lpad(F.hex(salt), 2, "0")),
        F.encode(F.date_format(utc_time(ts_ms), "yyyyMMdd"), "UTF-8"),
        F.encode(id_col, "UTF-8"),
    )
    return F.when(head.rlike(r"^[0-9a-fA-F]{1,2}\z"), key)


def display_key(key: Column) -> Column:
    """Quoted text of a salted key with the salt byte as ``\\x`` and two hex digits."""
    return F.concat(
        F.lit('"\\x'),
        F.lower(F.hex(F.substring(key, 1, 1))),
        F.decode(F.substring(key, F.lit(2), F.octet_length(key)), "UTF-8"),
        F.lit('"'),
    )
