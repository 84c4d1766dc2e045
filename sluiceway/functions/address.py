"""Client addresses: forwarded header first, socket address otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_QUAD = f"{_OCTET}(?:[.]{_OCTET}){{3}}"


def client_addr(forwarded: Column, remote_addr: Column) -> Column:
    """First entry of the forwarded header, untrimmed; a leading comma keeps it whole."""
    first = F.when(F.instr(forwarded, ",") > 1, F.substring_index(forwarded, ",", 1)).otherwise(forwarded)
    return F.coalesce(first, remote_addr)


def _quad_number(addr: str) -> str:
    """A dotted quad as a number."""
    octets = [
        f"try_cast(substring_index(substring_index({addr}, '.', {half}), '.', {end}) AS bigint)"
        for half in (2, -2)
        for end in (1, -1)
    ]
    return "({} * 16777216 + {} * 65536 + {} * 256 + {})".format(*octets)


# In the expressions below, transform(array(x), name -> use)[0] evaluates x once
# however often the use mentions it.

# A dotted-quad tail stands for the last two 16-bit groups.
_TAIL_AS_GROUPS = f"""
    CASE WHEN contains(addr, '.') THEN
      transform(array(regexp_extract(addr, ':({_QUAD})$', 1)), tail ->
        transform(array(lpad(hex({_quad_number('tail')}), 8, '0')), d ->
          left(addr, length(addr) - length(tail)) || left(d, 4) || ':' || right(d, 4))[0])[0]
    ELSE addr END"""

# All eight groups, with the zero groups that "::" stands for; null when that does not give eight.
_EIGHT_GROUPS = """
    transform(array(array(
        CASE WHEN halves[0] = '' THEN cast(array() AS array<string>) ELSE split(halves[0], ':') END,
        CASE WHEN coalesce(get(halves, 1), '') = '' THEN cast(array() AS array<string>) ELSE split(halves[1], ':') END)),
      side -> CASE
        WHEN (size(halves) = 1 AND size(side[0]) = 8) OR (size(halves) = 2 AND size(side[0]) + size(side[1]) < 8)
        THEN concat(side[0], array_repeat('0', 8 - size(side[0]) - size(side[1])), side[1]) END)[0]"""

# IPv4-mapped addresses are the 4 address bytes alone.
_PACKED = """
    CASE WHEN forall(groups, g -> g RLIKE '^[0-9a-fA-F]{1,4}$') THEN
      transform(array(lower(array_join(transform(groups, g -> lpad(g, 4, '0')), ''))), d ->
        unhex(CASE WHEN startswith(d, '00000000000000000000ffff') THEN right(d, 8) ELSE d END))[0] END"""

_IPV6_BYTES = f"""
    transform(transform(array(split({_TAIL_AS_GROUPS}, '::')), halves -> {_EIGHT_GROUPS}), groups -> {_PACKED})[0]"""


def address_bytes(addr: str) -> Column:
    """Network-order bytes of the IP literal in column ``addr``; null for anything else (no name lookup)."""
    text = F.col(addr)
    quad = F.expr(f"unhex(lpad(hex({_quad_number(addr)}), 8, '0'))")
    ipv6 = F.expr(f"transform(array({addr}), addr -> {_IPV6_BYTES})[0]")
    return F.when(text.rlike(f"^{_QUAD}" + r"\z"), quad).when(text.rlike(r"^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*\z"), ipv6)
