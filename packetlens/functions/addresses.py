"""Canonical spelling of network addresses, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: an IPv4 address written inside an IPv6 one
_MAPPED = r"^\[?(?:(?:0*:){2,6}|::)ffff:(?:0*:)?(?=\d+\.)"
_HEX_MAPPED = r"^\[?(?:(?:0*:){2,6}|::)ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})\]?$"
_QUAD = r"^\d{1,10}\.\d{1,10}\.\d{1,10}\.\d{1,10}$"
#: four numbers as they should be written: nothing is left to do
_PLAIN = r"^(?:0|[1-9]\d{0,9})(?:\.(?:0|[1-9]\d{0,9})){3}$"


def _full_ipv6(text: Column) -> Column:
    """Eight groups without leading zeros, "::" written out; other texts as they are."""
    bare = F.regexp_replace(text, r"^\[|\]$", "")
    sides = F.split(bare, "::")
    head, tail = (F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda g: g != "") for i in (0, 1))
    missing = F.lit(8) - F.size(head) - F.size(tail)
    zeros = F.when(F.size(sides) == 2, F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>"))
    groups = F.transform(F.concat(head, zeros, tail), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    sound = bare.rlike("^[0-9a-f:]*:[0-9a-f:]*$") & (F.size(groups) == 8) & (F.size(sides) <= 2)
    return F.when(sound, F.array_join(groups, ":")).otherwise(text)


def canonical_ip(address: Column) -> Column:
    """One spelling per address: blanks, letter case, leading zeros of octets and the
    IPv6-mapped notations of an IPv4 address do not matter; other IPv6 addresses are written
    out in full.  Blank gives NULL, what is no address stays as it is."""
    text = F.lower(F.trim(F.regexp_replace(address, r"^\s+|\s+$", "")))
    mapped = F.regexp_replace(F.regexp_replace(text, _MAPPED, ""), r"\]$|/32$", "")
    hi, lo = (F.conv(F.regexp_extract(text, _HEX_MAPPED, k), 16, 10).cast("int") for k in (1, 2))
    from_hex = F.concat_ws(
        ".", F.shiftright(hi, 8), hi.bitwiseAND(255), F.shiftright(lo, 8), lo.bitwiseAND(255)
    )
    quad = F.regexp_replace(mapped, r"(^|\.)0+(?=\d)", "$1")
    return (
        F.when(address.rlike(_PLAIN), address)
        .when(F.length(text) == 0, F.lit(None).cast("string"))
        .when(mapped.rlike(_QUAD), quad)
        .when(text.rlike(_HEX_MAPPED), from_hex)
        .otherwise(_full_ipv6(text))
    )
