"""Arithmetic on addresses in columns, both versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
IPV6 = r"^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$"
CIDR = rf"^{_OCTET}(?:\.{_OCTET}){{3}}/(?:3[0-2]|[12]?[0-9])$"


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(IPV4)


def is_ip(ip: Column) -> Column:
    return ip.rlike(IPV4) | ip.rlike(IPV6)


def to_long(ip: Column) -> Column:
    """Value of a dotted address; null if it is not one."""
    part = lambda n: F.split_part(ip, F.lit("."), F.lit(n)).cast("bigint")
    return F.when(is_ipv4(ip), part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def _bits16(value: Column) -> Column:
    return F.lpad(F.bin(value), 16, "0")


def _bits_v6(ip: Column) -> Column:
    low = F.lower(ip)
    dotted = F.regexp_extract(low, r":([0-9]+(?:\.[0-9]+){3})$", 1)
    tail = to_long(dotted)
    pair = F.concat(F.lower(F.hex(F.floor(tail / 65536))), F.lit(":"), F.lower(F.hex(tail % 65536)))
    low = F.when(dotted != "", F.concat(F.regexp_replace(low, r"[^:]*$", ""), pair)).otherwise(low)
    halves = F.split(low, "::", -1)
    groups = lambda n: F.filter(F.split(F.get(halves, F.lit(n)), ":", -1), lambda g: g != "")
    left, right = groups(0), F.coalesce(groups(1), F.array().cast("array<string>"))
    missing = F.lit(8) - F.size(left) - F.size(right)
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    colons = F.length(low) - F.length(F.replace(low, F.lit(":")))
    ok = ~low.rlike(":::|^:[^:]|[^:]:$") & F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & (((F.size(halves) == 1) & (missing == 0) & (colons == 7)) | ((F.size(halves) == 2) & (missing >= 1)))
    return F.when(ok, F.array_join(F.transform(full, lambda g: _bits16(F.conv(g, 16, 10).cast("bigint"))), ""))


def address_bits(ip: Column) -> Column:
    """The version and the bits of an address, as in ``4:0101...``; null if it is none."""
    v4 = to_long(ip)
    return F.when(is_ipv4(ip), F.concat(F.lit("4:"), F.lpad(F.bin(v4), 32, "0"))).when(ip.rlike(IPV6), F.concat(F.lit("6:"), _bits_v6(ip)))


def network_bits(cidr: Column) -> Column:
    """The version and leading bits of a network; null for a malformed one, whose length or address is not valid."""
    address = address_bits(F.substring_index(cidr, "/", 1))
    text = F.substring_index(cidr, "/", -1)
    length = F.when(cidr.contains("/") & text.rlike("^[0-9]{1,3}$"), text.cast("int"))
    return F.when(length <= F.length(address) - 2, F.substr(address, F.lit(1), length + 2))
