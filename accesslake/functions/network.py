"""IPv4 helpers: addresses as longs, and compiled IP-group tests."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dotted_quad(key: Column) -> Column:
    """The address ``10.x.y.z`` that stands for an integer key."""
    part = [F.shiftright(key, bits).bitwiseAND(F.lit(255)).cast("string") for bits in (16, 8, 0)]
    return F.concat_ws(".", F.lit("10"), *part)


_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def ip_to_long(address: Column) -> Column:
    """Dotted quad to a number; null when the text is not four octets. The text is split once."""
    octets = F.split(address, r"\.")
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, octet: acc * 256 + octet.cast("bigint"))
    return F.when(address.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), number)


def ip_bounds(spec: str) -> tuple[int, int] | None:
    """First and last address of ``*``, one address, ``a/len`` or ``a-b``; None for ``*``."""
    spec = spec.strip()
    if spec == "*":
        return None
    if "-" in spec:
        low, high = (int(ipaddress.IPv4Address(p.strip())) for p in spec.split("-", 1))
        return low, high
    network = ipaddress.IPv4Network(spec, strict=False)
    return int(network.network_address), int(network.broadcast_address)


def merged(bounds: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges joined, in order."""
    result: list[tuple[int, int]] = []
    for low, high in sorted(bounds):
        if result and low <= result[-1][1] + 1:
            result[-1] = (result[-1][0], max(high, result[-1][1]))
        else:
            result.append((low, high))
    return result


def ip_in(address: Column, specs: Iterable[str]) -> Column:
    """True when the address lies in any of the group's entries. A bare ``*`` takes everything.

    The address is turned into a number once per row, however many ranges the group has.
    """
    bounds = [ip_bounds(s) for s in specs]
    if any(b is None for b in bounds):
        return F.lit(True)
    ranges = merged(bounds)
    if not ranges:
        return F.lit(False)

    def inside(number: Column) -> Column:
        return reduce(Column.__or__, [number.between(low, high) for low, high in ranges])

    return F.coalesce(F.exists(F.array(ip_to_long(address)), inside), F.lit(False))
