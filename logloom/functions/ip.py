"""IP addresses. IPv4 is arithmetic on columns; IPv6 text is read and written by the system's own routines."""

from __future__ import annotations

import ipaddress
import socket

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fallible import Fallible, fallible

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def is_ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(V4), F.lit(False))


@F.pandas_udf(T.BinaryType())
def _pton(values: pd.Series) -> pd.Series:
    def one(v):
        try:
            return socket.inet_pton(socket.AF_INET6 if ":" in v else socket.AF_INET, v)
        except (OSError, TypeError, ValueError):
            return None

    return values.map(one)


@F.pandas_udf(T.StringType())
def _ntop(values: pd.Series) -> pd.Series:
    def one(v):
        return None if v is None or len(v) not in (4, 16) else socket.inet_ntop(socket.AF_INET if len(v) == 4 else socket.AF_INET6, bytes(v))

    return values.map(one)


def is_ipv6(c: Column) -> Column:
    return F.coalesce(F.octet_length(_pton(c)) == 16, F.lit(False))


def ip_aton(c: Column) -> Fallible:
    """IPv4 text as a number."""
    parts = F.split(c, r"\.")
    number = sum((F.get(parts, k).try_cast("bigint") * (1 << (24 - 8 * k)) for k in range(4)), F.lit(0))
    return fallible(c.rlike(V4), number, "ip_aton: not an IPv4 address")


def ip_ntoa(c: Column) -> Column:
    """The low 32 bits as IPv4 text."""
    return F.concat_ws(".", *[F.shiftright(c.cast("bigint"), 24 - 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in range(4)])


def ip_pton(c: Column) -> Column:
    """4 or 16 bytes, null if the text is no address."""
    return _pton(c)


def ip_ntop(c: Column) -> Column:
    return _ntop(c)


def ip_to_ipv6(c: Column) -> Fallible:
    return fallible(c.rlike(V4), F.concat(F.lit("::ffff:"), c), "ip_to_ipv6: not an IPv4 address")


def ipv6_to_ipv4(c: Column) -> Fallible:
    """IPv4-mapped addresses alone."""
    raw = _pton(c)
    mapped = (F.octet_length(raw) == 16) & (F.hex(F.substring(raw, 1, 12)) == "00000000000000000000FFFF")
    return fallible(mapped, _ntop(F.substring(raw, 13, 4)), "ipv6_to_ipv4: not an IPv4-mapped address")


def ip_cidr_contains(cidr: str, c: Column) -> Column:
    """Whether an address is in a block; of the other family, never. A block without a prefix is one host."""
    net = ipaddress.ip_network(cidr, strict=False)
    if net.version == 4:
        low, high = int(net.network_address), int(net.broadcast_address)
        return F.coalesce(ip_aton(c).value.between(low, high), F.lit(False))
    low, high = (F.lit(a.packed) for a in (net.network_address, net.broadcast_address))
    raw = _pton(c)
    return F.coalesce((F.octet_length(raw) == 16) & (raw >= low) & (raw <= high), F.lit(False))


def ip_subnet(c: Column, subnet: str) -> Fallible:
    """The network address under /n or a netmask, IPv4."""
    bits = int(subnet[1:]) if subnet.startswith("/") else bin(int(ipaddress.IPv4Address(subnet))).count("1")
    mask = (0xFFFFFFFF << (32 - bits)) & 0xFFFFFFFF
    return fallible(c.rlike(V4), ip_ntoa(ip_aton(c).value.bitwiseAND(F.lit(mask))), "ip_subnet: not an IPv4 address")
