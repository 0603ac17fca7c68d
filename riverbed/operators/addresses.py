"""IPv4 text and numbers, prefixes, and canonical flow keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ip4(text: Column) -> Column:
    """The number of a dotted IPv4 address; null for anything else."""
    part = lambda k: F.split(text, r"\.")[k].cast("bigint")
    return F.when(text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def dotted(number: Column) -> Column:
    """The dotted text of an IPv4 number."""
    part = lambda bits: F.call_function("shiftright", number, F.lit(bits)).bitwiseAND(F.lit(255))
    return F.concat_ws(".", *[part(b).cast("string") for b in (24, 16, 8, 0)])


def mask(prefix: int) -> int:
    return (0xFFFFFFFF << (32 - prefix)) & 0xFFFFFFFF if prefix else 0


def cidr(number: Column, prefix: int) -> Column:
    """The network of an address, as text."""
    return F.concat(dotted(number.bitwiseAND(F.lit(mask(prefix)).cast("bigint"))), F.lit(f"/{prefix}"))


def ip6_hex(text: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, written out or short, with a dotted tail or without."""
    tail = F.regexp_extract(text, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    digits = F.lower(F.lpad(F.hex(ip4(tail)), 8, "0"))
    plain = F.when(tail != "", F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))).otherwise(text)
    sides = F.split(plain, "::")
    groups = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(sides, 0)), groups(F.get(sides, 1))
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
    return F.concat_ws("", F.transform(F.concat(left, zeros, right), lambda g: F.lpad(F.lower(g), 4, "0")))


def sortable(text: Column) -> Column:
    """A key that orders addresses as (family, bytes): IPv4 before IPv6."""
    return F.when(text.contains(":"), F.concat(F.lit("6"), ip6_hex(text))).otherwise(F.concat(F.lit("4"), F.lpad(F.hex(ip4(text)), 8, "0")))


def canonical(df: DataFrame, src: str, sport: str, dst: str, dport: str) -> DataFrame:
    """df with a_ip, a_port, b_ip, b_port (the smaller endpoint first) and direction (a_to_b or b_to_a)."""
    one = F.struct(sortable(F.col(src)).alias("k"), F.col(sport).alias("p"), F.col(src).alias("ip"))
    two = F.struct(sortable(F.col(dst)).alias("k"), F.col(dport).alias("p"), F.col(dst).alias("ip"))
    low, high = F.least(one, two), F.greatest(one, two)
    return df.select("*", low["ip"].alias("a_ip"), low["p"].alias("a_port"), high["ip"].alias("b_ip"), high["p"].alias("b_port"), F.when(one <= two, "a_to_b").otherwise("b_to_a").alias("direction"))


def parse_target(target: str, group_prefix: int = 24) -> str:
    """A throttle target in canonical form: one address, or exactly a network of the group prefix. ValueError for others."""
    import ipaddress

    net = ipaddress.IPv4Network(target if "/" in target else f"{target}/32", strict=False)
    if net.prefixlen not in (32, group_prefix):
        raise ValueError(f"target must be an address or a /{group_prefix} network")
    return str(net)
