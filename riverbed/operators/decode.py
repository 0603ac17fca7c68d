"""Frames to packets: Ethernet, VLAN tags, IPv4, IPv6 with extension headers, tunnels, TCP and UDP.

decode() handles one frame of any kind. frames_to_packets() reads plain Ethernet, IPv4, TCP and UDP, whose headers lie at known places, with
expressions, and hands only the other frames to decode(), in Arrow batches. Addresses inside tunnels and VLANs belong to domains of their
own, whose number depends on the tags and, alike for both directions, on the tunnel's ends.
"""

from __future__ import annotations

import hashlib
import ipaddress
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VLAN_TYPES = {0x8100, 0x88A8, 0x9100, 0x9200}
MAX_TAGS, MAX_DEPTH = 4, 3
VXLAN_PORTS = {4789, 8472}
PACKET = "path string, frame_no long, arrival_ns long, ts_ns long, wire_len int, status string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, l2_domain string, seq long, ack long, flags struct<fin:boolean,syn:boolean,rst:boolean,psh:boolean,ack:boolean>, payload binary, payload_len int, eth_src string, fragment struct<version:int,id:long,next:int,offset:int,more:boolean,src_ip:string,dst_ip:string,domain:string,data:binary>"


class Malformed(ValueError):
    """A frame that breaks the rules of some header."""


@dataclass
class Outcome:
    status: str = "ignored"  # packet, fragment, ignored or error
    src_ip: str | None = None
    dst_ip: str | None = None
    src_port: int | None = None
    dst_port: int | None = None
    protocol: str | None = None
    l2_domain: str = "0"
    seq: int | None = None
    ack: int | None = None
    flags: dict | None = None
    payload: bytes | None = None
    eth_src: str | None = None
    fragment: dict | None = None


def need(ok: bool, what: str) -> None:
    if not ok:
        raise Malformed(what)


def blend(domain: str, kind: str, *parts) -> str:
    """A new domain inside another one; never "0"."""
    return hashlib.blake2b("/".join([domain, kind, *map(str, parts)]).encode(), digest_size=8).hexdigest()


def tunnel(domain: str, kind: str, src: str, dst: str, number: int) -> str:
    return blend(domain, kind, *sorted((src, dst)), number)


def decode(frame: bytes) -> Outcome:
    """The outcome of one Ethernet frame; malformed ones have status error."""
    try:
        return ethernet(frame, "0", 0)
    except (Malformed, struct.error, IndexError):
        return Outcome("error")


def ethernet(data: bytes, domain: str, depth: int) -> Outcome:
    need(len(data) >= 14, "short Ethernet header")
    kind, at, tags = int.from_bytes(data[12:14], "big"), 14, 0
    while kind in VLAN_TYPES:
        need(tags < MAX_TAGS and len(data) >= at + 4, "VLAN tags")
        domain = blend(domain, "vlan", int.from_bytes(data[at : at + 2], "big") & 0xFFF)
        kind, at, tags = int.from_bytes(data[at + 2 : at + 4], "big"), at + 4, tags + 1
    out = Outcome()
    if kind == 0x0800:
        out = ipv4(data[at:], domain, depth)
    elif kind == 0x86DD:
        out = ipv6(data[at:], domain, depth)
    out.eth_src = data[6:12].hex(":")
    return out


def ipv4(d: bytes, domain: str, depth: int) -> Outcome:
    need(len(d) >= 20 and d[0] >> 4 == 4, "IPv4 header")
    head, total = (d[0] & 15) * 4, int.from_bytes(d[2:4], "big")
    need(20 <= head <= total <= len(d), "IPv4 length")
    where = int.from_bytes(d[6:8], "big")
    src, dst = str(ipaddress.IPv4Address(d[12:16])), str(ipaddress.IPv4Address(d[16:20]))
    offset, more, body = (where & 0x1FFF) * 8, bool(where & 0x2000), d[head:total]
    if offset or more:
        return fragment(4, int.from_bytes(d[4:6], "big"), d[9], offset, more, src, dst, domain, body)
    return transport(d[9], src, dst, body, domain, depth)


def ipv6(d: bytes, domain: str, depth: int) -> Outcome:
    need(len(d) >= 40 and d[0] >> 4 == 6, "IPv6 header")
    total = 40 + int.from_bytes(d[4:6], "big")
    need(total <= len(d), "IPv6 length")
    src, dst = str(ipaddress.IPv6Address(d[8:24])), str(ipaddress.IPv6Address(d[24:40]))
    kind, at, d = d[6], 40, d[:total]
    while kind in (0, 43, 44, 51, 60):
        need(at + 8 <= total, "IPv6 extension")
        after = d[at]
        if kind == 44:
            where = int.from_bytes(d[at + 2 : at + 4], "big")
            offset, more = where & 0xFFF8, bool(where & 1)
            if offset or more:
                return fragment(6, int.from_bytes(d[at + 4 : at + 8], "big"), after, offset, more, src, dst, domain, d[at + 8 :])
            size = 8  # an atomic fragment is a whole datagram
        else:
            size = (d[at + 1] + 2) * 4 if kind == 51 else (d[at + 1] + 1) * 8
        at += size
        need(at <= total, "IPv6 extension")
        kind = after
    return transport(kind, src, dst, d[at:], domain, depth)


def fragment(version, number, kind, offset, more, src, dst, domain, data) -> Outcome:
    return Outcome("fragment", src, dst, l2_domain=domain, fragment={"version": version, "id": number, "next": kind, "offset": offset, "more": more, "src_ip": src, "dst_ip": dst, "domain": domain, "data": data})


def transport(kind: int, src: str, dst: str, d: bytes, domain: str, depth: int) -> Outcome:
    """The payload of a whole datagram."""
    if kind == 6:
        need(len(d) >= 20, "TCP header")
        sport, dport, seq, ack, bits = struct.unpack(">HHIIH", d[:14])
        head = (bits >> 12) * 4
        need(20 <= head <= len(d), "TCP offset")
        names = ("fin", "syn", "rst", "psh", "ack")
        return Outcome("packet", src, dst, sport, dport, "tcp", domain, seq, ack if bits & 16 else None, {n: bool(bits >> k & 1) for k, n in enumerate(names)}, d[head:])
    if kind == 17:
        need(len(d) >= 8, "UDP header")
        sport, dport, size = struct.unpack(">HHH", d[:6])
        need(8 <= size <= len(d), "UDP length")
        body = d[8:size]
        if dport in VXLAN_PORTS and depth < MAX_DEPTH and len(body) >= 8 and body[0] & 8:
            return ethernet(body[8:], tunnel(domain, "vxlan", src, dst, int.from_bytes(body[4:7], "big")), depth + 1)
        return Outcome("packet", src, dst, sport, dport, "udp", domain, payload=body)
    if depth >= MAX_DEPTH:
        return Outcome()
    if kind == 4:
        return ipv4(d, tunnel(domain, "ipip", src, dst, 4), depth + 1)
    if kind == 41:
        return ipv6(d, tunnel(domain, "ipip", src, dst, 6), depth + 1)
    return gre(d, src, dst, domain, depth) if kind == 47 else Outcome()


def gre(d: bytes, src: str, dst: str, domain: str, depth: int) -> Outcome:
    need(len(d) >= 4, "GRE header")
    flags, kind = struct.unpack(">HH", d[:4])
    if flags & 7:
        return Outcome()
    at, key = 4, 0
    at += 4 * bool(flags & 0xC000)
    if flags & 0x2000:
        need(len(d) >= at + 4, "GRE key")
        key = int.from_bytes(d[at : at + 4], "big")
        at += 4
    at += 4 * bool(flags & 0x1000)
    if flags & 0x4000:  # source routes end with an empty entry: no family and no length
        while True:
            need(len(d) >= at + 4, "GRE route")
            family, size = int.from_bytes(d[at : at + 2], "big"), d[at + 3]
            at += 4 + size
            need(len(d) >= at, "GRE route")
            if not family and not size:
                break
    need(len(d) >= at, "GRE options")
    inner = tunnel(domain, "gre", src, dst, key)
    reader = {0x0800: ipv4, 0x86DD: ipv6, 0x6558: ethernet}.get(kind)
    return reader(d[at:], inner, depth + 1) if reader else Outcome()


def packet_row(frame: dict, wire_len: int, o: Outcome) -> dict:
    return {**{n: frame[n] for n in ("path", "frame_no", "arrival_ns", "ts_ns")}, "wire_len": wire_len, **vars(o), "payload_len": len(o.payload) if o.payload is not None else 0}


def arrow_schema() -> pa.Schema:
    flags = pa.struct([(n, pa.bool_()) for n in ("fin", "syn", "rst", "psh", "ack")])
    part = pa.struct([("version", pa.int32()), ("id", pa.int64()), ("next", pa.int32()), ("offset", pa.int32()), ("more", pa.bool_()), ("src_ip", pa.string()), ("dst_ip", pa.string()), ("domain", pa.string()), ("data", pa.binary())])
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names = ["path string", "frame_no long", "arrival_ns long", "ts_ns long", "wire_len int", "status string", "src_ip string", "dst_ip string", "src_port int", "dst_port int", "protocol string", "l2_domain string", "seq long", "ack long"]
    return pa.schema([(n.split()[0], kinds[n.split()[1]]) for n in names] + [("flags", flags), ("payload", pa.binary()), ("payload_len", pa.int32()), ("eth_src", pa.string()), ("fragment", part)])


def number(data: Column, at: int | Column, size: int) -> Column:
    """size bytes from offset at as a big-endian number; null where there are fewer."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(F.octet_length(data) >= at + size, F.conv(F.hex(F.substring(data, at + 1, F.lit(size))), 16, 10).cast("long"))


def plain_headers(data: Column) -> tuple[Column, dict[str, Column]]:
    """Whether a frame is plain Ethernet, whole IPv4 and sound TCP or UDP that holds no tunnel, and where its parts are."""
    head = number(data, 14, 1).bitwiseAND(F.lit(15)) * 4
    total, protocol, l4 = number(data, 16, 2), number(data, 23, 1), head + 14
    size = total - head  # of the datagram's body
    offset = F.call_function("shiftright", number(data, l4 + 12, 1), F.lit(4)) * 4
    udp = number(data, l4 + 4, 2)
    sport, dport = number(data, l4, 2), number(data, l4 + 2, 2)
    ip = (number(data, 12, 2) == 0x0800) & (F.call_function("shiftright", number(data, 14, 1), F.lit(4)) == 4) & (head >= 20) & (head <= total) & (total <= F.octet_length(data) - 14) & (number(data, 20, 2).bitwiseAND(F.lit(0x3FFF)) == 0)
    tcp_fits = (protocol == 6) & (size >= 20) & (offset >= 20) & (offset <= size)
    udp_fits = (protocol == 17) & (size >= 8) & (udp >= 8) & (udp <= size) & ~dport.isin(*VXLAN_PORTS)
    parts = {"protocol": protocol, "l4": l4, "size": size, "offset": offset, "udp": udp, "sport": sport, "dport": dport}
    return F.coalesce(ip & (tcp_fits | udp_fits), F.lit(False)), parts


def worth_decoding(data: Column, ports: list[int], live_remote: bool = False, local_egress: bool = False) -> Column:
    """False for frames that cannot belong to a service: plain IPv4, or IPv4 behind VLAN tags, of another protocol or other ports.

    Ports on either side count, or only the destination's for live remote traffic, or only the source's for what this host sends. What
    cannot be judged here (fragments, tunnels, IPv6, short frames) is worth decoding. Without any port nothing is.
    """
    if not ports:
        return F.lit(False)
    verdict, tagged = F.lit(True), F.lit(True)
    for tags in range(MAX_TAGS + 1):
        at = 14 + 4 * tags
        l4 = number(data, at, 1).bitwiseAND(F.lit(15)) * 4 + at
        protocol, sport, dport = number(data, at + 9, 1), number(data, l4, 2), number(data, l4 + 2, 2)
        sides = [sport] if local_egress else [dport] if live_remote else [sport, dport]
        fits = sides[0].isin(*ports)
        for x in sides[1:]:
            fits = fits | x.isin(*ports)
        known = protocol.isin(6, 17)
        reject = tagged & (number(data, at - 2, 2) == 0x0800) & (F.call_function("shiftright", number(data, at, 1), F.lit(4)) == 4) & (l4 >= at + 20) & (F.octet_length(data) >= l4) & (number(data, at + 6, 2).bitwiseAND(F.lit(0x3FFF)) == 0)
        reject = reject & ((known & ~fits & ~((protocol == 17) & dport.isin(*VXLAN_PORTS))) | (~known & ~protocol.isin(47, 4, 41)))
        verdict = verdict & ~F.coalesce(reject, F.lit(False))
        tagged = tagged & F.coalesce(number(data, at - 2, 2).isin(*VLAN_TYPES), F.lit(False))
    return verdict


def with_arrival(frames: DataFrame) -> DataFrame:
    """frames with path and arrival_ns, which a table of one capture need not have: frame_no alone orders its frames then."""
    for name, kind, value in (("path", "string", ""), ("arrival_ns", "long", 0)):
        if name not in frames.columns:
            frames = frames.withColumn(name, F.lit(value).cast(kind))
    return frames


def frames_to_packets(frames: DataFrame) -> DataFrame:
    """A row for each frame (frame_no, ts_ns, wire_len, data; path and arrival_ns of several captures), with status packet, fragment,
    ignored or error. Null data counts as an empty frame, which is an error."""
    cols = ["path", "frame_no", "arrival_ns", "ts_ns", "wire_len"]
    rows = with_arrival(frames).select(*cols, F.coalesce("data", F.lit(b"")).alias("data"))
    data = F.col("data")
    plain, at = plain_headers(data)
    tcp = F.col("protocol") == "tcp"
    head = F.when(tcp, F.col("at.offset")).otherwise(8)
    size = F.when(tcp, F.col("at.size")).otherwise(F.col("at.udp")) - head
    bits = number(data, F.col("at.l4") + 13, 1)
    flags = F.struct(*[(bits.bitwiseAND(F.lit(1 << k)) > 0).alias(n) for k, n in enumerate(("fin", "syn", "rst", "psh", "ack"))])
    address = lambda k: F.concat_ws(".", *[number(data, k + j, 1).cast("string") for j in range(4)])
    kind = {f.split()[0]: f.split()[1] for f in PACKET.split(", fragment ")[0].replace(":boolean,", ":boolean;").split(", ")}
    fast = rows.where(plain).withColumn("at", F.struct(*[v.alias(k) for k, v in at.items()])).withColumn("protocol", F.when(F.col("at.protocol") == 6, "tcp").otherwise("udp"))
    values = {
        "status": F.lit("packet"),
        "src_ip": address(26),
        "dst_ip": address(30),
        "src_port": F.col("at.sport"),
        "dst_port": F.col("at.dport"),
        "protocol": F.col("protocol"),
        "l2_domain": F.lit("0"),
        "seq": F.when(tcp, number(data, F.col("at.l4") + 4, 4)),
        "ack": F.when(tcp & (bits.bitwiseAND(F.lit(16)) > 0), number(data, F.col("at.l4") + 8, 4)),
        "flags": F.when(tcp, flags),
        "payload": F.substring(data, F.col("at.l4") + head + 1, size),
        "payload_len": size,
        "eth_src": F.regexp_replace(F.lower(F.hex(F.substring(data, 7, 6))), "(..)(?!$)", "$1:"),
        "fragment": F.lit(None),
    }
    types = {k: v.replace(";", ",") for k, v in kind.items()} | {"fragment": PACKET.split(", fragment ")[1]}
    fast = fast.select(*cols, *[v.cast(types[k]).alias(k) for k, v in values.items()])

    def run(batches):
        schema = arrow_schema()
        for batch in batches:
            yield pa.RecordBatch.from_pylist([packet_row(r, r["wire_len"], decode(r["data"])) for r in batch.to_pylist()], schema=schema)

    return fast.unionByName(rows.where(~plain).mapInArrow(run, PACKET))


def status_counts(packets: DataFrame) -> DataFrame:
    return packets.groupBy("status").count().withColumnRenamed("count", "frames")
