"""A small capture of three conversations, built frame by frame, and what the dataflow makes of it."""

from __future__ import annotations

import base64
import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import connections, decode, fragments, http1, matching
from ..operators.sessions import attribute
from . import adapters as A

BASE_NS = 1_715_000_000_000_000_000
FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16
MAC = bytes.fromhex("020000000001020000000002")


def ip(text: str) -> bytes:
    return bytes(map(int, text.split(".")))


def ipv4(src: str, dst: str, protocol: int, body: bytes, number: int = 1, where: int = 0) -> bytes:
    return MAC + b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), number, where, 64, protocol, 0) + ip(src) + ip(dst) + body


def tcp(src: str, sport: int, dst: str, dport: int, seq: int, ack: int, flags: int, data: bytes = b"") -> bytes:
    return ipv4(src, dst, 6, struct.pack(">HHIIBBHHH", sport, dport, seq, ack, 0x50, flags, 65535, 0, 0) + data)


def udp(sport: int, dport: int, data: bytes) -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data


def frames() -> list[bytes]:
    """A whole exchange on port 8080, a reset one on a port that is no service, and an open one."""
    note = b"parcel <7f3a> ready"
    put = b"PUT /parcels/17 HTTP/1.1\r\nHost: depot.example\r\nUser-Agent: courier/5.1\r\nContent-Length: 19\r\n\r\n" + note
    cut = put.index(b"courier")
    a, b = ("172.20.4.9", 31007), ("172.20.8.1", 8080)
    out = [tcp(*a, *b, 77_000, 0, SYN), tcp(*b, *a, 310, 77_001, SYN | ACK), tcp(*a, *b, 77_001, 311, PSH | ACK, put[:cut]), tcp(*a, *b, 77_001 + cut, 311, PSH | ACK, put[cut:])]
    reply = b"HTTP/1.1 201 Created\r\nContent-Length: 4\r\n\r\nkept"
    end = 77_001 + len(put)
    out += [tcp(*b, *a, 311, end, PSH | ACK, reply), tcp(*a, *b, end, 311 + len(reply), FIN | ACK), tcp(*b, *a, 311 + len(reply), end + 1, FIN | ACK)]
    other = ("172.20.5.5", 32555, "172.20.8.2", 7070)
    out += [tcp(*other, 640, 0, SYN), tcp(*other, 641, 0, RST | PSH | ACK, b"GET /elsewhere HTTP/1.1\r\nUser-Agent: stray/0.2\r\n\r\n")]
    left = ("172.20.6.30", 33901, "172.20.8.1", 8080)
    out += [tcp(*left, 5_500, 0, SYN), tcp(*left, 5_501, 0, PSH | ACK, b"GET /still-open HTTP/1.1\r\nHost: depot.example\r\nUser-Agent: waiting/1.4\r\n\r\n")]
    return out


def rows() -> list[tuple[int, int, int, bytes]]:
    return [(k + 1, BASE_NS + k * 1_000_000, len(f), f) for k, f in enumerate(frames())]


def as_frames(spark: SparkSession, data: list[tuple[int, int, int, bytes]]) -> DataFrame:
    text = json.dumps([{"frame_no": n, "ts_ns": t, "wire_len": w, "data": base64.b64encode(d).decode()} for n, t, w, d in data])
    df = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<frame_no:bigint,ts_ns:bigint,wire_len:int,data:string>>")).alias("r")).select("r.*")
    return df.withColumn("data", F.unbase64("data"))


def packets(spark: SparkSession) -> DataFrame:
    return decode.frames_to_packets(as_frames(spark, rows()))


def fragmented(spark: SparkSession) -> DataFrame:
    """A UDP datagram in two fragments that come in the wrong order, and one that is cut off."""
    whole = udp(5000, 8080, b"x" * 32)
    parts = [ipv4("10.0.0.1", "10.0.0.2", 17, whole[16:], 7, 2), ipv4("10.0.0.1", "10.0.0.2", 17, whole[:16], 7, 0x2000), ipv4("10.0.0.3", "10.0.0.2", 17, whole[:16], 8, 0x2000)]
    return fragments.assemble(decode.frames_to_packets(as_frames(spark, [(k + 1, BASE_NS + k, len(f), f) for k, f in enumerate(parts)])))


def events(spark: SparkSession) -> DataFrame:
    """Flow events with HTTP records and messages, in one pass."""
    return connections.dataflow(fragments.assemble(packets(spark)), [8080], [8080])


def messages(spark: SparkSession) -> DataFrame:
    return http1.messages_of(events(spark))


def content(spark: SparkSession) -> DataFrame:
    """All content of the capture, with the service of its flow."""
    e = events(spark)
    named = attribute(connections.flows(e), A.services(spark)).select("flow_id", "service")
    return http1.content_of(connections.chunks(e), e).join(named, "flow_id", "left")


def hits(spark: SparkSession) -> DataFrame:
    """From frames to matches: a literal that was told only later, found in stored content."""
    rule = {"id": "parcel", "revision": 1, "expression": "<7f3a>", "kind": "text", "action": "find", "direction_type": "both", "service": None, "view": None}
    return matching.replay(content(spark).withColumn("ingest_seq", F.lit(1)), [rule]).select("pattern_id", "flow_id", "view", "offset_start", "offset_end", "historical")
