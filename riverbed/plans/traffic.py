"""Conversations as captured traffic: each one is a flow, each turn the bytes that one side sends, cut into frames.

By number, conversations travel in VLANs, IPv6, tunnels or fragments, over TCP or UDP; segments change places, repeat, or get lost, and
connections end, break off or stay open. TWIN has in SQL what comes out of it.
"""

from __future__ import annotations

import gzip
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import connections, decode, fragments, http1, matching
from ..sources import files
from ..streaming import jobs
from . import adapters as A
from .fixtures import ACK, FIN, MAC, PSH, RST, SYN, ip

BASE_NS = 1_720_000_000_000_000_000
SECOND = 1_000_000_000
#: Bytes of a segment, and of a datagram's first fragment.
SEGMENT, FRAGMENT = 240, 104
SERVER, PORT, SILENT, NOISE = "192.168.0.10", 8080, 8082, 9999


def l3(src: str, dst: str, protocol: int, body: bytes, number: int = 1, where: int = 0) -> bytes:
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), number, where, 64, protocol, 0) + ip(src) + ip(dst) + body


class Wire:
    """The frames of one conversation, in order."""

    def __init__(self, c: int, port: int):
        self.c, self.port, self.frames = c, port, []
        self.client = f"10.{c >> 16 & 255}.{c >> 8 & 255}.{c & 255}"
        self.cport = 20000 + c % 40000

    def send(self, up: bool, protocol: int, body: bytes, data: bool = False) -> None:
        """One datagram: up from client to server."""
        c, kind = self.c, self.c % 8
        src, dst = (self.client, SERVER) if up else (SERVER, self.client)
        whole = l3(src, dst, protocol, body)
        if kind == 2:
            out = [MAC + struct.pack(">HHH", 0x8100, 100 + c % 50, 0x0800) + whole]
        elif kind == 3:
            six = struct.pack(">HHHHHHHH", 0xFD00, 0, 0, 0, 0, 0, c >> 16 & 0xFFFF, c & 0xFFFF), struct.pack(">HHHHHHHH", 0xFD00, 1, 0, 0, 0, 0, 0, 1)
            a, b = six if up else six[::-1]
            out = [MAC + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, len(body), protocol, 64) + a + b + body]
        elif kind == 5 and data and len(body) > FRAGMENT:
            number = len(self.frames) & 0xFFFF
            out = [MAC + b"\x08\x00" + l3(src, dst, protocol, body[:FRAGMENT], number, 0x2000), MAC + b"\x08\x00" + l3(src, dst, protocol, body[FRAGMENT:], number, FRAGMENT // 8)]
            out = out[:: -1 if c % 16 == 5 else 1]
        else:
            ends = ("10.255.0.1", "10.255.0.2") if up else ("10.255.0.2", "10.255.0.1")
            if kind == 6:
                inner = struct.pack(">BBHI", 8, 0, 0, (7000 + c % 100) << 8) + MAC + b"\x08\x00" + whole
                whole = l3(*ends, 17, struct.pack(">HHHH", 50000, 4789, 8 + len(inner), 0) + inner)
            elif kind == 7 and c % 16 == 7:
                whole = l3(*ends, 47, struct.pack(">HHI", 0x2000, 0x0800, 99) + whole)
            elif kind == 7:
                whole = l3(*ends, 4, whole)
            out = [MAC + b"\x08\x00" + whole]
        self.frames += out

    def tcp(self, up: bool, seq: int, ack: int, flags: int, data: bytes = b"") -> None:
        a, b = (self.cport, self.port) if up else (self.port, self.cport)
        self.send(up, 6, struct.pack(">HHIIBBHHH", a, b, seq & 0xFFFFFFFF, ack & 0xFFFFFFFF, 0x50, flags, 65535, 0, 0) + data, bool(data))

    def udp(self, up: bool, data: bytes) -> None:
        a, b = (self.cport, self.port) if up else (self.port, self.cport)
        self.send(up, 17, struct.pack(">HHHH", a, b, 8 + len(data), 0) + data, True)

    def noise(self) -> None:
        c = self.c
        self.frames.append(MAC + b"\x08\x06" + b"\0" * 28)
        if c % 3 == 0:  # cut off behind its header
            self.frames.append(MAC + b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, 999, 1, 0, 64, 6, 0) + ip(self.client) + ip(SERVER))
        if c % 5 == 0:
            other = l3(self.client, SERVER, 17, struct.pack(">HHHH", self.cport, NOISE, 12, 0) + b"none")
            self.frames += [MAC + b"\x08\x00" + other, MAC + struct.pack(">HHH", 0x88A8, 5, 0x0800) + other]


def message(c: int, turn: int, up: bool, text: bytes, last: bool) -> bytes:
    """A turn as an HTTP message; a conversation's bodies have a length, come in chunks, or are compressed (not made smaller). An answer in
    the last turn of some goes on until the connection ends."""
    kind = "Content-Type: text/plain\r\n"
    head = f"POST /c/{c}/t/{turn} HTTP/1.1\r\nHost: h{c % 5}.example\r\nUser-Agent: agent/{c % 3}\r\n{kind}" if up else f"HTTP/1.1 200 OK\r\n{kind}"
    if c % 4 == 2:
        parts = [text[k : k + 500] for k in range(0, len(text), 500)]
        return head.encode() + b"Transfer-Encoding: chunked\r\n\r\n" + b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"
    if c % 4 == 3 and text:
        text, head = gzip.compress(text, 0, mtime=0), head + "Content-Encoding: gzip\r\n"
    if c % 4 == 1 and last and not up:
        return (head + "Connection: close\r\n\r\n").encode() + text
    return (head + f"Content-Length: {len(text)}\r\n\r\n").encode() + text


def conversation(c: int, turns: list[tuple[int, bool, bytes]], web: bool) -> list[bytes]:
    """The frames of turns (number, whether the client speaks, bytes)."""
    w = Wire(c, SILENT if web and c % 7 == 6 else PORT)
    w.noise()
    if c % 10 == 9 and not web:
        w.udp(True, b".")
        for _, up, data in turns:
            for k in range(0, len(data), SEGMENT):
                w.udp(up, data[k : k + SEGMENT])
        return w.frames
    at = {True: 0xFFFFF000 + c % 1000, False: 5000 + c}  # the client's numbers wrap
    w.tcp(True, at[True], 0, SYN)
    w.tcp(False, at[False], at[True] + 1, SYN | ACK)
    at = {k: v + 1 for k, v in at.items()}
    w.tcp(True, at[True], at[False], ACK)
    for k, (turn, up, data) in enumerate(turns):
        data = message(c, turn, up, data, k == len(turns) - 1) if web else data
        if not data:
            continue
        parts = [(at[up] + i, data[i : i + SEGMENT]) for i in range(0, len(data), SEGMENT)]
        first = parts[0]
        if c % 8 == 4 and len(parts) >= 3 and not web:
            del parts[1]
        if (c + k) % 3 == 0:
            parts = [x for i in range(0, len(parts), 2) for x in reversed(parts[i : i + 2])]
        if (c + k) % 4 == 0:
            parts.append(first)
        for seq, part in parts:
            w.tcp(up, seq, at[not up], PSH | ACK, part)
        at[up] += len(data)
        w.tcp(not up, at[not up], at[up], ACK)
    if c % 6 == 1:
        w.tcp(True, at[True], at[False], RST | ACK)
    elif c % 2 == 0:
        w.tcp(True, at[True], at[False], FIN | ACK)
        w.tcp(False, at[False], at[True] + 1, FIN | ACK)
        w.tcp(True, at[True] + 1, at[False] + 1, ACK)
    return w.frames


def frames(spark: SparkSession, d: str, web: bool = False) -> DataFrame:
    """frame_no, ts_ns, wire_len, data of all conversations; conversation c begins c seconds after BASE_NS, a frame each millisecond."""
    schema = pa.schema([("frame_no", pa.int64()), ("ts_ns", pa.int64()), ("wire_len", pa.int32()), ("data", pa.binary())])

    def rows(c, turns):
        return [{"frame_no": c * 1_000_000 + k, "ts_ns": BASE_NS + c * SECOND + k * 1_000_000, "wire_len": len(f), "data": f} for k, f in enumerate(conversation(c, turns, web))]

    def run(batches):
        last, turns = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["conv_id"] != last:
                    out += rows(last, turns) if turns else []
                    last, turns = r["conv_id"], []
                turns.append((r["turn"], r["role"] == "user", (r["text"] or "").encode()))
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        yield pa.RecordBatch.from_pylist(rows(last, turns) if turns else [], schema=schema)

    said = A.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return said.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(run, "frame_no long, ts_ns long, wire_len int, data binary")


def packets(spark: SparkSession, d: str, web: bool = False) -> DataFrame:
    return fragments.assemble(decode.frames_to_packets(frames(spark, d, web)))


def events(spark: SparkSession, d: str) -> DataFrame:
    return connections.track(packets(spark, d), [PORT])


def web_events(spark: SparkSession, d: str) -> DataFrame:
    """Flow events, HTTP records and messages of the web traffic, in one pass; the silent service is no HTTP one."""
    return connections.dataflow(packets(spark, d, True), [PORT, SILENT], [PORT])


def conv_of(ns) -> F.Column:
    """The conversation whose flow began at a time."""
    return F.floor((ns - BASE_NS) / SECOND).cast("bigint").alias("conv_id")


def told_apart(rows: DataFrame) -> DataFrame:
    """rows with conv_id and up (does the client send; its address is the smaller one)."""
    return rows.withColumn("conv_id", conv_of(F.col("started_ns"))).withColumn("up", F.col("direction") == "a_to_b")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    p = decode.frames_to_packets(frames(spark, d))
    return p.groupBy(F.floor(F.col("frame_no") / 1_000_000).alias("conv_id"), "status").agg(F.count("*").alias("frames"), F.sum("payload_len").cast("bigint").alias("payload"))


def headers(spark: SparkSession, d: str) -> DataFrame:
    """What decoding says of each conversation's packets to and from the service."""
    p = decode.frames_to_packets(frames(spark, d)).where(f"status in ('packet', 'fragment') and not (coalesce(dst_port, 0) = {NOISE})")
    up = F.col("src_ip").startswith("10.") | F.col("src_ip").startswith("fd00::")
    return p.groupBy(F.floor(F.col("frame_no") / 1_000_000).alias("conv_id")).agg(F.min(F.when(up, F.col("src_ip")).otherwise(F.col("dst_ip"))).alias("client"), F.count_distinct("l2_domain").alias("domains"), F.max(F.col("l2_domain") != "0").alias("tagged"), F.max(F.when(up, F.col("src_port"))).cast("bigint").alias("client_port"), F.max("eth_src").alias("eth_src"), F.count_if("flags.syn").alias("syns"), F.count_if("flags.fin").alias("fins"), F.count_if("flags.rst").alias("resets"))


def statistics(spark: SparkSession, d: str) -> DataFrame:
    read = files.captures_of(files.rotated_captures(frames(spark, d), 100_000))
    return files.capture_stats(read).select("frames", "cut_off", F.floor(F.col("first_ns") / SECOND).alias("first_s"))


def filtered(spark: SparkSession, d: str) -> DataFrame:
    """Flows of the frames that pass the filter of the source: the same as of all."""
    f = frames(spark, d).where(decode.worth_decoding(F.col("data"), [PORT]))
    return flow_rows(connections.flows(connections.track(fragments.assemble(decode.frames_to_packets(f)), [PORT])))


def rejected(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).where(~decode.worth_decoding(F.col("data"), [PORT]))
    return f.groupBy(F.floor(F.col("frame_no") / 1_000_000).alias("conv_id")).agg(F.count("*").alias("frames"))


def assembled(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d).where("status = 'packet' and floor(frame_no / 1000000) % 8 = 5")
    return p.groupBy(F.floor(F.col("frame_no") / 1_000_000).alias("conv_id")).agg(F.count("*").alias("datagrams"), F.sum("payload_len").cast("bigint").alias("payload"), F.sum("wire_len").cast("bigint").alias("wire"))


PACKETS = [f.name for f in decode.arrow_schema() if f.name not in ("fragment", "eth_src")]
FLOW = ("protocol", "packets_c2s", "packets_s2c", "bytes_c2s", "bytes_s2c", "truncated", "closed_by")


def flow_rows(rows: DataFrame) -> DataFrame:
    return rows.select(conv_of(F.col("started_ns")), "src_port", "dst_port", *FLOW)


def flows(spark: SparkSession, d: str) -> DataFrame:
    return flow_rows(connections.flows(events(spark, d)))


def flows_of_captures(spark: SparkSession, d: str) -> DataFrame:
    """The same flows out of captures: two interfaces' frames in rotated files, read back in any order."""
    f = frames(spark, d).withColumn("interface", F.pmod(F.xxhash64("frame_no"), F.lit(2)))
    read = files.captures_of(files.rotated_captures(f, 100_000, "interface"))
    return flow_rows(connections.flows(connections.track(fragments.assemble(decode.frames_to_packets(read)), [PORT])))


def streams(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    c = told_apart(connections.chunks(e))
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("offset", F.lower(F.hex("data")).alias("hex")))), lambda x: x["hex"]))
    return c.groupBy("conv_id", "up").agg(whole.alias("hex"), F.sum(F.octet_length("data")).cast("bigint").alias("bytes")).select("conv_id", "up", "bytes", F.md5("hex").alias("md5"))


def gaps(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return told_apart(connections.gaps(e)).select("conv_id", "up", "offset", "length")


def messages(spark: SparkSession, d: str) -> DataFrame:
    e = web_events(spark, d)
    m = told_apart(e.where("kind = 'message'"))
    order = F.row_number().over(Window.partitionBy("conv_id", "up").orderBy("stream_offset"))
    return m.select("conv_id", "up", order.cast("bigint").alias("nth"), "request", "method", "path", "host", "status", "user_agent", "content_type")


def bodies(spark: SparkSession, d: str) -> DataFrame:
    e = web_events(spark, d)
    wanted = F.when(F.col("conv_id") % 4 == 3, F.col("view").endswith("decoded_body")).otherwise(F.col("view").endswith("_body"))
    c = told_apart(e.where("kind = 'content'")).where(wanted)
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("stream_offset", F.lower(F.hex("data")).alias("hex")))), lambda x: x["hex"]))
    return c.groupBy("conv_id", "view").agg(whole.alias("hex")).select("conv_id", "view", F.md5("hex").alias("md5"))


def parsed_alone(spark: SparkSession, d: str) -> DataFrame:
    """Messages by way of stored chunks: gate, exchange by flow, parse. Counted by conversation and kind."""
    e = connections.track(packets(spark, d, True), [PORT, SILENT])
    c = http1.gate(connections.chunks(e), A.services(spark))
    p = http1.parse(c).where("kind = 'message'").join(c.select("flow_id", "started_ns").distinct(), "flow_id")
    return told_apart(p).groupBy("conv_id").agg(F.count_if("request").alias("requests"), F.count_if(~F.col("request")).alias("responses"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    """From frames to matches: a literal told afterwards, found in the stored bodies of requests, by conversation."""
    e = web_events(spark, d)
    stored = http1.content_of(connections.chunks(e), e).withColumn("service", F.lit(None).cast("string")).withColumn("ingest_seq", F.lit(1))
    rule = {"id": "the", "revision": 1, "expression": "the", "kind": "text", "action": "find", "direction_type": "input", "service": None, "view": "http_request_body"}
    found = matching.replay(stored, [rule]).join(connections.flows(e).select("flow_id", "started_ns"), "flow_id")
    return found.select(conv_of(F.col("started_ns"))).where("conv_id % 4 < 2").groupBy("conv_id").agg(F.count("*").alias("hits"))


def closed_live(spark: SparkSession, d: str) -> DataFrame:
    """Flows that end, from packets that come as a stream in files: the state of a flow goes from batch to batch."""
    folder = files.scratch_folder(spark) + "/live-" + uuid.uuid4().hex
    rows = packets(spark, d).where("status = 'packet'").select(*PACKETS)
    early = F.col("frame_no") % 1_000_000 < 9
    for some in (early, ~early):  # files come in the order in which they were written, and one holds all that a conversation has in it
        rows.where(some).repartition(F.floor(F.col("frame_no") / 1_000_000)).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    found = jobs.live_flows(stream, [PORT], late="3650 days")  # conversations come side by side, none is too late
    sink = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append")
    q = sink.trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.schema(found.schema).parquet(f"{folder}/out")
    return flow_rows(connections.flows(done)).where("closed_by in ('fin', 'reset')")


def twin() -> dict[str, tuple[tuple[str, ...], str]]:
    """The traffic's facts as SQL: a row for each turn (told), what each turn's frames are (sent), and conversations (talks)."""
    seg, frag = SEGMENT, FRAGMENT
    return {
        "told": ((), "SELECT conv_id AS c, turn, coalesce(text, '') AS text, role = 'user' AS up, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, conv_id % 10 = 9 AS udp FROM conversations"),
        "sent": (("told",), f"""SELECT *, (n + {seg - 1}) // {seg} AS segs, least(n, {seg}) AS first, n % {seg} AS rest, CASE WHEN udp THEN 8 ELSE 20 END AS head,
          CASE WHEN NOT udp AND n > 0 AND (c + k) % 4 = 0 THEN 1 ELSE 0 END AS again, CASE WHEN NOT udp AND c % 8 = 4 AND n > {2 * seg} THEN 1 ELSE 0 END AS lost, CASE WHEN NOT udp AND n > 0 THEN 1 ELSE 0 END AS acks FROM told"""),
        "parted": (("sent",), f"SELECT *, CASE WHEN c % 8 = 5 THEN (n // {seg}) + CASE WHEN rest + head > {frag} THEN 1 ELSE 0 END + again * CASE WHEN first + head > {frag} THEN 1 ELSE 0 END ELSE 0 END AS cuts, segs + again - lost AS frames, n + again * first - lost * {seg} AS bytes FROM sent"),
        "talks": (("parted",), """SELECT c, c % 10 = 9 AS udp, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(cuts) AS BIGINT) AS cuts, CAST(sum(acks) AS BIGINT) AS acks, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(n) AS BIGINT) AS n, max(lost) AS lost,
          CAST(sum(CASE WHEN up THEN frames ELSE acks END) AS BIGINT) AS to_s, CAST(sum(CASE WHEN up THEN acks ELSE frames END) AS BIGINT) AS to_c, CAST(sum(CASE WHEN up THEN bytes ELSE 0 END) AS BIGINT) AS bytes_s, CAST(sum(CASE WHEN up THEN 0 ELSE bytes END) AS BIGINT) AS bytes_c,
          CASE WHEN c % 10 = 9 THEN 'end' WHEN c % 6 = 1 THEN 'reset' WHEN c % 2 = 0 THEN 'fin' ELSE 'end' END AS ending FROM parted GROUP BY c"""),
    }


TWIN = twin()
A.PRELUDE.update(TWIN)
NOISY = "CASE WHEN c % 5 = 0 THEN 2 ELSE 0 END"
OPEN = "CASE WHEN udp THEN 1 ELSE 3 END + CASE ending WHEN 'fin' THEN 3 WHEN 'reset' THEN 1 ELSE 0 END"
#: Oracles by query: (SQL, the tables it needs).
SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "decode_statuses": (f"""SELECT c AS conv_id, 'packet' AS status, frames - cuts + acks + {OPEN} + {NOISY} AS frames, bytes + CASE WHEN udp THEN 1 ELSE 0 END + 4 * ({NOISY}) - coalesce(cut_bytes, 0) AS payload FROM talks LEFT JOIN (
        SELECT c, CAST(sum((n // {SEGMENT}) * {SEGMENT} + CASE WHEN rest + head > {FRAGMENT} THEN rest ELSE 0 END + again * CASE WHEN first + head > {FRAGMENT} THEN first ELSE 0 END) AS BIGINT) AS cut_bytes FROM parted WHERE c % 8 = 5 GROUP BY c) USING (c)
      UNION ALL SELECT c, 'fragment', 2 * cuts, 0 FROM talks WHERE cuts > 0 UNION ALL SELECT c, 'ignored', 1, 0 FROM talks UNION ALL SELECT c, 'error', 1, 0 FROM talks WHERE c % 3 = 0""", ("talks", "parted")),
    "capture_statistics": (f"SELECT CAST(sum(frames + cuts + acks + {OPEN} + {NOISY} + 1 + CASE WHEN c % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS frames, CAST(0 AS BIGINT) AS cut_off, CAST({BASE_NS // SECOND} + min(c) AS BIGINT) AS first_s FROM talks", ("talks",)),
    "decode_headers": ("""SELECT c AS conv_id, CASE WHEN c % 8 = 3 THEN 'fd00::' || CASE WHEN c >= 65536 THEN format('{:x}', c // 65536) || ':' ELSE '' END || format('{:x}', c % 65536) ELSE concat('10.', c // 65536 % 256, '.', c // 256 % 256, '.', c % 256) END AS client, CAST(1 AS BIGINT) AS domains, c % 8 IN (2, 6, 7) AS tagged,
      20000 + c % 40000 AS client_port, '02:00:00:00:00:02' AS eth_src, CASE WHEN udp THEN 0 ELSE 2 END AS syns, CASE ending WHEN 'fin' THEN 2 ELSE 0 END AS fins, CASE ending WHEN 'reset' THEN 1 ELSE 0 END AS resets FROM talks""", ("talks",)),
    "frames_not_worth_decoding": ("SELECT c AS conv_id, CAST(2 AS BIGINT) AS frames FROM talks WHERE c % 5 = 0", ("talks",)),
    "fragments_assembled": (f"""SELECT c AS conv_id, frames + acks + {OPEN} + {NOISY} AS datagrams, bytes + CASE WHEN udp THEN 1 ELSE 0 END + 4 * ({NOISY}) AS payload,
      bytes + CASE WHEN udp THEN 1 ELSE 0 END + (34 + CASE WHEN udp THEN 8 ELSE 20 END) * (frames + acks + {OPEN}) + 34 * cuts + CASE WHEN c % 5 = 0 THEN 46 + 50 ELSE 0 END AS wire FROM talks WHERE c % 8 = 5""", ("talks",)),
    "flows_from_frames": ("""SELECT c AS conv_id, CAST(20000 + c % 40000 AS INTEGER) AS src_port, 8080 AS dst_port, CASE WHEN udp THEN 'udp' ELSE 'tcp' END AS protocol, to_s + CASE WHEN udp THEN 1 ELSE 2 END + CASE WHEN ending <> 'end' THEN 1 ELSE 0 END AS packets_c2s,
      to_c + CASE WHEN udp THEN 0 ELSE 1 END + CASE WHEN ending = 'fin' THEN 1 ELSE 0 END AS packets_s2c, bytes_s + CASE WHEN udp THEN 1 ELSE 0 END AS bytes_c2s, bytes_c AS bytes_s2c, lost > 0 AS truncated, ending AS closed_by FROM talks WHERE udp OR n > 0""", ("talks",)),
    "streams_reassembled": (f"""SELECT c AS conv_id, up, CAST(length(hex) // 2 AS BIGINT) AS bytes, md5(hex) AS md5 FROM (SELECT c, up, CASE WHEN up AND c % 10 = 9 THEN '2e' ELSE '' END || string_agg(hex, '' ORDER BY turn) AS hex FROM (
      SELECT c, turn, up, CASE WHEN lost = 1 THEN h[1 : {2 * SEGMENT}] || h[{4 * SEGMENT + 1} :] ELSE h END AS hex FROM (SELECT *, lower(hex(encode(text))) AS h FROM parted) UNION ALL SELECT DISTINCT c, -1, true, '' FROM parted WHERE c % 10 = 9) GROUP BY c, up) WHERE length(hex) > 0""", ("parted",)),
    "stream_gaps": (f"SELECT c AS conv_id, up, CAST(before + {SEGMENT} AS BIGINT) AS \"offset\", CAST({SEGMENT} AS BIGINT) AS length FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY c, up ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parted) WHERE lost = 1", ("parted",)),
    "http_messages_parsed": ("""SELECT c AS conv_id, up, row_number() OVER (PARTITION BY c, up ORDER BY turn) AS nth, up AS request, CASE WHEN up THEN 'POST' END AS method, CASE WHEN up THEN concat('/c/', c, '/t/', turn) END AS path, CASE WHEN up THEN concat('h', c % 5, '.example') END AS host,
      CASE WHEN NOT up THEN 200 END AS status, CASE WHEN up THEN concat('agent/', c % 3) END AS user_agent, 'text/plain' AS content_type FROM told WHERE c % 7 <> 6""", ("told",)),
    "http_bodies_parsed": ("SELECT c AS conv_id, concat('http_', CASE WHEN up THEN 'request' ELSE 'response' END, CASE WHEN c % 4 = 3 THEN '_decoded' ELSE '' END, '_body') AS view, md5(string_agg(lower(hex(encode(text))), '' ORDER BY turn)) AS md5 FROM told WHERE c % 7 <> 6 AND n > 0 GROUP BY c, up", ("told",)),
    "http_parsed_from_chunks": ("SELECT c AS conv_id, count(*) FILTER (WHERE up) AS requests, count(*) FILTER (WHERE NOT up) AS responses FROM told WHERE c % 7 <> 6 GROUP BY c", ("told",)),
    "live_flows_closed": ("""SELECT c AS conv_id, CAST(20000 + c % 40000 AS INTEGER) AS src_port, 8080 AS dst_port, 'tcp' AS protocol, to_s + 3 AS packets_c2s, to_c + CASE WHEN ending = 'fin' THEN 2 ELSE 1 END AS packets_s2c, bytes_s AS bytes_c2s, bytes_c AS bytes_s2c,
      lost > 0 AS truncated, ending AS closed_by FROM talks WHERE ending <> 'end' AND n > 0""", ("talks",)),
    "frames_to_matches": ("SELECT c AS conv_id, CAST(sum((length(text) - length(replace(text, 'the', ''))) // 3) AS BIGINT) AS hits FROM told WHERE c % 7 <> 6 AND c % 4 < 2 AND up AND contains(text, 'the') GROUP BY c", ("told",)),
}
