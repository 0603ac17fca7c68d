"""HTTP/1.x messages out of the two byte streams of a flow.

Each direction is a generator that asks for bytes and is resumed as chunks come: a message's shape (header, body by length, by chunks, to
the end) is then plain control flow. What it meets it hands to the connection as records (view, offset, time, bytes) and messages.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = (b"GET", b"POST", b"PUT", b"DELETE", b"HEAD", b"OPTIONS", b"PATCH", b"TRACE", b"CONNECT")
START = re.compile(rb"(?:^|(?<=\n))(?:" + b"|".join(METHODS) + rb") \S|(?:^|(?<=\n))HTTP/1\.[01] \d")
TOKEN = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+$")


@dataclass(frozen=True)
class Caps:
    header: int = 128 << 10
    headers: int = 128
    body: int = 64 << 20
    decoded: int = 16 << 20
    ratio: int = 32
    queue: int = 4096


@dataclass
class Head:
    request: bool
    method: str | None = None
    path: str | None = None
    status: int | None = None
    host: str | None = None
    user_agent: str | None = None
    content_type: str | None = None
    encoding: str | None = None
    length: int | None = None
    ambiguous: bool = False
    chunked: bool = False
    to_end: bool = False
    offset: int = 0
    ts_ns: int = 0


class Bad(ValueError):
    """Bytes that are no HTTP message."""


def parse_head(raw: bytes, caps: Caps = Caps()) -> Head:
    """A request or status line and its fields. Bad for anything else, conflicting lengths, or a transfer coding behind chunked."""
    lines = raw.split(b"\r\n")
    first = lines[0].split(b" ", 2)
    if first[0].startswith(b"HTTP/1."):
        if len(first) < 2 or not re.fullmatch(rb"\d{3}", first[1]):
            raise Bad("status line")
        head = Head(False, status=int(first[1]))
    elif len(first) == 3 and TOKEN.match(first[0]) and re.fullmatch(rb"HTTP/1\.[01]", first[2]):
        head = Head(True, method=first[0].decode("latin-1"), path=first[1].decode("utf-8", "replace"))
    else:
        raise Bad("request line")
    fields: dict[bytes, list[bytes]] = {}
    rest = [x for x in lines[1:] if x]
    if len(rest) > caps.headers:
        raise Bad("too many fields")
    for x in rest:
        name, colon, value = x.partition(b":")
        if not colon or not TOKEN.match(name):
            raise Bad("field")
        fields.setdefault(name.lower(), []).append(value.strip())
    one = lambda n: fields[n][0].decode("utf-8", "replace") if n in fields else None
    head.host, head.user_agent, head.content_type = one(b"host"), one(b"user-agent"), one(b"content-type")
    coding = (one(b"content-encoding") or "").lower()
    head.encoding = next((c for c in ("gzip", "deflate") if c in coding), None)
    codings = [c.split(b";")[0].strip().lower() for v in fields.get(b"transfer-encoding", []) for c in v.split(b",")]
    lengths = {v.strip() for x in fields.get(b"content-length", []) for v in x.split(b",")}
    if codings:
        if b"" in codings or b"chunked" in codings[:-1]:
            raise Bad("chunked is not last")
        head.ambiguous = bool(lengths)  # the coding holds, but such a message may be a smuggled one
        head.chunked = codings[-1] == b"chunked"
        head.to_end = not head.chunked
    elif lengths:
        if len(lengths) > 1 or not re.fullmatch(rb"\d{1,19}", next(iter(lengths))):
            raise Bad("content length")
        head.length = int(next(iter(lengths)))
    return head


def inflate(data: bytes, encoding: str, caps: Caps) -> bytes | None:
    """The decoded body, or None where it is damaged or grows beyond the caps."""
    most = min(caps.decoded, caps.ratio * len(data))
    try:
        box = zlib.decompressobj({"gzip": 31, "deflate": 15}[encoding])
        out = box.decompress(data, most + 1)
        return out if box.eof and len(out) <= most else None
    except zlib.error:
        return None


class Half:
    """One direction. feed() takes bytes at a stream offset; `at` is the offset of the first byte not yet used."""

    def __init__(self, conn: Connection, direction: str):
        self.conn, self.direction = conn, direction
        self.buffer, self.at, self.ts, self.ended = bytearray(), 0, 0, False
        self.synced = True
        self.work = self.run()
        next(self.work)

    def feed(self, offset: int, ts_ns: int, data: bytes) -> None:
        if offset != self.at + len(self.buffer):  # a gap: nothing before it can be finished
            self.conn.requests.clear()
            self.buffer, self.at, self.synced = bytearray(), offset, False
            self.work = self.run()
            next(self.work)
        self.buffer += data
        self.ts = ts_ns
        self.work.send(None)

    def finish(self) -> None:
        self.ended = True
        self.work.send(None)

    def take(self, n: int) -> bytes:
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.at += n
        return out

    def run(self):
        while True:
            while not self.buffer or self.conn.tunnel:
                if self.conn.tunnel:
                    self.take(len(self.buffer))
                yield
            if not self.synced and not self.resync():
                yield
                continue
            try:
                head = yield from self.header()
                if head:
                    yield from self.body(head)
            except Bad:
                self.conn.errors += 1
                self.synced = False

    def resync(self) -> bool:
        """Go on at what looks like the start of a message; else keep only what may be the beginning of one."""
        if m := START.search(self.buffer):
            self.take(m.start())
            self.synced = True
            return True
        self.take(max(0, len(self.buffer) - 48))
        return False

    def header(self):
        began, seen = None, 0
        while (end := self.buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.buffer)
            if seen > self.conn.caps.header:
                self.conn.requests.clear()
                self.take(seen - 48)
                raise Bad("header too long")
            if self.ended:
                return None
            began = began if began is not None else self.ts
            yield
        offset, raw = self.at, self.take(end + 4)
        try:
            head = parse_head(raw[:-4], self.conn.caps)
        except Bad:
            self.conn.requests.clear()  # answers can no longer be told apart
            raise
        head.ts_ns, head.offset = self.ts, offset
        self.conn.errors += head.ambiguous
        self.conn.begin(self, head, raw)
        return head

    def body(self, head: Head):
        conn = self.conn
        if head.request:
            conn.expect(head.method)
            answers = None
        else:
            answers = conn.answered(head.status)
            if head.status == 101 or answers == "CONNECT" and 200 <= head.status < 300:
                conn.tunnel = True
                return
        empty = not head.request and (head.status < 200 or head.status in (204, 205, 304) or answers == "HEAD") or head.request and not head.chunked and head.length is None and not head.to_end
        if empty:
            return
        kept, whole = bytearray(), True
        room = conn.caps.body

        def keep(data: bytes, offset: int):
            nonlocal whole
            part = data[: max(0, room - len(kept))]
            whole = whole and len(part) == len(data)
            if part:
                kept.extend(part)
                conn.record(self, head, "body", offset, part)

        if head.chunked:
            done = yield from self.chunked(keep)
        else:
            left = head.length if head.length is not None else None
            while left is None or left > 0:
                n = len(self.buffer) if left is None else min(left, len(self.buffer))
                if n:
                    offset = self.at
                    keep(self.take(n), offset)
                    left = None if left is None else left - n
                if left == 0 or self.ended:
                    break
                yield
            done = left in (None, 0)
        if done and whole and kept and head.encoding and (plain := inflate(bytes(kept), head.encoding, conn.caps)):
            conn.record(self, head, "decoded_body", self.at, plain)

    def line(self, most: int):
        while (end := self.buffer.find(b"\r\n")) < 0:
            if len(self.buffer) > most:
                raise Bad("line too long")
            if self.ended:
                return None
            yield
        return self.take(end + 2)[:-2]

    def chunked(self, keep):
        while True:
            size = yield from self.line(256)
            if size is None:
                return False
            digits = size.split(b";")[0].strip()
            if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", digits):
                raise Bad("chunk size")
            left = int(digits, 16)
            if not left:
                while True:  # trailers
                    text = yield from self.line(self.conn.caps.header)
                    if not text:
                        return text is not None
            while left:
                if n := min(left, len(self.buffer)):
                    offset = self.at
                    keep(self.take(n), offset)
                    left -= n
                elif self.ended:
                    return False
                else:
                    yield
            while len(self.buffer) < 2:
                if self.ended:
                    return False
                yield
            if self.take(2) != b"\r\n":
                raise Bad("chunk end")


class Connection:
    """Both directions of a flow. records and messages gather what was found; take() hands them over."""

    def __init__(self, caps: Caps = Caps()):
        self.caps, self.tunnel, self.errors = caps, False, 0
        self.requests: deque[str] = deque()
        self.records: list[dict] = []
        self.messages: list[dict] = []
        self.halves = {d: Half(self, d) for d in ("a_to_b", "b_to_a")}

    def feed(self, direction: str, offset: int, ts_ns: int, data: bytes) -> None:
        self.halves[direction].feed(offset, ts_ns, data)

    def finish(self) -> None:
        for h in self.halves.values():
            h.finish()

    def take(self) -> tuple[list[dict], list[dict]]:
        out = self.records, self.messages
        self.records, self.messages = [], []
        return out

    def expect(self, method: str) -> None:
        if len(self.requests) >= self.caps.queue:
            self.requests.popleft()
            self.errors += 1
        self.requests.append(method)

    def answered(self, status: int) -> str | None:
        if 100 <= status < 200 and status != 101:
            return None
        return self.requests.popleft() if self.requests else None

    def begin(self, half: Half, head: Head, raw: bytes) -> None:
        self.record(half, head, "headers", head.offset, raw)
        self.messages.append({"ts_ns": head.ts_ns, "direction": half.direction, "stream_offset": head.offset, "request": head.request, "method": head.method, "host": head.host, "path": head.path, "status": head.status, "user_agent": head.user_agent, "content_type": head.content_type, "body_content_id": None})

    def record(self, half: Half, head: Head, part: str, offset: int, data: bytes) -> None:
        self.records.append({"ts_ns": head.ts_ns, "direction": half.direction, "view": f"http_{'request' if head.request else 'response'}_{part}", "stream_offset": offset, "data": data})


CONTENT = "kind string, flow_id string, ts_ns long, direction string, view string, stream_offset long, data binary, request boolean, method string, host string, path string, status int, user_agent string, content_type string, body_content_id string"


def parse(chunks: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """Records (kind content) and messages (kind message) of stream chunks (flow_id, event_no, direction, ts_ns, offset, data).

    Chunks are dealt by flow and taken in the order in which they were given out (event_no), as one that came late keeps its own time. One
    flow is open at a time. Where frames are at hand, connections.dataflow() parses inside the tracker and saves this exchange.
    """
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, types[t]) for n, t in (f.split() for f in CONTENT.split(", "))])

    def emit(flow: str, conn: Connection) -> list[dict]:
        records, messages = conn.take()
        return [{"kind": "content", "flow_id": flow, **r} for r in records] + [{"kind": "message", "flow_id": flow, **m} for m in messages]

    def run(batches):
        conn, last = None, None
        for batch in batches:
            rows = []
            for c in batch.to_pylist():
                if c["flow_id"] != last:
                    if conn:
                        conn.finish()
                        rows += emit(last, conn)
                    conn, last = Connection(caps), c["flow_id"]
                conn.feed(c["direction"], c["offset"], c["ts_ns"], c["data"] or b"")
                rows += emit(last, conn)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if conn:
            conn.finish()
            yield pa.RecordBatch.from_pylist(emit(last, conn), schema=schema)

    cols = ["flow_id", "event_no", "direction", "ts_ns", "offset", "data"]
    return chunks.select(*cols).repartition("flow_id").sortWithinPartitions("flow_id", "event_no").mapInArrow(run, CONTENT)


def gate(chunks: DataFrame, services: DataFrame) -> DataFrame:
    """TCP chunks of flows whose service speaks HTTP: the only ones that parse() should see. services has a row for each port, at most 65,536."""
    ports = F.broadcast(services.where("enabled and http").select("port").distinct())
    return chunks.where("protocol = 'tcp'").join(ports, F.col("dst_port") == F.col("port"), "left_semi")


def content_of(chunks: DataFrame, parsed: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """All content records: raw stream chunks and what HTTP parsing found, with content_id and payload_len."""
    raw = chunks.select("flow_id", "ts_ns", "direction", F.lit("tcp_raw").alias("view"), F.col("offset").alias("stream_offset"), "data")
    both = raw.unionByName(parsed.where("kind = 'content'").select(*raw.columns))
    return both.withColumn("payload_len", F.length("data").cast("long")).withColumn("content_id", F.md5(F.concat_ws("/", "flow_id", "direction", "view", "stream_offset", "ts_ns")))


def messages_of(parsed: DataFrame) -> DataFrame:
    m = parsed.where("kind = 'message'").withColumn("id", F.md5(F.concat_ws("/", "flow_id", "direction", "stream_offset")))
    return m.select("id", "flow_id", "ts_ns", "request", "method", "host", "path", "status", "user_agent", "content_type", "body_content_id")


def header_fields(text: str, name: str):
    """A field of a header held as text, as an expression (first one, trimmed; null where there is none)."""
    found = F.regexp_extract(F.col(text), rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def paired(messages: DataFrame) -> DataFrame:
    """The n-th request of a flow with its n-th final response (1xx ones do not count): request_id, response_id."""
    from .facts import numbered

    req = numbered(messages.where("request"), ["flow_id"], "ts_ns", "id").select("flow_id", "n", F.col("id").alias("request_id"))
    res = numbered(messages.where("not request and (status >= 200 or status = 101)"), ["flow_id"], "ts_ns", "id").select("flow_id", "n", F.col("id").alias("response_id"))
    return req.join(res, ["flow_id", "n"], "left").select("flow_id", "request_id", "response_id")
