"""Packets to flows and ordered stream chunks: one tracker for each canonical flow key, fed in arrival order."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import http1
from .addresses import cidr, ip4
from .reassembly import Bounds, HalfStream
from .sessions import with_flow_key

KEYS = ["protocol", "l2_domain", "a_ip", "a_port", "b_ip", "b_port"]
EVENT = "kind string, flow_id string, event_no long, ts_ns long, direction string, offset long, data binary, truncated boolean, started_ns long, ended_ns long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packets_c2s long, packets_s2c long, bytes_c2s long, bytes_s2c long, closed_by string"


@dataclass(frozen=True)
class Timing:
    tcp_idle_ns: int = 45_000_000_000
    udp_idle_ns: int = 15_000_000_000
    tombstone_ns: int = 2_000_000_000
    bounds: Bounds = Bounds()


def flow_id(key: tuple, started_ns: int, path: str, frame_no: int) -> str:
    """The same id for the same flow on every run, in the form of a UUID."""
    h = hashlib.blake2b(repr((key, started_ns, path, frame_no)).encode(), digest_size=16).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


@dataclass
class Flow:
    id: str
    first: dict
    last_ns: int
    halves: dict[str, HalfStream]
    packets: dict[str, int] = field(default_factory=lambda: {"a_to_b": 0, "b_to_a": 0})
    bytes: dict[str, int] = field(default_factory=lambda: {"a_to_b": 0, "b_to_a": 0})
    visible: bool = False
    truncated: bool = False
    syn: int | None = None
    snapshot_ns: int = 0

    def summary(self, closed_by: str | None) -> dict:
        p, own = self.first, self.first["direction"]
        other = "b_to_a" if own == "a_to_b" else "a_to_b"
        return {"kind": "flow", "flow_id": self.id, "started_ns": p["ts_ns"], "ended_ns": self.last_ns, "src_ip": p["src_ip"], "dst_ip": p["dst_ip"], "src_port": p["src_port"], "dst_port": p["dst_port"], "protocol": p["protocol"], "packets_c2s": self.packets[own], "packets_s2c": self.packets[other], "bytes_c2s": self.bytes[own], "bytes_s2c": self.bytes[other], "truncated": self.truncated, "closed_by": closed_by}


class Tracker:
    """The flows of one key, one after the other. feed() and finish() return chunk, gap and flow events."""

    def __init__(self, key: tuple, ports: set[int], timing: Timing = Timing()):
        self.key, self.ports, self.timing = key, ports, timing
        self.flow: Flow | None = None
        self.grave_ns: int | None = None
        self.given = 0

    def feed(self, p: dict) -> list[dict]:
        """The events of one packet, numbered in the order in which they are given out."""
        return self.numbered(self.events_of(p))

    def numbered(self, events: list[dict]) -> list[dict]:
        for e in events:
            self.given += 1
            e["event_no"] = self.given
        return events

    def events_of(self, p: dict) -> list[dict]:
        out: list[dict] = []
        tcp, flags, data = p["protocol"] == "tcp", p["flags"] or {}, p["payload"] or b""
        idle = self.timing.tcp_idle_ns if tcp else self.timing.udp_idle_ns
        if self.flow and p["ts_ns"] - self.flow.last_ns > idle:
            out += self.close("idle")
        opening = tcp and flags["syn"] and not flags["ack"]
        if opening:
            self.grave_ns = None
            if self.flow and not (self.flow.syn == p["seq"] and self.flow.first["direction"] == p["direction"]):
                out += self.close("new generation")
        elif tcp and not self.flow and not flags["syn"] and self.grave_ns is not None and p["ts_ns"] - self.grave_ns < self.timing.tombstone_ns and (flags["fin"] or flags["rst"] or not data):
            return out  # the tail of a flow just closed
        if not self.flow:
            if p["dst_port"] not in self.ports:
                return out
            self.flow = Flow(flow_id(self.key, p["ts_ns"], p["path"], p["frame_no"]), p, p["ts_ns"], {d: HalfStream(self.timing.bounds) for d in ("a_to_b", "b_to_a")})
        f, d = self.flow, p["direction"]
        back = "b_to_a" if d == "a_to_b" else "a_to_b"
        if opening and f.syn is None:
            f.syn = p["seq"]
        f.packets[d] += 1
        f.bytes[d] += len(data)
        f.last_ns = p["ts_ns"]
        if not tcp:
            if data:
                half = f.halves[d]
                out.append(self.chunk(d, p["ts_ns"], half.offset, data))
                half.offset += len(data)
            return out
        reset = flags["rst"] and f.halves[d].accepts_reset(p["seq"])
        if flags["ack"] and p["ack"] is not None and (reset or not flags["rst"]):
            out += self.events(back, f.halves[back].acknowledge(p["ack"], p["ts_ns"]))
        if not flags["rst"] and (data or flags["syn"] or flags["fin"] or f.halves[d].front is None):
            out += self.events(d, f.halves[d].segment(p["seq"], p["ts_ns"], data, flags["syn"], flags["fin"]))
        if reset or all(h.closed for h in f.halves.values()):
            self.grave_ns = p["ts_ns"]
            out += self.close("reset" if reset else "fin")
        return out

    def chunk(self, direction: str, ts_ns: int, offset: int, data: bytes) -> dict:
        self.flow.visible = True
        p = self.flow.first
        return {"kind": "chunk", "flow_id": self.flow.id, "ts_ns": ts_ns, "direction": direction, "offset": offset, "data": data, "truncated": self.flow.truncated, "src_port": p["src_port"], "dst_port": p["dst_port"], "protocol": p["protocol"], "started_ns": p["ts_ns"]}

    def events(self, direction: str, r) -> list[dict]:
        if r.gaps:
            self.flow.truncated = True
        rows = [{"kind": "gap", "flow_id": self.flow.id, "ts_ns": self.flow.last_ns, "direction": direction, "offset": g.offset, "data": None, "truncated": True, "started_ns": self.flow.first["ts_ns"], "ended_ns": g.length} for g in r.gaps]
        return rows + [self.chunk(direction, c.ts_ns, c.offset, c.data) for c in r.chunks]

    def close(self, why: str) -> list[dict]:
        """Drain both halves, then the flow's row; a flow that gave out no payload has none."""
        out = []
        for d, half in self.flow.halves.items():
            if self.flow.first["protocol"] == "tcp":
                out += self.events(d, half.finish(self.flow.last_ns))
        if self.flow.visible:
            out.append(self.flow.summary(why))
        self.flow = None
        return out

    def finish(self) -> list[dict]:
        return self.numbered(self.close("end")) if self.flow else []

    def expire(self) -> list[dict]:
        """Close a flow whose time has run out."""
        return self.numbered(self.close("idle")) if self.flow else []

    def snapshot(self, every_ns: int = 1_000_000_000) -> list[dict]:
        """The row so far of a flow that has given out payload: the first one, then no sooner than every_ns later (by packet time)."""
        f = self.flow
        if not f or not f.visible or f.snapshot_ns and f.last_ns - f.snapshot_ns < every_ns:
            return []
        f.snapshot_ns = f.last_ns
        return self.numbered([f.summary(None) | {"kind": "snapshot"}])

    def dump(self) -> dict:
        """The state as plain values, so that it can be kept without this class."""
        f = self.flow
        halves = {d: {k: v for k, v in vars(h).items() if k != "bounds"} for d, h in f.halves.items()} if f else {}
        return {"given": self.given, "grave_ns": self.grave_ns, "flow": {**vars(f), "halves": halves} if f else None}

    def load(self, state: dict) -> Tracker:
        self.given, self.grave_ns, self.flow = state["given"], state["grave_ns"], None
        if state["flow"]:
            halves = {}
            for d, kept in state["flow"]["halves"].items():
                halves[d] = HalfStream(self.timing.bounds)
                vars(halves[d]).update(kept)
            self.flow = Flow(**{**state["flow"], "halves": halves})
        return self


def schema_of(fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in fields.split(", "))])


COLUMNS = ["path", "frame_no", "arrival_ns", "ts_ns", "src_ip", "dst_ip", "src_port", "dst_port", "seq", "ack", "flags", "payload", "direction", *KEYS]


def in_order(packets: DataFrame) -> DataFrame:
    """Packets dealt by flow key, in the order of arrival: within a capture that of its frames, and captures merged by time."""
    keyed = with_flow_key(packets.where("status = 'packet'")).select(*COLUMNS)
    return keyed.repartition(*KEYS).sortWithinPartitions(*KEYS, "arrival_ns", "path", "frame_no")


def by_key(batches, ports: set[int], timing: Timing):
    """(batch, list of (tracker, events)) over ordered packets; a tracker's last events come with the first packet of the next key."""
    tracker, last = None, None
    for batch in batches:
        rows = []
        for p in batch.to_pylist():
            key = tuple(p[k] for k in KEYS)
            if key != last:
                if tracker:
                    rows.append((tracker, tracker.finish()))
                tracker, last = Tracker(key, ports, timing), key
            rows.append((tracker, tracker.feed(p)))
        yield rows
    if tracker:
        yield [(tracker, tracker.finish())]


def track(packets: DataFrame, ports: list[int], timing: Timing = Timing()) -> DataFrame:
    """Flow events of decoded packets. ports: the service ports, a small list; without any there is no flow, and nothing is read.

    One flow's open state is held at a time, in Arrow batches. Held bytes of a direction are bounded, so a flow of any length streams
    through.
    """
    if not ports:
        return packets.sparkSession.createDataFrame([], EVENT)
    schema = schema_of(EVENT)

    def run(batches):
        for rows in by_key(batches, set(ports), timing):
            yield pa.RecordBatch.from_pylist([e for _, events in rows for e in events], schema=schema)

    return in_order(packets).mapInArrow(run, EVENT)


FLOW_OF = "flow_id, started_ns, ended_ns, src_ip, dst_ip, src_port, dst_port, protocol, packets_c2s, packets_s2c, bytes_c2s, bytes_s2c, truncated, closed_by"


def dataflow(packets: DataFrame, ports: list[int], http_ports: list[int], timing: Timing = Timing(), caps: http1.Caps = http1.Caps()) -> DataFrame:
    """Flow events, and with them the HTTP records and messages of flows to http_ports (kinds content and message), in one pass.

    Bytes go to the parser in the order in which the tracker gives them out, so one exchange by flow key serves both.
    """
    fields = EVENT + "".join(f", {f}" for f in http1.CONTENT.split(", ") if f.split()[0] not in {x.split()[0] for x in EVENT.split(", ")})
    if not ports:
        return packets.sparkSession.createDataFrame([], fields)
    schema, speaking = schema_of(fields), set(http_ports)

    def run(batches):
        conn, of = None, None
        for rows in by_key(batches, set(ports), timing):
            out = []
            for _, events in rows:
                for e in events:
                    out.append(e)
                    if e["kind"] == "chunk" and e["protocol"] == "tcp" and e["dst_port"] in speaking:
                        if of != e["flow_id"]:
                            conn, of = http1.Connection(caps), e["flow_id"]
                        conn.feed(e["direction"], e["offset"], e["ts_ns"], e["data"])
                    elif e["kind"] == "flow" and of == e["flow_id"]:
                        conn.finish()
                    if of == e["flow_id"]:
                        records, messages = conn.take()
                        own = {"flow_id": of, "event_no": e["event_no"], "started_ns": e["started_ns"]}
                        out += [{"kind": "content", **own, **r} for r in records] + [{"kind": "message", **own, **m} for m in messages]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return in_order(packets).mapInArrow(run, fields)


def chunks(events: DataFrame) -> DataFrame:
    return events.where("kind = 'chunk'").select("flow_id", "event_no", "ts_ns", "direction", "offset", "data", "truncated", "src_port", "dst_port", "protocol", "started_ns")


def gaps(events: DataFrame) -> DataFrame:
    return events.where("kind = 'gap'").select("flow_id", "ts_ns", "direction", "offset", F.col("ended_ns").alias("length"), "started_ns")


def flows(events: DataFrame, kind: str = "flow") -> DataFrame:
    """The rows of closed flows, or with kind "snapshot" those of flows still open."""
    return events.where(F.col("kind") == kind).select(*FLOW_OF.split(", "))


def admitted(flows: DataFrame, most: int, prefix: int | None = None) -> DataFrame:
    """Flows that a cap on open flows lets in, in order of their start: over all of them, or with prefix for each source network of that length.

    A flow counts as open up to its end and is let in where fewer than `most` of its group are. Each group is one ordered pass that holds
    `most` ends; a cap over all flows is one such pass over flow rows (not packets), and so off by default.
    """
    from heapq import heappop, heappush

    group = F.lit("") if prefix is None else F.when(F.col("src_ip").contains(":"), F.col("src_ip")).otherwise(cidr(ip4(F.col("src_ip")), prefix))
    keyed = flows.withColumn("__group", group)

    def run(batches):
        last, ends = None, []
        for batch in batches:
            keep = []
            for k, (g, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("__group", "started_ns", "ended_ns")), strict=True)):
                if g != last:
                    last, ends = g, []
                while ends and ends[0] < a:
                    heappop(ends)
                if len(ends) < most:
                    heappush(ends, b)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64())).drop_columns(["__group"])

    return keyed.repartition("__group").sortWithinPartitions("__group", "started_ns", "flow_id").mapInArrow(run, flows.schema)
