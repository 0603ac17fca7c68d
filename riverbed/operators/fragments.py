"""IP fragments to datagrams, in arrival order for each (version, domain, source, destination, id, protocol)."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from . import decode as d

LIMIT = 65535


@dataclass
class Datagram:
    """The parts of one datagram so far. An exact repeat is ignored; parts that contradict one another drop the datagram."""

    parts: dict[int, tuple[bytes, bool]] = field(default_factory=dict)
    total: int | None = None
    wire: int = 0
    last_ns: int = 0

    def add(self, offset: int, more: bool, data: bytes, wire_len: int, ts_ns: int) -> str:
        """held, repeat, drop or done."""
        end = offset + len(data)
        if more and (not data or len(data) % 8) or end > LIMIT or not more and not end:
            return "drop"
        if (old := self.parts.get(offset)) is not None:
            return "repeat" if old == (data, more) else "drop"
        if any(offset < o + len(b) and o < end for o, (b, _) in self.parts.items()):
            return "drop"
        if not more:
            if self.total not in (None, end) or any(o + len(b) > end for o, (b, _) in self.parts.items()):
                return "drop"
            self.total = end
        elif self.total is not None and end > self.total:
            return "drop"
        self.parts[offset] = (data, more)
        self.wire += wire_len
        self.last_ns = ts_ns
        return "done" if self.total is not None and sum(len(b) for b, _ in self.parts.values()) == self.total else "held"

    def data(self) -> bytes:
        return b"".join(self.parts[o][0] for o in sorted(self.parts))


class Assembler:
    def __init__(self, timeout_ns: int = 30_000_000_000):
        self.timeout_ns, self.open = timeout_ns, {}

    def feed(self, f: dict, ts_ns: int, wire_len: int) -> tuple[bytes, int] | None:
        """The whole datagram and its wire bytes when this fragment completes it."""
        key = (f["version"], f["domain"], f["src_ip"], f["dst_ip"], f["id"], f["next"])
        if key in self.open and ts_ns - self.open[key].last_ns >= self.timeout_ns:
            del self.open[key]
        gram = self.open.setdefault(key, Datagram())
        state = gram.add(f["offset"], f["more"], f["data"], wire_len, ts_ns)
        if state in ("drop", "done"):
            del self.open[key]
        return (gram.data(), gram.wire) if state == "done" else None


def assemble(packets: DataFrame) -> DataFrame:
    """Packets of frames_to_packets() with each complete set of fragments as one packet, at its last fragment's place.

    Only fragments are shuffled. A datagram has 65535 bytes at most, so a group's state is bounded whatever the number of its fragments.
    """

    def run(batches):
        schema, last, box = d.arrow_schema(), None, Assembler()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                f = r["fragment"]
                key = (f["version"], f["domain"], f["src_ip"], f["dst_ip"], f["id"], f["next"])
                if key != last:
                    box, last = Assembler(), key
                if whole := box.feed(f, r["ts_ns"], r["wire_len"]):
                    try:
                        o = d.transport(f["next"], f["src_ip"], f["dst_ip"], whole[0], f["domain"], 0)
                    except (d.Malformed, d.struct.error, IndexError):
                        o = d.Outcome("error")
                    rows.append(d.packet_row(r, whole[1], o))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    keys = ["fragment.version", "fragment.domain", "fragment.src_ip", "fragment.dst_ip", "fragment.id", "fragment.next"]
    parts = packets.where("status = 'fragment'").repartition(*keys).sortWithinPartitions(*keys, "arrival_ns", "path", "frame_no")
    return packets.where("status <> 'fragment'").unionByName(parts.mapInArrow(run, d.PACKET))
