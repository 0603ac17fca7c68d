"""One direction of a TCP connection as an ordered byte stream.

Segments are kept in sequence space as disjoint runs, the bytes seen first winning. After each event the stream settles: runs that join
the front are given out, and a hole in front is passed over when the peer has acknowledged it, when too much is held behind it, or when it
has stood too long. A hole shows as a gap in stream offsets.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

EPOCH = 1 << 32


@dataclass(frozen=True)
class Chunk:
    offset: int
    ts_ns: int
    data: bytes


@dataclass(frozen=True)
class Gap:
    offset: int
    length: int


@dataclass
class Result:
    chunks: list[Chunk] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)
    retransmit: bool = False
    out_of_order: bool = False
    closed: bool = False


@dataclass(frozen=True)
class Bounds:
    bytes: int = 4 << 20
    runs: int = 8192
    gap_ns: int = 1_000_000_000


def unwrap(seq: int, near: int) -> int:
    """The sequence number in 64 bits that lies nearest to another."""
    delta = (seq - near) & 0xFFFFFFFF
    return near + (delta - EPOCH if delta >= 1 << 31 else delta)


class HalfStream:
    def __init__(self, bounds: Bounds = Bounds()):
        self.bounds = bounds
        self.front: int | None = None
        self.offset = 0
        self.starts: list[int] = []
        self.runs: dict[int, tuple[bytes, int]] = {}
        self.held = 0
        self.acked = 0
        self.fin: int | None = None
        self.fin_doubtful = False
        self.closed = False
        self.hole_since: int | None = None

    def observe(self, seq: int, syn: bool) -> None:
        if self.front is None:
            self.front = EPOCH + seq + syn

    def accepts_reset(self, seq: int) -> bool:
        return self.front is None or unwrap(seq, self.front) == self.front

    def segment(self, seq: int, ts_ns: int, data: bytes, syn: bool = False, fin: bool = False) -> Result:
        out = Result()
        self.observe(seq, syn)
        if self.closed:
            out.retransmit = bool(data)
            return out
        start = unwrap((seq + syn) & 0xFFFFFFFF, self.front)
        end = start + len(data)
        if fin and end >= self.front:
            self._mark_fin(end, start > self.front)
        if self.fin is not None and end > self.fin:
            if self.fin_doubtful and self.acked <= self.fin:
                self.fin, self.fin_doubtful = None, False  # later bytes speak against an end that nobody confirmed
            else:
                out.retransmit |= bool(data)
                data = data[: max(0, self.fin - start)]
        ahead = bool(data) and start > self.front
        out.out_of_order = ahead
        if data:
            self._hold(start, ts_ns, data, out)
        self._settle(ts_ns, out)
        return out

    def acknowledge(self, ack: int, ts_ns: int) -> Result:
        """The peer's cumulative acknowledgement; it may come before the segment that shows the hole."""
        out = Result()
        if self.front is not None:
            self.acked = max(self.acked, unwrap(ack, self.front))
            if self.starts or self.fin is not None:
                self._settle(ts_ns, out)
        return out

    def finish(self, ts_ns: int) -> Result:
        """Give out all that is held; nothing is made up behind it."""
        out = Result()
        while self.starts and not self.closed:
            self._skip(self.starts[0], out)
            self._drain(out)
        self._close_if_due(out)
        return out

    def _mark_fin(self, at: int, early: bool) -> None:
        if self.fin is None:
            self.fin, self.fin_doubtful = at, early
        elif not early and (self.fin == at or self.fin_doubtful):
            self.fin, self.fin_doubtful = at, False

    def _hold(self, start: int, ts_ns: int, data: bytes, out: Result) -> None:
        end, at = start + len(data), max(start, self.front)
        out.retransmit |= at > start
        k = max(0, bisect_right(self.starts, at) - 1)
        added = []
        while at < end:
            s = self.starts[k] if k < len(self.starts) else end
            e = s + len(self.runs[s][0]) if k < len(self.starts) else end
            if k < len(self.starts) and e <= at:
                k += 1
                continue
            if s > at:
                stop = min(s, end)
                added.append((at, data[at - start : stop - start]))
                at = stop
            if k < len(self.starts) and at < end and s <= at:
                out.retransmit = True
                at = e
                k += 1
        for s, part in added:
            self.starts.insert(bisect_right(self.starts, s), s)
            self.runs[s] = (part, ts_ns)
            self.held += len(part)

    def _drain(self, out: Result) -> None:
        n = 0
        while n < len(self.starts) and self.starts[n] <= self.front and not self.closed:
            s = self.starts[n]
            data, ts = self.runs.pop(s)
            n += 1
            self.held -= len(data)
            data = data[self.front - s :]
            if data:
                out.chunks.append(Chunk(self.offset, ts, data))
                self.offset += len(data)
                self.front += len(data)
                self._close_if_due(out)
        if n and not self.closed:
            del self.starts[:n]

    def _skip(self, to: int, out: Result) -> None:
        to = to if self.fin is None else min(to, self.fin)
        if to > self.front:
            out.gaps.append(Gap(self.offset, to - self.front))
            self.offset += to - self.front
            self.front = to
            self._close_if_due(out)

    def _settle(self, ts_ns: int, out: Result) -> None:
        self._drain(out)
        while not self.closed and self.front < self.acked:
            if not self.starts and (self.fin is None or self.acked <= self.fin or self.fin <= self.front):
                break
            was = self.front
            self._skip(min(self.starts[0], self.acked) if self.starts else self.fin, out)
            self._drain(out)
            if self.front == was:
                break
        while not self.closed and self.starts and (self.held > self.bounds.bytes or len(self.starts) > self.bounds.runs):
            was = self.held
            self._skip(self.starts[0], out)
            self._drain(out)
            if self.held == was:
                break
        if self.closed or not self.starts:
            self.hole_since = None
        elif self.hole_since is None:
            self.hole_since = ts_ns
        elif ts_ns - self.hole_since >= self.bounds.gap_ns:
            self._skip(self.starts[0], out)
            self._drain(out)
            self.hole_since = ts_ns if self.starts else None
        self._close_if_due(out)

    def _close_if_due(self, out: Result) -> None:
        if self.closed or self.fin is None or self.front is None or self.fin > self.front:
            return
        if self.fin == self.front:
            if self.fin_doubtful and self.acked <= self.fin:
                return
            self.front += 1
        self.closed = out.closed = True
        self.starts, self.runs, self.held, self.hole_since = [], {}, 0, None
