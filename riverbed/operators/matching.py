"""Pattern matching over content records.

Two modes. `independent` finds each pattern on its own with Spark expressions. `automaton` scans a record once for all literals of a group:
hits do not overlap, so patterns of one group can suppress one another; it runs in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INPUT = ("http_request_headers", "http_request_body", "http_request_decoded_body")
OUTPUT = ("http_response_headers", "http_response_body", "http_response_decoded_body")
BOTH = ("tcp_raw", "http_request_decoded_body", "http_response_decoded_body")
VIEWS = {"input": INPUT, "output": OUTPUT, "both": BOTH}
HITS = "pattern_id string, pattern_revision long, flow_id string, content_id string, view string, action string, ts_ns long, offset_start long, offset_end long, historical boolean"


def binary_literal(expression: str) -> bytes:
    """The bytes of a hexadecimal literal; white space and colons do not count. ValueError for anything else, or nothing."""
    digits = re.sub(r"[\s:]", "", expression)
    out = bytes.fromhex(digits)
    if not out:
        raise ValueError("empty binary literal")
    return out


def views_of(direction: str, view: str | None) -> tuple[str, ...]:
    """The views that a pattern looks at; none for a view its direction does not include (any view goes with `both`)."""
    if view is None:
        return VIEWS[direction]
    return (view,) if direction == "both" or view in VIEWS[direction] else ()


def expanded(patterns: DataFrame) -> DataFrame:
    """Enabled patterns, a row for each view they look at, in column scan_view."""
    lists = F.create_map(*[x for k, v in VIEWS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = F.element_at(lists, F.col("direction_type"))
    fits = F.when(F.col("view").isNull(), every).when((F.col("direction_type") == "both") | F.array_contains(every, F.col("view")), F.array("view")).otherwise(F.array().cast("array<string>"))
    return patterns.where("enabled").withColumn("scan_view", F.explode(fits))


def interesting(content: DataFrame, patterns: DataFrame) -> DataFrame:
    """Content that some enabled pattern, global or of the record's service, looks at."""
    at = expanded(patterns).select(F.col("scan_view").alias("view"), F.col("service").alias("__service")).distinct()
    return content.join(at, (content.view == at.view) & (at["__service"].isNull() | (at["__service"] == content.service)), "left_semi")


def literal_hits(content: DataFrame, patterns: DataFrame) -> DataFrame:
    """All hits of each text pattern (id, expression, scan_view) in column text of content, without overlap: byte offsets in the stream."""
    joined = content.join(patterns.select("id", "expression", "scan_view"), (F.col("view") == F.col("scan_view")) & content.text.contains(F.col("expression")))
    pieces = F.split(F.col("text"), F.concat(F.lit("\\Q"), F.col("expression"), F.lit("\\E")), F.lit(-1))
    size = F.octet_length("expression").cast("bigint")
    start = F.struct((F.col("stream_offset") - size).alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + size + F.octet_length(x)).alias("at"), F.array_append(acc["out"], acc["at"] + size + F.octet_length(x)).alias("out"))
    ends = F.slice(F.aggregate(pieces, start, step, lambda acc: acc["out"]), F.lit(1), F.size(pieces) - 1)
    found = joined.select("content_id", F.col("id").alias("pattern_id"), F.explode(ends).alias("offset_start"), size.alias("__size"))
    return found.withColumn("offset_end", F.col("offset_start") + F.col("__size")).drop("__size")


def literal_counts(content: DataFrame, literal: str) -> DataFrame:
    """Hits of one literal in each record, found without overlap."""
    n = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit(literal), F.lit("")))) / len(literal.encode())
    return content.where(F.col("text").contains(literal)).select("content_id", n.cast("bigint").alias("hits"))


def regex_counts(content: DataFrame, expression: str) -> DataFrame:
    return content.where(F.col("text").rlike(expression)).select("content_id", F.regexp_count("text", F.lit(expression)).cast("bigint").alias("hits"))


def bridged(content: DataFrame, literal: str) -> DataFrame:
    """Hits of a literal that lie across the boundary of two records which follow one another in one view of one direction."""
    w = Window.partitionBy("flow_id", "direction", "view").orderBy("stream_offset", "content_id")
    keep = len(literal) - 1
    last = F.when(F.lag(F.col("stream_offset") + F.col("payload_len")).over(w) == F.col("stream_offset"), F.right(F.lag("text").over(w), F.lit(keep)))
    both = content.withColumn("__tail", last).withColumn("__pos", F.call_function("instr", F.concat("__tail", F.left("text", F.lit(keep))), F.lit(literal)))
    hit = both.where((F.col("__pos") > 0) & (F.col("__pos") <= F.length("__tail")) & (F.col("__pos") + len(literal) - 1 > F.length("__tail")))
    start = F.col("stream_offset") - F.octet_length(F.substring("__tail", F.col("__pos"), F.lit(keep)))
    return hit.select("content_id", start.cast("bigint").alias("offset_start"))


@dataclass
class Group:
    """The patterns that one record is scanned for, literals first. find() yields (pattern index, start, end) as the scan meets them."""

    patterns: list[dict]
    literals: list[tuple[int, bytes]] = field(default_factory=list)
    regexes: list[tuple[int, re.Pattern]] = field(default_factory=list)

    def __post_init__(self):
        for k, p in enumerate(self.patterns):
            if p["kind"] == "regex":
                self.regexes.append((k, re.compile(p["expression"].encode())))
            else:
                self.literals.append((k, p["expression"].encode() if p["kind"] == "text" else binary_literal(p["expression"])))
        self.longest = max((len(b) for _, b in self.literals), default=0)
        try:  # one look for all expressions: most records hold none
            self.any_regex = re.compile(b"|".join(b"(?:" + r.pattern + b")" for _, r in self.regexes))
        except re.error:  # names that two of them use, or flags
            self.any_regex = None
        self.ends = None
        if self.literals:
            found: dict[str, tuple[int, int]] = {}
            for k, b in self.literals:
                found.setdefault(b.decode("latin-1"), (k, len(b)))
            self.ends = ahocorasick.Automaton()
            for text, value in found.items():
                self.ends.add_word(text, value)
            self.ends.make_automaton()

    def find(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """Literal hits without overlap: the hit that ends first, of those the longest; then on from its end."""
        at = 0
        if self.ends is not None:
            best = None
            for end, (k, n) in self.ends.iter(data.decode("latin-1")):
                start = end + 1 - n
                if best and end + 1 > best[2]:
                    yield best
                    at, best = best[2], None
                if start >= at and (best is None or start < best[1]):
                    best = (k, start, end + 1)
            if best:
                yield best
            return
        while self.literals:
            hits = [(i + len(b), i, k) for k, b in self.literals if (i := data.find(b, at)) >= 0]
            if not hits:
                return
            end, start, k = min(hits)
            yield k, start, end
            at = end

    def overlap(self, window: int) -> int:
        """Bytes of the stream before a record that its scan needs."""
        return max(self.longest - 1, window if self.regexes else 0, 0)


@dataclass
class Limits:
    pattern: int = 128
    record: int = 1024
    regex_window: int = 8192


def scan_record(group: Group, data: bytes, before: bytes, offset: int, taken: dict, limits: Limits) -> tuple[list[tuple[int, int, int]], bool]:
    """Hits (pattern index, start, end) with stream offsets, and whether a limit ended the scan.

    taken counts candidates of the record (key None) and of each pattern, over all groups that scan it.
    """
    out: list[tuple[int, int, int]] = []

    def offered():
        keep = before[max(0, len(before) - (group.longest - 1)) :] if group.longest > 1 else b""
        if keep:  # only hits across the boundary
            for k, a, b in group.find(keep + data[: group.longest - 1]):
                if a < len(keep) < b:
                    yield k, offset + a - len(keep), offset + b - len(keep)
        for k, a, b in group.find(data):
            yield k, offset + a, offset + b
        joint = before + data
        for k, r in group.regexes if group.any_regex is None or group.any_regex.search(joint) else ():
            for m in r.finditer(joint):
                if m.end() > len(before) or not before:
                    yield k, offset - len(before) + m.start(), offset - len(before) + m.end()

    for k, a, b in offered():
        if taken.get(None, 0) >= limits.record:
            return out, True
        taken[None] = taken.get(None, 0) + 1
        name = (group.patterns[k]["id"], group.patterns[k]["revision"])
        taken[name] = taken.get(name, 0) + 1
        if taken[name] <= limits.pattern:
            out.append((k, a, b))
    return out, any(n > limits.pattern for key, n in taken.items() if key is not None)


class Matcher:
    """Groups by (service or None, view), and the tails of streams: the same state for batch, replay and streaming."""

    def __init__(self, patterns: list[dict], limits: Limits = Limits(), historical: bool = False):
        by: dict[tuple, list[dict]] = {}
        for p in sorted(patterns, key=lambda p: (p["id"], p["revision"])):
            for v in views_of(p["direction_type"], p.get("view")):
                by.setdefault((p.get("service"), v), []).append(p)
        self.groups = {k: Group(v) for k, v in by.items()}
        self.limits, self.historical = limits, historical
        self.tails: dict[tuple, tuple[int, bytes]] = {}

    def feed(self, r: dict) -> list[dict]:
        """Hits in one content record; records of a stream come in order."""
        own = [g for s in ([None] if r.get("service") is None else [None, r["service"]]) if (g := self.groups.get((s, r["view"])))]
        if not own:
            return []
        key, data = (r["flow_id"], r["direction"], r["view"]), r["data"] or b""
        end, tail = self.tails.get(key, (None, b""))
        before = tail if end == r["stream_offset"] else b""
        taken: dict = {}
        out = []
        for g in own:
            need = g.overlap(self.limits.regex_window)
            hits, _ = scan_record(g, data, before[len(before) - need :] if need and need < len(before) else before if need else b"", r["stream_offset"], taken, self.limits)
            for k, a, b in hits:
                p = g.patterns[k]
                out.append({"pattern_id": p["id"], "pattern_revision": p["revision"], "flow_id": r["flow_id"], "content_id": r["content_id"], "view": r["view"], "action": p["action"], "ts_ns": r["ts_ns"], "offset_start": a, "offset_end": b, "historical": self.historical})
        keep = max(g.overlap(self.limits.regex_window) for g in own)
        joint = before + data
        self.tails[key] = (r["stream_offset"] + len(data), joint[len(joint) - keep :] if keep else b"")
        return out


TAILS = "flow_id string, direction string, view string, end_at long, tail binary, last_ns long"
STREAM = ["flow_id", "direction", "view"]


def schema_of(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in fields.split(", "))])


def carried(content: DataFrame, patterns: list[dict], tails: DataFrame | None = None, limits: Limits = Limits(), historical: bool = False) -> DataFrame:
    """Hits, and tails for a scan that goes on later: kind hit with the columns of HITS, kind tail with those of TAILS.

    patterns are dicts of their columns, a small set. tails are those of an earlier scan. Records are dealt by stream and sorted, then read
    in Arrow batches: one record and one tail are held at a time.
    """
    fields = "kind string, " + HITS + ", direction string, end_at long, tail binary, last_ns long"
    schema = schema_of(fields)

    def run(batches):
        m, last, at = Matcher(patterns, limits, historical), None, 0

        def left():
            return [{"kind": "tail", **dict(zip(STREAM, k, strict=True)), "end_at": end, "tail": tail, "last_ns": at} for k, (end, tail) in m.tails.items()]

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = tuple(r[c] for c in STREAM)
                if key != last:
                    out += left()
                    m.tails.clear()
                    last, at = key, 0
                at = max(at, r["ts_ns"] or 0)
                if r["seed"]:
                    m.tails[key] = r["stream_offset"], r["data"] or b""
                else:
                    out += [{"kind": "hit", **h} for h in m.feed(r)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        yield pa.RecordBatch.from_pylist(left(), schema=schema)

    views = sorted({v for p in patterns for v in views_of(p["direction_type"], p.get("view"))})
    cols = [*STREAM, "stream_offset", "content_id", "service", "ts_ns", "data"]
    rows = (content.where(F.col("view").isin(*views)) if views else content.where("false")).select(*cols, F.lit(False).alias("seed"))
    if tails is not None:
        none = F.lit(None).cast("string")
        rows = rows.unionByName(tails.select(*STREAM, F.col("end_at").alias("stream_offset"), none.alias("content_id"), none.alias("service"), F.col("last_ns").alias("ts_ns"), F.col("tail").alias("data"), F.lit(True).alias("seed")))
    return rows.repartition(*STREAM).sortWithinPartitions(*STREAM, F.desc("seed"), "stream_offset", "content_id").mapInArrow(run, fields)


def hits_of(found: DataFrame) -> DataFrame:
    return found.where("kind = 'hit'").select(*[f.split()[0] for f in HITS.split(", ")])


def tails_of(found: DataFrame) -> DataFrame:
    return found.where("kind = 'tail'").select(*[f.split()[0] for f in TAILS.split(", ")])


def scan(content: DataFrame, patterns: list[dict], limits: Limits = Limits(), historical: bool = False) -> DataFrame:
    """Hits of all patterns in content, streams scanned in order."""
    return hits_of(carried(content, patterns, None, limits, historical))


def replay(content: DataFrame, patterns: list[dict], until_seq: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """Retroactive scan: content up to a snapshot, without segments already done; hits are marked historical."""
    rows = content.where(F.col("ingest_seq") <= until_seq) if until_seq is not None else content
    rows = rows.join(done.select("segment_path").distinct(), "segment_path", "left_anti") if done is not None else rows
    return scan(rows, patterns, historical=True)
