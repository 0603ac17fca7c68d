"""File formats: packet captures, the segment log, the metadata spool. All read through Spark's file sources, so any store will do."""

from __future__ import annotations

import re
import struct
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.decode import worth_decoding

FRAMES = "frame_no long, ts_ns long, arrival_ns long, wire_len int, data binary, path string"

# fixed values of the segment format
SEGMENT_MAGIC = b"PMSEG001"
SEGMENT_VERSION = 1
RECORD_MAGIC = 0x504D5243
DIRECTIONS = ("a_to_b", "b_to_a")
VIEWS = ("tcp_raw", "http_request_headers", "http_request_body", "http_request_decoded_body", "http_response_headers", "http_response_body", "http_response_decoded_body")
SEGMENT = "content_id string, flow_id string, ts_ns long, service string, direction string, view string, stream_offset long, data binary, segment_path string, segment_offset long"

# fixed values of the classic capture format
PCAP_MICRO, PCAP_NANO, ETHERNET = 0xA1B2C3D4, 0xA1B23C4D, 1


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='riverbed-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def pcap_frames(raw: bytes):
    """(number, ts_ns, wire_len, data) of a classic capture file; a cut-off last frame is left out."""
    if len(raw) < 24:
        return
    order = next((o for o in "<>" if struct.unpack(o + "I", raw[:4])[0] in (PCAP_MICRO, PCAP_NANO)), None)
    if order is None:
        raise ValueError("not a capture file")
    unit = 1 if struct.unpack(order + "I", raw[:4])[0] == PCAP_NANO else 1000
    at, n = 24, 0
    while at + 16 <= len(raw):
        sec, part, have, wire = struct.unpack(order + "4I", raw[at : at + 16])
        if at + 16 + have > len(raw):
            return
        n += 1
        yield n, sec * 1_000_000_000 + part * unit, wire, raw[at + 16 : at + 16 + have]
        at += 16 + have


def pcap_bytes(frames) -> bytes:
    """A classic little-endian microsecond Ethernet capture of (ts_ns, wire_len, data)."""
    out = [struct.pack("<IHHiIII", PCAP_MICRO, 2, 4, 0, 0, 262144, ETHERNET)]
    for ts, wire, data in frames:
        out.append(struct.pack("<4I", ts // 1_000_000_000, ts % 1_000_000_000 // 1000, len(data), wire) + data)
    return b"".join(out)


def _frames(files: DataFrame) -> DataFrame:
    schema = pa.schema([("frame_no", pa.int64()), ("ts_ns", pa.int64()), ("arrival_ns", pa.int64()), ("wire_len", pa.int32()), ("data", pa.binary()), ("path", pa.string())])

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0), batch.column(1), strict=True):
                rows, name, latest = [], path.as_py(), 0
                for n, ts, wire, data in pcap_frames(raw.as_buffer().to_pybytes()):
                    latest = max(latest, ts)
                    rows.append({"frame_no": n, "ts_ns": ts, "arrival_ns": latest, "wire_len": wire, "data": data, "path": name})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, FRAMES)


def read_pcap(spark: SparkSession, path: str, ports: list[int] | None = None) -> DataFrame:
    """Frames of capture files, with ports only those that may belong to a service (no port: none, and nothing is read); a file is one task's work, so captures should be rotated (rotated_captures()).

    frame_no counts within the file. (arrival_ns, path, frame_no) is the order of arrival over all files: arrival_ns is the latest time up
    to a frame, so a file's frames stay in their order and files merge by time.
    """
    if ports == []:
        return spark.createDataFrame([], FRAMES)
    frames = _frames(spark.read.format("binaryFile").load(path))
    return frames if ports is None else frames.where(worth_decoding(F.col("data"), ports))


def capture_stats(frames: DataFrame) -> DataFrame:
    """Frames, bytes on the wire, frames that were cut off, and the first and last time."""
    return frames.agg(F.count("*").alias("frames"), F.sum("wire_len").cast("long").alias("bytes"), F.count_if(F.col("wire_len") > F.octet_length("data")).alias("cut_off"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def stream_pcap(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Frames of capture files as they appear in a folder: rotated captures stand for a live interface."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _frames(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path))


def captures_of(files: DataFrame) -> DataFrame:
    """Frames of capture files held in a table (path, content), as rotated_captures() makes it."""
    return _frames(files)


def rotated(rows: DataFrame, size, most: int, order: list[str], keys: list[str]) -> DataFrame:
    """rows with column part: within keys, in order, a new part begins where the bytes before a row pass a multiple of most."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("part", F.floor(before / most).cast("long"))


def packed(rows: DataFrame, keys: list[str], order: list[str], name, begin: bytes, record) -> DataFrame:
    """(path, content): a file for each value of keys, record(row) after record in order behind begin. One file is held at a time."""
    kind = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches):
        last, out = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["__file"] != last:
                    if out:
                        yield pa.RecordBatch.from_pylist([{"path": last, "content": b"".join(out)}], schema=kind)
                    last, out = r["__file"], [begin]
                out.append(record(r))
        if out:
            yield pa.RecordBatch.from_pylist([{"path": last, "content": b"".join(out)}], schema=kind)

    return rows.withColumn("__file", name).repartition(*keys).sortWithinPartitions("__file", *order).mapInArrow(run, "path string, content binary")


def rotated_captures(frames: DataFrame, most: int = 64 << 20, by: str | None = None) -> DataFrame:
    """Captures (path, content) of about `most` bytes each, every frame before any filter; by: a column that parts the frames first.

    The table is written like any other (write.parquet commits all of it or nothing) and read back by captures_of().
    """
    rows = frames.withColumn("__by", F.col(by).cast("string") if by else F.lit("0"))
    rows = rotated(rows, F.octet_length("data") + 16, most, ["ts_ns", "frame_no"], ["__by"])
    name = F.concat(F.lit("capture-"), "__by", F.lit("-"), F.lpad(F.col("part").cast("string"), 10, "0"), F.lit(".pcap"))
    return packed(rows, ["__by", "part"], ["ts_ns", "frame_no"], name, pcap_bytes([]), lambda r: struct.pack("<4I", r["ts_ns"] // 1_000_000_000, r["ts_ns"] % 1_000_000_000 // 1000, len(r["data"]), r["wire_len"]) + r["data"])


def write_frames(frames: DataFrame, path: str) -> None:
    """The raw table of frames, before any filter."""
    frames.write.mode("append").parquet(path)


def segment_record(r: dict) -> bytes:
    service = (r.get("service") or "").encode()
    body = uuid.UUID(r["content_id"]).bytes + uuid.UUID(r["flow_id"]).bytes + struct.pack("<QH", r["ts_ns"], len(service)) + service
    body += struct.pack("<BBQI", DIRECTIONS.index(r["direction"]), VIEWS.index(r["view"]), r["stream_offset"], len(r["data"])) + r["data"]
    return struct.pack("<3I", RECORD_MAGIC, len(body), zlib.crc32(body)) + body


def segment_bytes(records, created_ns: int = 0) -> bytes:
    """A segment file of content records (dicts)."""
    return SEGMENT_MAGIC + struct.pack("<IQ", SEGMENT_VERSION, created_ns) + b"".join(map(segment_record, records))


def segment_records(raw: bytes, path: str = ""):
    """Content records of a segment file. ValueError for any damage but a cut-off last record."""
    if raw[:8] != SEGMENT_MAGIC or struct.unpack("<I", raw[8:12])[0] != SEGMENT_VERSION:
        raise ValueError("not a segment file")
    at = 20
    while at + 12 <= len(raw):
        magic, size, crc = struct.unpack("<3I", raw[at : at + 12])
        if magic != RECORD_MAGIC:
            raise ValueError("bad record magic")
        body = raw[at + 12 : at + 12 + size]
        if len(body) < size:
            return
        if zlib.crc32(body) != crc:
            raise ValueError("record checksum")
        ts, n = struct.unpack("<QH", body[32:42])
        p = 42 + n
        way, view, offset, length = struct.unpack("<BBQI", body[p : p + 14])
        if p + 14 + length != size:
            raise ValueError("record length")
        yield {"content_id": str(uuid.UUID(bytes=body[:16])), "flow_id": str(uuid.UUID(bytes=body[16:32])), "ts_ns": ts, "service": body[42:p].decode("utf-8", "replace") or None, "direction": DIRECTIONS[way], "view": VIEWS[view], "stream_offset": offset, "data": body[p + 14 :], "segment_path": path, "segment_offset": at}
        at += 12 + size


def segment_table(content: DataFrame, most: int = 64 << 20, budget: int | None = None, streams: int = 8) -> DataFrame:
    """Segments (path, content) of content records, in `streams` series by flow, each rotated at about `most` bytes.

    Names sort by series and time. Writing the table commits all segments at once or none. ValueError where the records take more than
    budget bytes.
    """
    size = F.octet_length("data") + F.octet_length(F.coalesce("service", F.lit(""))) + 68
    if budget is not None and (content.agg(F.sum(size)).first()[0] or 0) > budget:
        raise ValueError("segments would take more than their budget")
    rows = rotated(content.withColumn("__series", F.pmod(F.xxhash64("flow_id"), F.lit(streams))), size, most, ["ts_ns", "content_id"], ["__series"])
    name = F.concat(F.lpad(F.col("__series").cast("string"), 4, "0"), F.lit("-"), F.lpad(F.col("part").cast("string"), 10, "0"), F.lit(".seg"))
    return packed(rows, ["__series", "part"], ["ts_ns", "content_id"], name, SEGMENT_MAGIC + struct.pack("<IQ", SEGMENT_VERSION, 0), segment_record)


def segment_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a folder (path, content): .seg files, or a table that segment_table() wrote."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.seg").load(path).select("path", "content")


def list_segments(files: DataFrame) -> DataFrame:
    """Segment paths and sizes, in the order of their names."""
    return files.select("path", F.octet_length("content").cast("long").alias("bytes")).orderBy("path")


def scan_segments(files: DataFrame) -> DataFrame:
    """Content records of segments (path, content), with where each one lies. Damage other than a cut-off last record is an error."""
    schema = _segment_schema()

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for r in segment_records(raw.as_buffer().to_pybytes(), name.as_py()):
                    rows.append(r)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, SEGMENT)


def _segment_schema() -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, types[t]) for n, t in (f.split() for f in SEGMENT.split(", "))])


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Content records of the segment files of a folder."""
    return scan_segments(segment_files(spark, path))


def read_at(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Content records at places (segment_path, segment_offset): each segment is opened once for all its places, and a bad place tells its
    own error and leaves the others alone. The columns of records, and error (null where the record was read)."""
    schema = _segment_schema().append(pa.field("error", pa.string()))
    places = wanted.groupBy("segment_path").agg(F.collect_set("segment_offset").alias("offsets"))

    def one(raw: bytes, path: str, at: int) -> dict:
        try:
            if not 20 <= at <= len(raw) - 12:
                raise ValueError("no record there")
            found = next(segment_records(raw[:20] + raw[at : at + 12 + struct.unpack("<3I", raw[at : at + 12])[1]], path), None)
            if found is None:
                raise ValueError("record is cut off")
            return found | {"segment_offset": at, "error": None}
        except ValueError as e:
            return {n: None for n in schema.names} | {"segment_path": path, "segment_offset": at, "error": str(e)}

    def run(batches):
        for batch in batches:
            for path, raw, offsets in zip(*batch.columns, strict=True):
                blob = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                yield pa.RecordBatch.from_pylist([one(blob, path.as_py(), at) for at in sorted(offsets.as_py())], schema=schema)

    return places.join(files.withColumnRenamed("path", "segment_path"), "segment_path", "left").select("segment_path", "content", "offsets").mapInArrow(run, SEGMENT + ", error string")


def rebuild_index(content: DataFrame) -> DataFrame:
    """The content index out of content records; repeats go by key."""
    rows = content.withColumn("payload_len", F.length("data").cast("long")).drop("data")
    return rows.dropDuplicates(["flow_id", "ts_ns", "stream_offset", "content_id"])


SPOOL = "kind string, flow struct<flow_id:string,started_ns:long,ended_ns:long,src_ip:string,dst_ip:string,src_port:int,dst_port:int,protocol:string,service:string,packets_c2s:long,packets_s2c:long,bytes_c2s:long,bytes_s2c:long,truncated:boolean>, http struct<id:string,flow_id:string,ts_ns:long,request:boolean,method:string,host:string,path:string,status:int,user_agent:string,content_type:string,body_content_id:string>, match struct<pattern_id:string,pattern_revision:long,flow_id:string,content_id:string,view:string,action:string,ts_ns:long,offset_start:long,offset_end:long,historical:boolean>, content_index struct<content_id:string,flow_id:string,ts_ns:long,service:string,direction:string,view:string,stream_offset:long,payload_len:long,segment_path:string,segment_offset:long>"
SPOOL_TYPE = re.sub(r"(^|, )(\w+) ", r"\1\2:", SPOOL).replace(", ", ",")


def read_spool(spark: SparkSession, path: str) -> DataFrame:
    """Metadata events (JSON arrays, files named by sequence): the envelope and seq."""
    rows = spark.read.schema(SPOOL).option("multiLine", True).json(path)
    return rows.withColumn("seq", F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("long"))


def spool_events(tables: dict[str, DataFrame], most: int = 2048) -> DataFrame:
    """(seq, events): files of at most `most` metadata events as JSON arrays, from the fact tables' rows; a write of the table commits them together."""
    names = {"flow": "flows", "http": "http_messages", "match": "matches", "content_index": "content_index"}
    every = None
    for kind, table in names.items():
        if table in tables:
            at = F.xxhash64(*tables[table].columns)
            rows = tables[table].select(F.lit(kind).alias("kind"), F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct("*").alias(kind))).alias("event"), at.alias("__at"))
            every = rows if every is None else every.unionByName(rows)
    parts = every.withColumn("__part", F.pmod("__at", F.lit(max(1, -(-every.count() // most)))))
    return parts.groupBy(F.col("__part").alias("seq")).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("event")), F.lit("]")).alias("events"))


def spooled(files: DataFrame) -> DataFrame:
    """The envelopes of spool files held in a table (seq, events)."""
    return files.select(F.explode(F.from_json("events", f"array<struct<{SPOOL_TYPE}>>")).alias("e"), F.col("seq").cast("long").alias("seq")).select("e.*", "seq")


def demux(events: DataFrame) -> dict[str, DataFrame]:
    """The four fact tables' rows of an envelope of events."""
    names = {"flow": "flows", "http": "http_messages", "match": "matches", "content_index": "content_index"}
    return {table: events.where(F.col("kind") == kind).select(f"{kind}.*", F.col("seq").alias("ingest_seq")) for kind, table in names.items()}


def prometheus(metrics: DataFrame, prefix: str = "riverbed") -> DataFrame:
    """Exposition text, a line in each row, from (name, kind, value); bounded by the number of metrics."""
    name = F.concat(F.lit(prefix + "_"), F.col("name"))
    lines = F.array(F.concat(F.lit("# TYPE "), name, F.lit(" "), F.col("kind")), F.concat(name, F.lit(" "), F.col("value").cast("string")))
    return metrics.orderBy("name").select(F.explode(lines).alias("line"))
