"""The fixture capture from frames to answers, file formats, and streaming against batch."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from riverbed.operators import connections, decode, facts, http1, matching
from riverbed.operators.flows import TrafficFilter, select_flows
from riverbed.plans import fixtures as fx
from riverbed.sources import files
from riverbed.streaming import jobs


@pytest.fixture(scope="module")
def flows(spark):
    return connections.flows(fx.events(spark)).cache()


def test_two_flows(flows):
    rows = {r["src_ip"]: r for r in flows.collect()}
    assert set(rows) == {"172.20.4.9", "172.20.6.30"}
    assert rows["172.20.4.9"]["closed_by"] == "fin" and rows["172.20.6.30"]["closed_by"] == "end"
    assert rows["172.20.4.9"]["packets_c2s"] == 4 and rows["172.20.4.9"]["packets_s2c"] == 3


def test_user_agent_filters(spark, flows):
    http = http1.messages_of(fx.events(spark)).cache()
    src = lambda **f: {r["src_ip"] for r in select_flows(flows, TrafficFilter(**f), http).collect()}
    assert src(user_agent="COURIER") == src(user_agent_equals="courier/5.1") == src(user_agent_regex="^courier/.*") == {"172.20.4.9"}
    assert src(user_agent_not_contains="stray") == {"172.20.4.9", "172.20.6.30"} and src(user_agent_not_contains="courier") == {"172.20.6.30"}


def test_late_rule_finds_stored_content(spark):
    rows = fx.hits(spark).collect()
    assert rows and all(r["historical"] for r in rows) and {r["view"] for r in rows} == {"tcp_raw"}
    shown = {r["view"] for r in fx.content(spark).collect()}
    assert {"tcp_raw", "http_request_headers", "http_request_body", "http_response_headers", "http_response_body"} <= shown


def test_pcap_files(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(files.pcap_bytes((t, w, d) for _, t, w, d in fx.rows()))
    rows = files.read_pcap(spark, str(tmp_path)).orderBy("frame_no").collect()
    assert [(r["ts_ns"], bytes(r["data"])) for r in rows] == [(t, d) for _, t, _, d in fx.rows()]
    q = files.stream_pcap(spark, str(tmp_path)).writeStream.format("memory").queryName("pcap").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pcap").count() == len(rows)


def test_segments(spark, tmp_path):
    record = {"content_id": str(uuid.UUID(int=1)), "flow_id": str(uuid.UUID(int=2)), "ts_ns": 5, "service": "web", "direction": "b_to_a", "view": "http_response_body", "stream_offset": 9, "data": b"abc"}
    raw = files.segment_bytes([record, record | {"service": None}])
    (tmp_path / "s.seg").write_bytes(raw + b"cut")
    rows = files.read_segments(spark, str(tmp_path)).orderBy("segment_offset").collect()
    assert len(rows) == 2 and bytes(rows[0]["data"]) == b"abc" and rows[1]["service"] is None and rows[0]["segment_offset"] == 20
    with pytest.raises(ValueError):
        list(files.segment_records(raw[:-1] + b"X"))
    assert files.rebuild_index(files.read_segments(spark, str(tmp_path))).count() == 1  # one key


def test_spool_fills_the_fact_tables(spark, tmp_path):
    spool = tmp_path / "spool"
    spool.mkdir()
    hit = {"kind": "match", "match": {"pattern_id": "p", "pattern_revision": 1, "flow_id": "f", "content_id": "c", "view": "tcp_raw", "action": "find", "ts_ns": 1, "offset_start": 0, "offset_end": 2, "historical": False}}
    (spool / f"{1:020}.json").write_text(json.dumps([hit, {"kind": "flow", "flow": {"flow_id": "f", "started_ns": 1}}]))
    (spool / f"{2:020}.json").write_text(json.dumps([hit | {"match": hit["match"] | {"historical": True}}]))
    tables = files.demux(files.read_spool(spark, str(spool)))
    assert [r["historical"] for r in facts.latest(tables["matches"], facts.KEYS["matches"]).collect()] == [True]
    assert tables["flows"].count() == 1
    stream = spark.readStream.schema(files.SPOOL).option("multiLine", True).json(str(spool))
    q = jobs.table_sink(stream, str(tmp_path / "out"), str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out/matches")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, k * 700_000_000, k % 3, 100 + k) for k in range(40)]
    packets = spark.createDataFrame(rows, "frame_no long, ts_ns long, ip4 long, wire_len long")
    folder = tmp_path / "in"
    packets.coalesce(1).write.json(str(folder))
    stream = spark.readStream.schema(packets.schema).json(str(folder))
    q = jobs.source_windows(stream).writeStream.format("memory").queryName("topo").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    want = jobs.source_windows(packets)
    assert sorted(map(tuple, spark.table("topo").collect())) == sorted(map(tuple, want.collect()))
    q = jobs.idle_sessions(stream, ["ip4"], "3 seconds").writeStream.format("memory").queryName("sess").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("sess").collect())) == sorted(map(tuple, jobs.idle_sessions(packets, ["ip4"], "3 seconds").collect()))


def test_live_matching_crosses_batches(spark, tmp_path):
    schema = "flow_id string, direction string, view string, stream_offset long, content_id string, service string, ts_ns long, data binary"
    content = spark.createDataFrame([("f", "a_to_b", "tcp_raw", 0, "a", None, fx.BASE_NS, b"xxNE"), ("f", "a_to_b", "tcp_raw", 4, "b", None, fx.BASE_NS + 2, b"ED<y>")], schema)
    rules = [{"id": "need", "revision": 1, "expression": "NEED<", "kind": "text", "action": "find", "direction_type": "both", "service": None, "view": None}]
    folder = tmp_path / "in"
    for k in range(2):
        content.where(F.col("stream_offset") == 4 * k).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("part*.parquet"):
            new = f.with_name(f"x{k}.parquet")
            if not f.name.startswith("x"):
                f.rename(new)
                os.utime(new, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(content.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = jobs.live_matches(stream, rules).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [(r["content_id"], r["offset_start"]) for r in spark.table("live").collect()]
    assert got == [(r["content_id"], r["offset_start"]) for r in matching.scan(content, rules).collect()] == [("b", 2)]


def test_expressions_and_bytes_decode_alike(spark):
    import random

    rng, rows = random.Random(7), []
    whole = [fx.tcp("1.2.3.4", 5, "250.0.0.1", 80, 2**32 - 1, 2**31, fx.PSH | fx.ACK, b"abc"), fx.ipv4("1.2.3.4", "9.9.9.9", 17, fx.udp(53, 8080, b"")), fx.ipv4("1.2.3.4", "9.9.9.9", 17, fx.udp(53, 4789, b"12345678" * 9)), fx.ipv4("1.2.3.4", "9.9.9.9", 1, b"ping")]
    for f in whole:
        rows += [f, f + b"padding", f[:12] + b"\x81\x00\x00\x07" + f[12:]]
        for _ in range(120):
            b = bytearray(f)
            b[rng.randrange(12, len(b))] = rng.randrange(256)
            rows.append(bytes(b[: rng.randrange(len(b) + 1)] if rng.random() < 0.4 else b))
    df = fx.as_frames(spark, [(k, k, len(f), f) for k, f in enumerate(rows)])
    got = {r["frame_no"]: r.asDict(recursive=True) for r in decode.frames_to_packets(df).collect()}
    for k, f in enumerate(rows):
        want = decode.packet_row({"path": "", "frame_no": k, "arrival_ns": 0, "ts_ns": k}, len(f), decode.decode(f))
        assert got[k] == want, f
    worth = {r[0] for r in df.where(decode.worth_decoding(F.col("data"), [8080])).select("frame_no").collect()}
    for k, f in enumerate(rows):
        o = decode.decode(f)
        assert k in worth or o.status != "packet" or 8080 not in (o.src_port, o.dst_port)


def test_streams_from_reordered_segments_reach_the_parser_in_order(spark):
    post = b"POST /late HTTP/1.1\r\nContent-Length: 6\r\n\r\nabcdef"
    parts = [(0, 20), (40, len(post)), (20, 40)]  # the second comes last
    a, b = ("172.20.4.9", 31007), ("172.20.8.1", 8080)
    frames = [fx.tcp(*a, *b, 99, 0, fx.SYN), fx.tcp(*b, *a, 9, 100, fx.SYN | fx.ACK)] + [fx.tcp(*a, *b, 100 + i, 10, fx.PSH | fx.ACK, post[i:j]) for i, j in parts]
    packets = decode.frames_to_packets(fx.as_frames(spark, [(k, k * 1_000_000, len(f), f) for k, f in enumerate(frames)]))
    e = connections.track(packets, [8080])
    for found in (connections.dataflow(packets, [8080], [8080]), http1.parse(connections.chunks(e))):
        rows = found.collect()
        assert [r["path"] for r in rows if r["kind"] == "message"] == ["/late"]
        assert b"".join(bytes(r["data"]) for r in sorted((r for r in rows if r["kind"] == "content" and r["view"] == "http_request_body"), key=lambda r: r["stream_offset"])) == b"abcdef"


def test_several_captures(spark, tmp_path):
    rows = fx.rows()
    for k, some in enumerate((rows[:5], rows[5:])):
        (tmp_path / f"{'ba'[k]}.pcap").write_bytes(files.pcap_bytes((t, w, d) for _, t, w, d in some))
    e = connections.track(decode.frames_to_packets(files.read_pcap(spark, str(tmp_path))), [8080])
    counted = lambda e: sorted((r["src_ip"], r["packets_c2s"], r["packets_s2c"], r["closed_by"]) for r in connections.flows(e).collect())
    assert counted(e) == counted(fx.events(spark)) and len(counted(e)) == 2


def test_snapshots_and_plain_state():
    import pickle

    def packet(k, d, data=b"", syn=False, ack=True):
        a, b = (("10.0.0.1", 999), ("10.0.0.2", 8080))
        src, dst = (a, b) if d == "a_to_b" else (b, a)
        return {"path": "", "frame_no": k, "arrival_ns": 0, "ts_ns": k * 400_000_000, "src_ip": src[0], "dst_ip": dst[0], "src_port": src[1], "dst_port": dst[1], "seq": 100 + (0 if syn else 1 + 2 * (k - 1)), "ack": None, "flags": {"fin": False, "syn": syn, "rst": False, "psh": False, "ack": ack}, "payload": data, "direction": d, "protocol": "tcp"}

    tracker, shown, chunks = connections.Tracker(("k",), {8080}), 0, 0
    for k in range(1, 12):
        chunks += sum(e["kind"] == "chunk" for e in tracker.feed(packet(k, "a_to_b", b"xy") if k > 1 else packet(1, "a_to_b", b"", True, False) | {"seq": 102}))
        shown += len(tracker.snapshot())
        tracker = connections.Tracker(("k",), {8080}).load(pickle.loads(pickle.dumps(tracker.dump())))
    assert chunks == 10 and shown == 4 and tracker.finish()[-1]["bytes_c2s"] == 20


def test_flow_caps(spark):
    rows = [("f0", 0, 10, "10.0.0.1"), ("f1", 1, 3, "10.0.0.2"), ("f2", 2, 9, "10.0.0.3"), ("f3", 4, 5, "10.0.0.4"), ("g0", 2, 9, "10.0.1.1")]
    flows = spark.createDataFrame(rows, "flow_id string, started_ns long, ended_ns long, src_ip string")
    kept = lambda *a: sorted(r[0] for r in connections.admitted(flows, *a).collect())
    assert kept(2, 24) == ["f0", "f1", "f3", "g0"] and kept(2) == ["f0", "f1", "f3"] and kept(9) == sorted(r[0] for r in rows)


def test_rules_change_between_batches(spark, tmp_path):
    schema = "flow_id string, direction string, view string, stream_offset long, content_id string, service string, ts_ns long, data binary"
    parts = [("f", "a_to_b", "tcp_raw", 0, "a", None, 1, b"one tw"), ("f", "a_to_b", "tcp_raw", 6, "b", None, 2, b"o one")]
    rule = lambda e: {"id": e, "revision": 1, "expression": e, "kind": "text", "action": "find", "direction_type": "both", "service": None, "view": None}
    asked = []

    def rules():
        asked.append(1)
        return [rule("two"), rule("one")] if len(asked) < 2 else [rule("two")]

    for k, p in enumerate(parts):
        spark.createDataFrame([p], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = jobs.swapping_matches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), rules, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    hits = spark.read.option("recursiveFileLookup", True).parquet(*[str(tmp_path / f"out/hits/batch={k}") for k in range(2)])
    assert sorted((r["pattern_id"], r["offset_start"]) for r in hits.collect()) == [("one", 0), ("two", 4)]
