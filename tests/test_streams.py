"""Reassembly, fragments, decoding and HTTP: the state machines on their own."""

import gzip
import struct

from riverbed.operators import decode
from riverbed.operators.fragments import Assembler
from riverbed.operators.http1 import Caps, Connection
from riverbed.operators.reassembly import Bounds, Gap, HalfStream
from riverbed.plans import fixtures as fx

S = 1_000_000_000


def stream(*segments, first=None, bounds=Bounds()):
    half, chunks, gaps = HalfStream(bounds), [], []
    if first is not None:
        half.observe(first, False)
    for s in segments:
        r = half.segment(*s)
        chunks += r.chunks
        gaps += r.gaps
    return half, chunks, gaps


def joined(chunks):
    return b"".join(c.data for c in chunks)


def test_order_is_restored_and_times_stay():
    _, chunks, gaps = stream((100, 1, b"abcd"), (108, 2, b"ijkl"), (104, 3, b"efgh"))
    assert [(c.data, c.ts_ns) for c in chunks] == [(b"abcd", 1), (b"efgh", 3), (b"ijkl", 2)] and not gaps


def test_retransmission_keeps_the_new_tail():
    _, chunks, _ = stream((10, 1, b"abcdef"), (12, 2, b"cdefGH"))
    assert [(c.offset, c.data) for c in chunks] == [(0, b"abcdef"), (6, b"GH")]


def test_bytes_seen_first_win():
    _, chunks, _ = stream((110, 1, b"BBBB"), (108, 2, b"AAXXXX"), (100, 3, b"abcdefgh"), first=100)
    assert joined(chunks) == b"abcdefghAABBBB"


def test_sequence_numbers_wrap():
    _, chunks, _ = stream((0xFFFFFFF0, 1, b"12345678"), (0, 3, b"BBBB"), (0xFFFFFFF8, 2, b"AAAAAAAA"))
    assert joined(chunks) == b"12345678AAAAAAAABBBB"


def test_acknowledged_hole_is_passed():
    half, _, _ = stream((100, 1, b"aaaa"), (108, 2, b"cccc"))
    r = half.acknowledge(112, 3)
    assert r.gaps == [Gap(4, 4)] and [(c.offset, c.data) for c in r.chunks] == [(8, b"cccc")]


def test_acknowledgement_reaches_only_as_far_as_it_says():
    half, _, _ = stream((100, 1, b"aaaa"), (112, 2, b"dddd"))
    assert half.acknowledge(108, 3).gaps == [Gap(4, 4)]
    assert half.acknowledge(112, 4).gaps == [Gap(8, 4)]


def test_old_hole_is_passed():
    _, chunks, gaps = stream((100, 1, b"aaaa"), (108, 2, b"cccc"), (112, 2 + S, b"dddd"))
    assert gaps == [Gap(4, 4)] and joined(chunks) == b"aaaaccccdddd"


def test_pressure_passes_holes():
    half, chunks, gaps = stream((100, 1, b"aa"), (110, 2, b"bb"), (120, 3, b"cc"), (130, 4, b"dd"), bounds=Bounds(runs=2))
    assert gaps and len(half.starts) <= 2


def test_end_needs_all_bytes_and_an_early_one_is_doubted():
    half, chunks, _ = stream((100, 1, b"ab", False, True))
    assert half.closed and joined(chunks) == b"ab"
    half, chunks, _ = stream((100, 1, b"a"), (103, 2, b"", False, True), (101, 3, b"bcdef"))
    assert not half.closed and joined(chunks) == b"abcdef"
    assert half.finish(9).chunks == []


def test_reset_counts_only_in_sequence():
    half, _, _ = stream((100, 1, b"ab"))
    assert half.accepts_reset(102) and not half.accepts_reset(103)


def part(offset, more, data):
    return {"version": 4, "domain": "0", "src_ip": "a", "dst_ip": "b", "id": 1, "next": 17, "offset": offset, "more": more, "data": data}


def test_fragments():
    box = Assembler()
    assert box.feed(part(8, False, b"end"), 1, 30) is None
    assert box.feed(part(0, True, b"12345678"), 2, 40) == (b"12345678end", 70)
    assert box.feed(part(0, True, b"12345678"), 3, 1) is None and box.feed(part(0, True, b"12345678"), 3, 1) is None
    assert box.feed(part(0, True, b"abcdefgh"), 4, 1) is None and not box.open  # a contradiction drops all
    box.feed(part(0, True, b"1234567812345678"), 5, 1)
    box.feed(part(8, True, b"12345678"), 5, 1)
    assert not box.open
    box.feed(part(0, True, b"12345678"), 6, 1)
    box.feed(part(8, False, b"x"), 6 + 30 * S, 1)  # too late for the first part
    assert len(box.open) == 1


def test_decode_tunnels_and_tags():
    plain = fx.tcp("1.1.1.1", 5, "2.2.2.2", 80, 1, 0, fx.SYN, b"hi")
    assert decode.decode(plain).payload == b"hi" and decode.decode(plain).l2_domain == "0"
    tagged = plain[:12] + b"\x81\x00\x00\x05" + plain[12:]
    assert decode.decode(tagged).status == "packet" and decode.decode(tagged).l2_domain != "0"
    there = fx.ipv4("9.9.9.1", "9.9.9.2", 17, fx.udp(1, 4789, b"\x08\0\0\0\0\0\x07\0" + plain))
    back = fx.ipv4("9.9.9.2", "9.9.9.1", 17, fx.udp(1, 4789, b"\x08\0\0\0\0\0\x07\0" + plain))
    assert decode.decode(there).src_ip == "1.1.1.1" and decode.decode(there).l2_domain == decode.decode(back).l2_domain != "0"
    gre = fx.ipv4("9.9.9.1", "9.9.9.2", 47, struct.pack(">HH", 0, 0x0800) + plain[14:])
    assert decode.decode(gre).dst_port == 80
    assert decode.decode(plain[:40]).status == "error" and decode.decode(b"").status == "error"
    assert decode.decode(plain[:12] + b"\x08\x06" + plain[14:]).status == "ignored"


def test_decode_ipv6():
    body = struct.pack(">HHIIBBHHH", 1, 2, 3, 4, 0x50, 2, 0, 0, 0)
    head = lambda n, kind: fx.MAC + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, n, kind, 9) + bytes(15) + b"\1" + bytes(15) + b"\2"
    assert decode.decode(head(20, 6) + body).src_ip == "::1"
    whole = bytes([6, 0, 0, 0]) + bytes(4)  # a fragment header of a datagram in one part
    assert decode.decode(head(28, 44) + whole + body).status == "packet"
    first = bytes([6, 0, 0, 1]) + bytes(4)
    assert decode.decode(head(28, 44) + first + body).status == "fragment"


def feed(conn, direction, data, step=7):
    for k in range(0, len(data), step):
        conn.feed(direction, k, k, data[k : k + step])


def test_http_pipelining_and_head():
    conn = Connection()
    feed(conn, "a_to_b", b"HEAD /a HTTP/1.1\r\n\r\nGET /b HTTP/1.1\r\n\r\n")
    feed(conn, "b_to_a", b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\nHTTP/1.1 204 No\r\n\r\n")
    assert [m["status"] for m in conn.take()[1] if not m["request"]] == [200, 204]


def test_http_bad_length_goes_on_at_the_next_message():
    conn = Connection()
    conn.feed("a_to_b", 0, 0, b"GET /x HTTP/1.1\r\nContent-Length: 2\r\nContent-Length: 9\r\n\r\nGET /ok HTTP/1.1\r\n\r\n")
    assert [m["path"] for m in conn.take()[1]] == ["/ok"] and conn.errors == 1


def test_http_chunks_and_gzip():
    conn, body = Connection(), gzip.compress(b"hello" * 3)
    feed(conn, "a_to_b", b"GET / HTTP/1.1\r\n\r\n")
    feed(conn, "b_to_a", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + b"%x;e=1\r\n" % len(body) + body + b"\r\n0\r\nT: 1\r\n\r\n")
    records = conn.take()[0]
    assert [r["data"] for r in records if r["view"] == "http_response_decoded_body"] == [b"hello" * 3]
    assert b"".join(r["data"] for r in records if r["view"] == "http_response_body") == body


def test_http_body_cap_keeps_framing():
    conn = Connection(Caps(body=4))
    feed(conn, "a_to_b", b"POST /x HTTP/1.1\r\nContent-Length: 10\r\n\r\n0123456789GET /y HTTP/1.1\r\n\r\n")
    records, messages = conn.take()
    assert b"".join(r["data"] for r in records if r["view"] == "http_request_body") == b"0123" and [m["path"] for m in messages] == ["/x", "/y"]


def test_http_gap_tunnel_and_end():
    conn = Connection()
    conn.feed("a_to_b", 0, 0, b"GET /x HTT")
    conn.feed("a_to_b", 50, 1, b"rest\r\nGET /z HTTP/1.1\r\n\r\n")
    assert [m["path"] for m in conn.take()[1]] == ["/z"]
    conn = Connection()
    feed(conn, "a_to_b", b"CONNECT h:1 HTTP/1.1\r\n\r\n")
    feed(conn, "b_to_a", b"HTTP/1.1 200 OK\r\n\r\n")
    assert conn.tunnel
    conn = Connection()
    feed(conn, "a_to_b", b"GET / HTTP/1.1\r\n\r\n")
    feed(conn, "b_to_a", b"HTTP/1.0 200 OK\r\nTransfer-Encoding: identity\r\n\r\nto the end")
    conn.finish()
    assert b"".join(r["data"] for r in conn.take()[0] if r["view"] == "http_response_body") == b"to the end"


def test_http_queue_and_ambiguous_framing():
    conn = Connection(Caps(queue=2))
    feed(conn, "a_to_b", b"HEAD /1 HTTP/1.1\r\n\r\nGET /2 HTTP/1.1\r\n\r\nGET /3 HTTP/1.1\r\n\r\n")
    assert conn.errors == 1 and list(conn.requests) == ["GET", "GET"]  # the oldest went
    conn = Connection()
    feed(conn, "a_to_b", b"POST / HTTP/1.1\r\nContent-Length: 3\r\nTransfer-Encoding: chunked\r\n\r\n1\r\nx\r\n0\r\n\r\n")
    assert conn.errors == 1 and b"".join(r["data"] for r in conn.take()[0] if r["view"] == "http_request_body") == b"x"
    conn = Connection()
    feed(conn, "a_to_b", b"HEAD /1 HTTP/1.1\r\n\r\nBAD LINE\r\n\r\nGET /2 HTTP/1.1\r\n\r\n")
    assert conn.errors == 1 and list(conn.requests) == ["GET"]  # what was asked before a bad header is forgotten
    conn = Connection(Caps(header=200))
    feed(conn, "a_to_b", b"GET /" + b"a" * 400 + b" HTTP/1.1\r\n\r\nGET /ok HTTP/1.1\r\n\r\n")
    assert [m["path"] for m in conn.take()[1]] == ["/ok"]
    conn = Connection(Caps(header=200))
    feed(conn, "a_to_b", b"GET / HTTP/1.1\r\nX: " + b"b" * 500 + b"\r\n\r\nGET /ok HTTP/1.1\r\n\r\n")
    assert [m["path"] for m in conn.take()[1]] == ["/ok"] and conn.errors >= 1


def test_gre_routes_end_with_an_empty_entry():
    plain = fx.tcp("1.1.1.1", 5, "2.2.2.2", 80, 1, 0, fx.SYN, b"hi")
    routes = struct.pack(">HBB", 0x0800, 0, 0) + struct.pack(">HBB", 0x0800, 0, 4) + b"abcd" + bytes(4)
    gre = lambda r: fx.ipv4("9.9.9.1", "9.9.9.2", 47, struct.pack(">HHI", 0x4000, 0x0800, 0) + r + plain[14:])
    assert decode.decode(gre(routes)).dst_port == 80 and decode.decode(gre(routes[:-2])).status != "packet"
