import pytest

from riverbed.operators import registry
from riverbed.operators.matching import Group, Limits, Matcher, binary_literal, scan_record, views_of


def rule(expression, kind="text", **more):
    return {"id": more.pop("id", expression), "revision": 1, "expression": expression, "kind": kind, "action": "find", "direction_type": "both", "service": None, "view": "tcp_raw"} | more


def record(data, offset=0, cid="c", **more):
    return {"flow_id": "f", "direction": "a_to_b", "view": "tcp_raw", "content_id": cid, "service": None, "ts_ns": 1, "stream_offset": offset, "data": data} | more


def test_hits_across_records():
    m = Matcher([rule("NEED<")])
    assert not m.feed(record(b"xyNE"))
    assert [(h["offset_start"], h["offset_end"], h["content_id"]) for h in m.feed(record(b"ED<q>", 4, "d"))] == [(2, 7, "d")]
    m = Matcher([rule("NEED<")])
    m.feed(record(b"xyNE"))
    assert not m.feed(record(b"ED<q>", 5))  # a hole between them


def test_literals_of_a_group_do_not_overlap():
    assert [(a, b) for _, a, b in Group([rule("abcd"), rule("bc")]).find(b"abcd")] == [(1, 3)]
    assert [(a, b) for _, a, b in Group([rule("abc"), rule("bc")]).find(b"abc")] == [(0, 3)]
    g = Group([rule("abc"), rule("bc"), rule("cab")])
    fast = list(g.find(b"abcabcab"))
    g.ends = None
    assert fast == list(g.find(b"abcabcab"))


def test_limits():
    out, limited = scan_record(Group([rule("A")]), b"A" * 16, b"", 0, {}, Limits(pattern=3, record=32))
    assert len(out) == 3 and limited
    out, limited = scan_record(Group([rule("A"), rule("B")]), b"ABABABABAB", b"", 0, {}, Limits(pattern=32, record=4))
    assert len(out) == 4 and limited


def test_views_and_services():
    assert views_of("input", "tcp_raw") == () and views_of("both", "http_request_body") == ("http_request_body",)
    m = Matcher([rule("x", service="web"), rule("x", id="g")])
    assert [h["pattern_id"] for h in m.feed(record(b"x", service="web"))] == ["g", "x"] and [h["pattern_id"] for h in m.feed(record(b"x", 1))] == ["g"]


def test_regex_across_records():
    m = Matcher([rule("ab+", "regex")])
    assert [h["offset_end"] for h in m.feed(record(b"xab"))] == [3]
    assert [h["offset_end"] for h in m.feed(record(b"bb", 3))] == [5]


def test_validation():
    assert binary_literal("41 42:43") == b"ABC"
    for bad in (("binary", "4"), ("binary", " "), ("regex", "(?=a)"), ("regex", "("), ("text", ""), ("other", "x")):
        with pytest.raises(Exception):  # noqa: B017
            registry.validate(*bad)
    registry.validate("regex", "^courier/.*")
