"""Engine tables made from the driver's tables, which hold no packets. PRELUDE has the same tables as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sessions

IDLE_NS = 43_200_000_000_000
SERVICES = ((8080, "web", True, True), (8081, "shop", True, True), (8082, "pay", True, False), (8083, "auth", True, True), (8084, "old", False, True))
PATTERNS = (("p1", 1, "the", "text", "find", "both", None, None, True), ("p1", 2, "and", "text", "find", "both", None, None, True), ("p2", 1, "er", "text", "find", "input", "web", None, True), ("p3", 1, "[0-9]+", "regex", "find", "output", None, None, True), ("p4", 1, "6f 6e", "binary", "ignore", "both", None, "tcp_raw", True), ("p5", 1, "in", "text", "find", "both", None, None, True), ("p5", 2, "in", "text", "find", "both", None, None, False), ("p6", 3, "st", "text", "ignore", "output", None, "tcp_raw", True), ("p7", 1, "of", "text", "ignore", "input", None, None, True))
#: rule, network, prefix, percent, set, expires, cleared: all lengths, one that ran out inside a live network, one set again, one cleared, one that drops nothing.
RULES = (
    (1, "10.1.1.0", 24, 30, 0, 4102444800000000000, None),
    (2, "10.1.1.1", 32, 60, 0, 4102444800000000000, None),
    (3, "10.2.3.0", 24, 10, 0, 4102444800000000000, None),
    (4, "10.3.5.0", 24, 100, 0, 1704844800000000000, None),
    (5, "10.0.0.7", 32, 50, 1704067200000000000, 1704931200000000000, None),
    (6, "10.2.0.0", 16, 20, 0, 0, None),
    (7, "10.1.1.0", 24, 45, 1704700000000000000, 4102444800000000000, None),
    (8, "10.2.3.9", 32, 80, 0, 1704300000000000000, None),
    (9, "10.0.1.0", 24, 0, 0, 4102444800000000000, None),
    (10, "10.3.0.0", 17, 35, 1704100000000000000, 4102444800000000000, 1704500000000000000),
    (11, "10.3.5.0", 24, 15, 1705000000000000000, 4102444800000000000, None),
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def literal(spark: SparkSession, rows: tuple, schema: str) -> DataFrame:
    """A constant table as a local relation."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [f.split()[1] for f in schema.split(", ")]
    structs = [F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(r, names, kinds, strict=True)]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def services(spark: SparkSession) -> DataFrame:
    return literal(spark, SERVICES, "port int, name string, enabled boolean, http boolean")


def patterns(spark: SparkSession) -> DataFrame:
    return literal(spark, PATTERNS, "id string, revision long, expression string, kind string, action string, direction_type string, service string, view string, enabled boolean")


def rules(spark: SparkSession) -> DataFrame:
    from ..operators.addresses import ip4

    df = literal(spark, RULES, "rule_id long, net_text string, prefix int, drop_percent int, created_ns long, expires_ns long, cleared_ns long")
    return df.withColumn("net", ip4(F.col("net_text"))).drop("net_text")


def packets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    u = F.col("user_id")
    port = F.create_map(*[F.lit(x) for kv in {"click": 8080, "view": 8081, "purchase": 8082, "signup": 8083}.items() for x in kv])
    ts = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns")
    src = F.concat_ws(".", F.lit("10"), (u % 4).cast("string"), (u % 7).cast("string"), (u % 50).cast("string"))
    client, server = F.struct(src.alias("ip"), (20000 + u % 30000).cast("int").alias("port")), F.struct(F.lit("192.168.0.10").alias("ip"), F.coalesce(F.element_at(port, F.col("event_type")), F.lit(9999)).alias("port"))
    reply = F.col("event_id") % 3 == 0
    a, b = F.when(reply, server).otherwise(client), F.when(reply, client).otherwise(server)
    value = F.coalesce("value", F.lit(0.0))
    return e.select(F.col("event_id").alias("frame_no"), ts, "user_id", a["ip"].alias("src_ip"), b["ip"].alias("dst_ip"), a["port"].alias("src_port"), b["port"].alias("dst_port"), F.when(u % 5 == 0, "udp").otherwise("tcp").alias("protocol"), (~reply).alias("a_to_b"), (167772160 + (u % 4) * 65536 + (u % 7) * 256 + u % 50).alias("ip4"), (60 + F.round(value * 100)).cast("bigint").alias("wire_len"), F.floor(value).cast("bigint").alias("payload_len"), server["port"].alias("service_port"))


def flows_versions(spark: SparkSession, d: str) -> DataFrame:
    """Flows as sessions by user and protocol, in two versions: a live snapshot, then the final row."""
    s = sessions.idle_sessions(packets(spark, d), ["user_id", "protocol"], IDLE_NS)
    head = s.groupBy("user_id", "protocol", "session").agg(F.min_by(F.struct("src_ip", "dst_ip", "src_port", "dst_port", "service_port"), F.struct("ts_ns", "frame_no")).alias("h"))
    rows = sessions.summaries(s, ["user_id", "protocol"]).join(head, ["user_id", "protocol", "session"]).select("*", "h.*")
    rows = sessions.attribute(rows, services(spark)).withColumn("flow_id", F.concat_ws("-", F.lit("f"), "user_id", "session")).withColumn("flow_no", F.col("user_id") * 1000 + F.col("session"))
    cols = ["flow_id", "started_ns", "ended_ns", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "service", "packets_c2s", "packets_s2c", "bytes_c2s", "bytes_s2c", "flow_no", "initiator_a"]
    final = rows.select(*cols, F.lit(False).alias("truncated"), F.lit(2).cast("bigint").alias("ingest_seq"))
    early = final.withColumn("ended_ns", F.col("started_ns")).withColumn("packets_s2c", F.lit(0).cast("bigint")).withColumn("truncated", F.lit(True)).withColumn("ingest_seq", F.lit(1).cast("bigint"))
    return final.unionByName(early)


def flows(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.facts import latest

    return latest(flows_versions(spark, d), ["flow_id"])


def http_messages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as requests of flows: page n belongs to session 1 of user n modulo 97."""
    p = table(spark, d, "pages")
    k = F.col("page_id")
    ua = F.element_at(F.array(*map(F.lit, ("courier/5.1", "fetcher/0.9", "", "Mozilla/5.0 (X11)"))), (k % 4 + 1).cast("int"))
    return p.select(k.cast("string").alias("id"), F.concat_ws("-", F.lit("f"), (k % 97).cast("string"), F.lit("1")).alias("flow_id"), (k * 1_000_000_000).alias("ts_ns"), (k % 2 == 0).alias("request"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+(/.*)$", 1).alias("path"), F.when(k % 5 == 0, F.lit(None)).otherwise(ua).alias("user_agent"), F.when(k % 2 == 1, 200).alias("status"), F.when(k % 2 == 0, "GET").alias("method"))


def matches(spark: SparkSession, d: str) -> DataFrame:
    """Events as hits; keys repeat, and the later row wins."""
    from ..operators.facts import KEYS, latest

    k, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, d, "events").select(F.concat(F.lit("p"), (k % 7 + 1).cast("string")).alias("pattern_id"), (k % 2 + 1).alias("pattern_revision"), F.concat_ws("-", F.lit("f"), (u % 97).cast("string"), (k % 2 + 1).cast("string")).alias("flow_id"), (k % 500).cast("string").alias("content_id"), F.when(k % 11 == 0, "ignore").otherwise("find").alias("action"), (k * 1000).alias("ts_ns"), (k % 3).alias("offset_start"), (k % 3 + 4).alias("offset_end"), (k % 2 == 0).alias("historical"), k.alias("ingest_seq"))
    return latest(rows, KEYS["matches"])


def favorites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").where("quality = 1").select(F.concat_ws("-", F.lit("f"), (F.col("doc_id") % 97).cast("string"), F.lit("1")).alias("flow_id")).distinct()


def content(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as content: raw chunks, and every other turn also as a body record over the same bytes."""
    c = table(spark, d, "conversations").select(F.col("conv_id"), F.col("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumn("direction", F.when(F.col("role") == "user", "a_to_b").otherwise("b_to_a")).withColumn("payload_len", F.octet_length("text").cast("bigint"))
    c = sessions.stream_offsets(c, ["conv_id", "direction"], F.col("payload_len"), ["turn"])
    body = F.when(F.col("direction") == "a_to_b", "http_request_body").otherwise("http_response_body")
    raw = c.withColumn("view", F.lit("tcp_raw")).withColumn("content_id", F.concat_ws("-", F.lit("r"), "conv_id", "turn"))
    http = c.where("turn % 2 = 0").withColumn("view", body).withColumn("content_id", F.concat_ws("-", F.lit("h"), "conv_id", "turn"))
    both = raw.unionByName(http)
    return both.select("content_id", F.concat_ws("-", F.lit("f"), "conv_id", F.lit("1")).alias("flow_id"), "direction", "view", "stream_offset", "payload_len", "text", F.encode("text", "UTF-8").alias("data"), (F.col("turn") * 1000).alias("ts_ns"), F.lit(None).cast("string").alias("service"), F.concat(F.lit("seg-"), (F.col("conv_id") % 5).cast("string")).alias("segment_path"), F.col("conv_id").alias("ingest_seq"))


def content_hits(spark: SparkSession, d: str) -> DataFrame:
    """A hit of four bytes at the start of every third raw record."""
    c = content(spark, d).where("view = 'tcp_raw' and payload_len >= 4 and ingest_seq % 3 = 0")
    return c.select(F.lit("p1").alias("pattern_id"), F.lit(1).cast("bigint").alias("pattern_revision"), "flow_id", "content_id", F.col("stream_offset").alias("offset_start"), (F.col("stream_offset") + 4).alias("offset_end"), F.lit(False).alias("historical"))


LONG = {"revision", "rule_id", "created_at", "created_ns", "expires_ns", "cleared_ns", "at_ns", "depth", "capacity"}


def _values(rows: tuple, names: str) -> str:
    def show(v, name: str) -> str:
        if v is None:
            return "CAST(NULL AS BIGINT)" if name in LONG else "NULL"
        text = str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
        return f"CAST({text} AS BIGINT)" if name in LONG else text

    cols = names.split(", ")
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r, cols)) + ')' for r in rows)}) AS t({names})"


#: name -> (tables it needs, SQL)
PRELUDE: dict[str, tuple[tuple[str, ...], str]] = {
    "services": ((), _values(SERVICES, "port, name, enabled, http")),
    "patterns": ((), _values(PATTERNS, "id, revision, expression, kind, action, direction_type, service, view, enabled")),
    "rules": ((), "SELECT rule_id, prefix, drop_percent, created_ns, expires_ns, cleared_ns, CAST(split_part(net_text, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(net_text, '.', 2) AS BIGINT) * 65536 + CAST(split_part(net_text, '.', 3) AS BIGINT) * 256 + CAST(split_part(net_text, '.', 4) AS BIGINT) AS net FROM (" + _values(RULES, "rule_id, net_text, prefix, drop_percent, created_ns, expires_ns, cleared_ns") + ")"),
    "force": (("rules",), "SELECT *, least(CASE WHEN expires_ns > 0 THEN expires_ns END, lead(created_ns) OVER (PARTITION BY net, prefix ORDER BY created_ns, rule_id), cleared_ns, 9223372036854775807) AS until_ns FROM rules"),
    "packets": ((), """SELECT frame_no, ts_ns, user_id, CASE WHEN reply THEN '192.168.0.10' ELSE c_ip END AS src_ip, CASE WHEN reply THEN c_ip ELSE '192.168.0.10' END AS dst_ip,
      CASE WHEN reply THEN service_port ELSE c_port END AS src_port, CASE WHEN reply THEN c_port ELSE service_port END AS dst_port, protocol, NOT reply AS a_to_b, ip4, wire_len, payload_len, service_port
      FROM (SELECT event_id AS frame_no, epoch_us(ts) * 1000 AS ts_ns, user_id, event_id % 3 = 0 AS reply, concat('10.', user_id % 4, '.', user_id % 7, '.', user_id % 50) AS c_ip, CAST(20000 + user_id % 30000 AS INTEGER) AS c_port,
        CASE event_type WHEN 'click' THEN 8080 WHEN 'view' THEN 8081 WHEN 'purchase' THEN 8082 WHEN 'signup' THEN 8083 ELSE 9999 END AS service_port, CASE WHEN user_id % 5 = 0 THEN 'udp' ELSE 'tcp' END AS protocol,
        167772160 + (user_id % 4) * 65536 + (user_id % 7) * 256 + user_id % 50 AS ip4, CAST(60 + round(coalesce(value, 0) * 100) AS BIGINT) AS wire_len, CAST(floor(coalesce(value, 0)) AS BIGINT) AS payload_len FROM events)"""),
    "sess": (("packets",), f"SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id, protocol ORDER BY ts_ns, frame_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY user_id, protocol ORDER BY ts_ns, frame_no) <= {IDLE_NS} THEN 0 ELSE 1 END AS fresh FROM packets)"),
    "flows": (("sess", "services"), """SELECT concat('f-', user_id, '-', session) AS flow_id, started_ns, ended_ns, src_ip, dst_ip, src_port, dst_port, protocol, coalesce(s1.name, s2.name) AS service,
      CASE WHEN initiator_a THEN na ELSE nb END AS packets_c2s, CASE WHEN initiator_a THEN nb ELSE na END AS packets_s2c, CASE WHEN initiator_a THEN ba ELSE bb END AS bytes_c2s, CASE WHEN initiator_a THEN bb ELSE ba END AS bytes_s2c,
      user_id * 1000 + session AS flow_no, initiator_a, false AS truncated, CAST(2 AS BIGINT) AS ingest_seq
      FROM (SELECT user_id, protocol, session, min(ts_ns) AS started_ns, max(ts_ns) AS ended_ns, arg_min(a_to_b, (ts_ns, frame_no)) AS initiator_a, arg_min(src_ip, (ts_ns, frame_no)) AS src_ip, arg_min(dst_ip, (ts_ns, frame_no)) AS dst_ip,
        arg_min(src_port, (ts_ns, frame_no)) AS src_port, arg_min(dst_port, (ts_ns, frame_no)) AS dst_port, count(*) FILTER (WHERE a_to_b) AS na, count(*) FILTER (WHERE NOT a_to_b) AS nb,
        CAST(sum(CASE WHEN a_to_b THEN payload_len ELSE 0 END) AS BIGINT) AS ba, CAST(sum(CASE WHEN a_to_b THEN 0 ELSE payload_len END) AS BIGINT) AS bb, count(*) FILTER (WHERE payload_len > 0) AS np FROM sess GROUP BY ALL) AS g
      LEFT JOIN services AS s1 ON s1.enabled AND s1.port = dst_port LEFT JOIN services AS s2 ON s2.enabled AND s2.port = src_port WHERE np > 0"""),
    "http_messages": ((), """SELECT CAST(page_id AS VARCHAR) AS id, concat('f-', page_id % 97, '-1') AS flow_id, page_id * 1000000000 AS ts_ns, page_id % 2 = 0 AS request, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) AS path,
      CASE WHEN page_id % 5 = 0 THEN NULL ELSE (['courier/5.1', 'fetcher/0.9', '', 'Mozilla/5.0 (X11)'])[page_id % 4 + 1] END AS user_agent, CASE WHEN page_id % 2 = 1 THEN 200 END AS status, CASE WHEN page_id % 2 = 0 THEN 'GET' END AS method FROM pages"""),
    "matches": ((), """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id, pattern_revision, content_id, offset_start ORDER BY ingest_seq DESC) AS rn FROM (
      SELECT concat('p', event_id % 7 + 1) AS pattern_id, event_id % 2 + 1 AS pattern_revision, concat('f-', user_id % 97, '-', event_id % 2 + 1) AS flow_id, CAST(event_id % 500 AS VARCHAR) AS content_id, CASE WHEN event_id % 11 = 0 THEN 'ignore' ELSE 'find' END AS action,
      event_id * 1000 AS ts_ns, event_id % 3 AS offset_start, event_id % 3 + 4 AS offset_end, event_id % 2 = 0 AS historical, event_id AS ingest_seq FROM events)) WHERE rn = 1"""),
    "favorites": ((), "SELECT DISTINCT concat('f-', doc_id % 97, '-1') AS flow_id FROM labels WHERE quality = 1"),
    "pat": (("patterns",), "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC) AS rn FROM patterns) WHERE rn = 1"),
    "ignores": (("pat",), "SELECT id AS pattern_id, revision AS pattern_revision FROM pat WHERE enabled AND action = 'ignore'"),
    "turns": ((), "SELECT *, CAST(coalesce(sum(payload_len) OVER (PARTITION BY conv_id, direction ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stream_offset FROM (SELECT conv_id, turn, coalesce(text, '') AS text, CASE WHEN role = 'user' THEN 'a_to_b' ELSE 'b_to_a' END AS direction, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS payload_len FROM conversations)"),
    "content": (("turns",), """SELECT concat(kind, '-', conv_id, '-', turn) AS content_id, concat('f-', conv_id, '-1') AS flow_id, direction, CASE WHEN kind = 'r' THEN 'tcp_raw' WHEN direction = 'a_to_b' THEN 'http_request_body' ELSE 'http_response_body' END AS view, stream_offset, payload_len, text, turn * 1000 AS ts_ns, concat('seg-', conv_id % 5) AS segment_path, conv_id AS ingest_seq
      FROM turns CROSS JOIN (VALUES ('r'), ('h')) AS k(kind) WHERE kind = 'r' OR turn % 2 = 0"""),
    "whole": (("content",), "SELECT flow_id, direction, string_agg(text, '' ORDER BY stream_offset, content_id) AS text FROM content WHERE view = 'tcp_raw' GROUP BY flow_id, direction"),
    "hits": (("content",), "SELECT 'p1' AS pattern_id, CAST(1 AS BIGINT) AS pattern_revision, flow_id, content_id, stream_offset AS offset_start, stream_offset + 4 AS offset_end, false AS historical FROM content WHERE view = 'tcp_raw' AND payload_len >= 4 AND ingest_seq % 3 = 0"),
    "ranges": (("content",), """SELECT flow_id, direction, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY flow_id, direction ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT flow_id, direction, stream_offset AS s, stream_offset + payload_len AS e, CASE WHEN stream_offset <= max(stream_offset + payload_len) OVER (PARTITION BY flow_id, direction ORDER BY stream_offset, stream_offset + payload_len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
      FROM content WHERE view <> 'tcp_raw' AND payload_len > 0)) GROUP BY flow_id, direction, island"""),
    "hidden": (("content", "ranges"), "SELECT DISTINCT c.content_id FROM content AS c JOIN ranges AS r ON c.flow_id = r.flow_id AND c.direction = r.direction AND r.s <= c.stream_offset AND r.e >= c.stream_offset + c.payload_len WHERE c.view = 'tcp_raw' AND c.payload_len > 0"),
    "sources": (("packets",), "SELECT ip4, count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM packets GROUP BY ip4"),
    "ruled": (("packets", "force"), "SELECT p.*, (SELECT arg_max(rule_id, prefix) FROM force AS r WHERE p.ip4 >= r.net AND p.ip4 < r.net + (CAST(1 AS BIGINT) << (32 - r.prefix)) AND p.ts_ns >= r.created_ns AND p.ts_ns < r.until_ns) AS rule_id FROM packets AS p"),
}


def oracle(body: str, *needs: str) -> str:
    """body behind the common tables it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in PRELUDE[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({PRELUDE[n][1]})" for n in order) + " " + body if order else body


