"""Every query of the engine over the driver's tables, with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content as C
from ..operators import addresses, connections, facts, http1, matching, registry, sessions, topology
from ..operators import flows as FL
from ..operators.flows import TrafficFilter
from ..sources import files
from . import adapters as A
from . import traffic
from .adapters import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY = 86_400_000_000_000
#: A time inside the test events, for queries that ask "now" or "since".
NOW = 1_704_672_000_000_000_000


def query(name: str, sql: str | None = None, *needs: str):
    """Register a function under a name; sql and the tables it needs make its oracle."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql, *needs)
        return f

    return keep


# --- flow list -------------------------------------------------------------------------------------------------------------------

LIST = "flow_id, started_ns, ended_ns, src_ip, dst_ip, src_port, dst_port, protocol, service, packets_c2s, packets_s2c, bytes_c2s, bytes_s2c, truncated"
PAGE = "ORDER BY started_ns DESC, flow_id LIMIT"
HAS = "SELECT flow_id FROM http_messages WHERE "


def flow_query(name: str, f: TrafficFilter, where: str, *needs: str, ignore: bool = False):
    def run(s, d):
        ign = registry.active_ignores(A.patterns(s)) if ignore else None
        chosen = FL.select_flows(A.flows(s, d), f, A.http_messages(s, d), A.matches(s, d), A.favorites(s, d), ign)
        return FL.page(chosen, f)

    limit = f"{min(f.limit or 100, 500)} OFFSET {f.offset or 0}"
    query(name, f"SELECT {LIST} FROM flows WHERE {where} {PAGE} {limit}", "flows", *needs)(run)


flow_query("flow_list_by_service", TrafficFilter(service="web"), "service = 'web'")
flow_query("flow_list_by_port", TrafficFilter(port=8081, limit=300), "src_port = 8081 OR dst_port = 8081")
flow_query("flow_list_by_protocol", TrafficFilter(protocol="UDP", limit=600), "protocol = 'udp'")
flow_query("flow_list_by_endpoint", TrafficFilter(src_ip="10.1.1.1", dst_ip="192.168.0.10"), "src_ip = '10.1.1.1' AND dst_ip = '192.168.0.10'")
flow_query("flow_list_by_time_range", TrafficFilter(from_ns=NOW, to_ns=NOW + 3 * DAY, limit=200, offset=10), f"started_ns >= {NOW} AND started_ns <= {NOW + 3 * DAY}")
flow_query("flow_list_ignore", TrafficFilter(limit=500), "flow_id NOT IN (SELECT m.flow_id FROM matches AS m JOIN ignores AS i ON m.pattern_id = i.pattern_id AND m.pattern_revision = i.pattern_revision WHERE m.action = 'ignore')", "matches", "ignores", ignore=True)
flow_query("flow_list_pattern", TrafficFilter(pattern_id="p3"), "flow_id IN (SELECT flow_id FROM matches WHERE pattern_id = 'p3')", "matches")
flow_query("flow_list_ua_contains", TrafficFilter(user_agent="COURIER"), f"flow_id IN ({HAS} contains(lower(coalesce(user_agent, '')), 'courier'))", "http_messages")
flow_query("flow_list_ua_equals", TrafficFilter(user_agent_equals="FETCHER/0.9"), f"flow_id IN ({HAS} lower(coalesce(user_agent, '')) = 'fetcher/0.9')", "http_messages")
flow_query("flow_list_ua_not_contains", TrafficFilter(user_agent_not_contains="fetcher"), f"flow_id NOT IN ({HAS} contains(lower(coalesce(user_agent, '')), 'fetcher'))", "http_messages")
flow_query("flow_list_ua_regex", TrafficFilter(user_agent_regex="^courier/.*"), f"flow_id IN ({HAS} regexp_matches(coalesce(user_agent, ''), '^courier/.*'))", "http_messages")
flow_query("flow_list_favorite", TrafficFilter(favorite=True), "flow_id IN (SELECT flow_id FROM favorites)", "favorites")
flow_query("flow_list_not_favorite", TrafficFilter(favorite=False), "flow_id NOT IN (SELECT flow_id FROM favorites)", "favorites")


@query("flow_list_service_ua_contains", f"""SELECT p.*, fav.flow_id IS NOT NULL AS favorite, ua.user_agent, coalesce(pid.ids, '') AS pattern_ids FROM (
  SELECT {LIST} FROM flows WHERE service IN ('web', 'shop', 'auth') AND service = 'shop' AND flow_id IN ({HAS} contains(lower(coalesce(user_agent, '')), 'courier')) {PAGE} 100) AS p
  LEFT JOIN favorites AS fav USING (flow_id)
  LEFT JOIN (SELECT flow_id, arg_max(user_agent, (ts_ns, id)) AS user_agent FROM http_messages WHERE user_agent <> '' GROUP BY flow_id) AS ua USING (flow_id)
  LEFT JOIN (SELECT flow_id, string_agg(DISTINCT pattern_id, ',' ORDER BY pattern_id) AS ids FROM matches WHERE action = 'find' GROUP BY flow_id) AS pid USING (flow_id)""", "flows", "http_messages", "matches", "favorites")
def flow_list_service_ua_contains(s, d):
    f = TrafficFilter(service="shop", user_agent="courier")
    http, hits, fav = A.http_messages(s, d), A.matches(s, d), A.favorites(s, d)
    rows = FL.enrich(FL.page(FL.select_flows(A.flows(s, d), f, http, hits, fav), f), fav, http, hits)
    return rows.withColumn("pattern_ids", F.array_join("pattern_ids", ","))


# --- facts -----------------------------------------------------------------------------------------------------------------------

query("latest_per_key_flows", f"SELECT {LIST}, ingest_seq FROM flows", "flows")(lambda s, d: A.flows(s, d).select(*[c.strip() for c in LIST.split(",")], "ingest_seq"))
query("latest_per_key_matches", "SELECT * FROM matches", "matches")(A.matches)
query("pattern_ids_per_flow", "SELECT flow_id, string_agg(DISTINCT pattern_id, ',' ORDER BY pattern_id) AS pattern_ids FROM matches WHERE action = 'find' GROUP BY flow_id", "matches")(lambda s, d: facts.pattern_ids(A.matches(s, d)).withColumn("pattern_ids", F.array_join("pattern_ids", ",")))
query("latest_user_agent_per_flow", "SELECT flow_id, arg_max(user_agent, (ts_ns, id)) AS user_agent FROM http_messages WHERE user_agent <> '' GROUP BY flow_id", "http_messages")(lambda s, d: facts.latest_user_agent(A.http_messages(s, d)))
query("sessions_per_minute", f"SELECT service, count(*) AS spm FROM flows WHERE ended_ns >= {NOW} - 60000000000 AND coalesce(service, '') <> '' GROUP BY service", "flows")(lambda s, d: facts.sessions_per_minute(A.flows(s, d), F.lit(NOW)))
query("flow_by_id", f"SELECT {LIST} FROM flows WHERE flow_id = 'f-7-1'", "flows")(lambda s, d: facts.flow_by_id(A.flows(s, d), "f-7-1").select(*[c.strip() for c in LIST.split(",")]))
query("http_for_flow", "SELECT * FROM http_messages WHERE flow_id = 'f-7-1'", "http_messages")(lambda s, d: facts.of_flow(A.http_messages(s, d), "f-7-1", "ts_ns", "id"))
query("matches_for_flow", "SELECT * FROM matches WHERE flow_id = 'f-7-1'", "matches")(lambda s, d: facts.of_flow(A.matches(s, d), "f-7-1", "ts_ns", "content_id"))
INDEX = ("content_id", "flow_id", "direction", "view", "stream_offset", "payload_len", "ts_ns", "segment_path")
query("content_by_id", f"SELECT {', '.join(INDEX)} FROM content WHERE content_id = 'r-3-0'", "content")(lambda s, d: A.content(s, d).where("content_id = 'r-3-0'").select(*INDEX))
query("content_for_flow", f"SELECT {', '.join(INDEX)} FROM content WHERE flow_id = 'f-3-1' ORDER BY ts_ns, stream_offset, content_id LIMIT 2000", "content")(lambda s, d: facts.content_of_flow(A.content(s, d), "f-3-1").select(*INDEX))
PARTS = "SELECT segment_path AS \"table\", count(*) AS rows, CAST(sum(payload_len) AS BIGINT) AS bytes FROM content GROUP BY segment_path, view"


def parts(s, d):
    return A.content(s, d).groupBy(F.col("segment_path").alias("table"), "view").agg(F.count("*").alias("rows"), F.sum("payload_len").alias("bytes"))


query("storage_stats", f"SELECT \"table\", CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS parts FROM ({PARTS}) GROUP BY ROLLUP (\"table\")", "content")(lambda s, d: facts.storage_stats(parts(s, d)))
query("retention_survivors", f"SELECT flow_id, ended_ns FROM flows WHERE ended_ns >= {NOW}", "flows")(lambda s, d: facts.cleanup({"flows": A.flows(s, d)}, NOW, "DELETE")["flows"].select("flow_id", "ended_ns"))
query("retention_file_candidates", "SELECT flow_id AS segment_path, max(ts_ns) AS newest_ns, count(*) AS records FROM content GROUP BY flow_id HAVING max(ts_ns) < 6000", "content")(lambda s, d: facts.wholly_old(A.content(s, d).withColumn("segment_path", F.col("flow_id")), 6000))
query("content_index_rebuild", f"SELECT DISTINCT {', '.join(INDEX)} FROM content", "content")(lambda s, d: files.rebuild_index(A.content(s, d)).select(*INDEX))


@query("flow_detail", "SELECT f.flow_id, f.started_ns, (SELECT count(*) FROM http_messages AS h WHERE h.flow_id = f.flow_id) AS n_http, (SELECT count(*) FROM matches AS m WHERE m.flow_id = f.flow_id) AS n_matches, f.flow_id IN (SELECT flow_id FROM favorites) AS favorite FROM flows AS f WHERE flow_id = 'f-7-1'", "flows", "http_messages", "matches", "favorites")
def flow_detail(s, d):
    row = FL.flow_detail(A.flows(s, d), A.http_messages(s, d), A.matches(s, d), A.favorites(s, d), "f-7-1")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return row.select("flow_id", "started_ns", size("http").alias("n_http"), size("matches").alias("n_matches"), "favorite")


# --- small tables ----------------------------------------------------------------------------------------------------------------

query("patterns_latest", "SELECT id, revision, expression, enabled FROM pat", "pat")(lambda s, d: registry.latest_patterns(A.patterns(s)).select("id", "revision", "expression", "enabled"))
query("patterns_enabled", "SELECT id, revision FROM pat WHERE enabled", "pat")(lambda s, d: registry.enabled_patterns(A.patterns(s)).select("id", "revision"))
query("pattern_next_revision", "SELECT coalesce(max(revision), 0) + 1 AS revision FROM patterns WHERE id = 'p1'", "patterns")(lambda s, d: registry.next_revision(A.patterns(s), "p1"))
query("pattern_tombstone", "SELECT id, revision, enabled FROM patterns UNION ALL SELECT id, revision + 1, false FROM pat WHERE id = 'p2'", "patterns", "pat")(lambda s, d: registry.with_enabled(A.patterns(s), "p2", False).select("id", "revision", "enabled"))
query("pattern_revision_lookup", "SELECT id, revision, expression FROM patterns WHERE id = 'p1' AND revision = 1", "patterns")(lambda s, d: registry.pattern_revision(A.patterns(s), "p1", 1).select("id", "revision", "expression"))
query("services_list", "SELECT * FROM services WHERE enabled", "services")(lambda s, d: registry.list_services(A.services(s)))
NEW = ((8081, "store", True, False), (9000, "new", True, True))
query("service_upsert", "SELECT * FROM services WHERE port NOT IN (8081, 9000) UNION ALL " + A._values(NEW, "port, name, enabled, http"), "services")(lambda s, d: registry.upsert_services(A.services(s), A.literal(s, NEW, "port int, name string, enabled boolean, http boolean")))
query("favorites_set", "SELECT flow_id FROM favorites WHERE flow_id <> 'f-3-1' UNION SELECT 'f-new'", "favorites")(lambda s, d: registry.set_favorites(A.favorites(s, d), A.literal(s, (("f-new",), ("f-new",)), "flow_id string"), A.literal(s, (("f-3-1",),), "flow_id string")))
JOBS = (("j1", "completed", 1, "seg-0,seg-1"), ("j2", "running", 2, "seg-0,seg-1,seg-2"), ("j3", "queued", 2, "seg-4"))


def jobs(s):
    return A.literal(s, JOBS, "id string, status string, created_at long, paths string").withColumn("segment_paths", F.split("paths", ",")).drop("paths")


query("replay_job_list", A._values(JOBS, "id, status, created_at, paths").replace("SELECT *", "SELECT id, status, created_at") + " ORDER BY created_at DESC, id LIMIT 100")(lambda s, d: registry.list_jobs(jobs(s)).select("id", "status", "created_at"))
query("replay_resume_remaining", "SELECT * FROM (VALUES ('j2', 'seg-1'), ('j2', 'seg-2'), ('j3', 'seg-4')) AS t(id, path)")(lambda s, d: registry.remaining_segments(jobs(s), A.literal(s, (("j2", "seg-0"), ("j1", "seg-1")), "id string, path string")))

# --- content ---------------------------------------------------------------------------------------------------------------------

query("semantic_ranges_merged", "SELECT * FROM ranges", "ranges")(lambda s, d: C.merged_ranges(A.content(s, d)))
query("raw_suppressed", "SELECT * FROM hidden", "hidden")(lambda s, d: C.hidden_raw(A.content(s, d)).select("content_id").distinct())
query("content_visible", "SELECT content_id, view FROM content WHERE content_id NOT IN (SELECT content_id FROM hidden)", "content", "hidden")(lambda s, d: C.visible(A.content(s, d)).select("content_id", "view"))
query("matches_projected", """SELECT content_id AS target_id, pattern_id, pattern_revision, offset_start, offset_end, historical FROM hits WHERE content_id NOT IN (SELECT content_id FROM hidden)
  UNION SELECT t.content_id, h.pattern_id, h.pattern_revision, h.offset_start, h.offset_end, h.historical FROM hits AS h JOIN hidden USING (content_id) JOIN content AS r ON r.content_id = h.content_id
  JOIN content AS t ON t.flow_id = r.flow_id AND t.direction = r.direction AND t.view <> 'tcp_raw' AND h.offset_start < t.stream_offset + t.payload_len AND h.offset_end > t.stream_offset""", "content", "hidden", "hits")(lambda s, d: C.projected_hits(A.content(s, d), A.content_hits(s, d)))
query("content_presentation", "SELECT c.content_id, CASE WHEN c.view = 'http_request_body' THEN true WHEN c.view = 'http_response_body' THEN false ELSE c.direction = CASE WHEN f.initiator_a THEN 'a_to_b' WHEN NOT f.initiator_a THEN 'b_to_a' END END AS request, c.text AS preview FROM content AS c LEFT JOIN flows AS f USING (flow_id) WHERE c.payload_len <= 4096", "content", "flows")(lambda s, d: C.presentation(A.content(s, d), A.flows(s, d)))
query("content_format_base64", "SELECT content_id, base64(encode(text)) AS body FROM content", "content")(lambda s, d: C.formatted(A.content(s, d)))
query("content_format_hex", "SELECT content_id, lower(hex(encode(text))) AS body FROM content", "content")(lambda s, d: C.formatted(A.content(s, d), "hex"))
query("content_format_text", "SELECT content_id, text AS body FROM content", "content")(lambda s, d: C.formatted(A.content(s, d), "text"))
query("content_hexdump", "SELECT content_id, \"offset\", rtrim(regexp_replace(lower(hex(encode(text)))[\"offset\" * 2 + 1 : \"offset\" * 2 + 32], '(..)', '\\1 ', 'g')) AS hex FROM (SELECT content_id, text, unnest(range(0, greatest(payload_len, 1), 16)) AS \"offset\" FROM content)", "content")(lambda s, d: C.hexdump(A.content(s, d)).select("content_id", "offset", "hex"))
query("content_highlight", "SELECT DISTINCT h.content_id, h.offset_start - c.stream_offset AS start, h.offset_end - c.stream_offset AS \"end\" FROM hits AS h JOIN content AS c USING (content_id)", "hits", "content")(lambda s, d: C.highlight(A.content(s, d), A.content_hits(s, d).withColumnRenamed("content_id", "target_id")))
query("http_pairing", """SELECT q.flow_id, q.id AS request_id, r.id AS response_id FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY ts_ns, id) AS n FROM http_messages WHERE request) AS q
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY ts_ns, id) AS n FROM http_messages WHERE NOT request AND (status >= 200 OR status = 101)) AS r ON q.flow_id = r.flow_id AND q.n = r.n""", "http_messages")(lambda s, d: http1.paired(A.http_messages(s, d)))


@query("http_header_fields", "SELECT id, host, nullif(user_agent, '') AS user_agent FROM http_messages WHERE request", "http_messages")
def http_header_fields(s, d):
    head = F.concat(F.lit("GET "), "path", F.lit(" HTTP/1.1\r\nHost: "), "host", F.lit("\r\nUser-Agent: "), F.coalesce("user_agent", F.lit("")), F.lit("\r\n\r\n"))
    m = A.http_messages(s, d).where("request").select("id", head.alias("head"))
    return m.select("id", http1.header_fields("head", "host").alias("host"), http1.header_fields("head", "user-agent").alias("user_agent"))


# --- topology and rules ----------------------------------------------------------------------------------------------------------

RATE = f"SELECT ip4, packets, bytes, first_ns, last_ns, coalesce(rp, 0) / greatest(1, least(3600, {NOW} // 1000000000 - first_ns // 1000000000 + 1)) AS pps, coalesce(rb, 0) / greatest(1, least(3600, {NOW} // 1000000000 - first_ns // 1000000000 + 1)) AS bps FROM sources LEFT JOIN (SELECT ip4, count(*) AS rp, CAST(sum(wire_len) AS BIGINT) AS rb FROM packets WHERE ts_ns // 1000000000 > {NOW} // 1000000000 - 3600 GROUP BY ip4) USING (ip4)"
DOT = lambda c: f"concat({c} // 16777216, '.', {c} // 65536 % 256, '.', {c} // 256 % 256, '.', {c} % 256)"
NET = f"concat({DOT('(ip4 - ip4 % 256)')}, '/24')"
query("topology_source_totals", "SELECT * FROM sources", "sources")(lambda s, d: topology.source_totals(A.packets(s, d)))
query("topology_rate", RATE, "sources", "packets")(lambda s, d: topology.rates(A.packets(s, d), NOW, 3600))
query("topology_groups", f"SELECT {NET} AS cidr, count(*) AS sources, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM sources GROUP BY 1", "sources")(lambda s, d: topology.groups(topology.rates(A.packets(s, d), NOW)).select("cidr", "sources", "packets", "bytes"))
query("topology_topk", f"""SELECT group_rank, cidr, source_rank, source, packets, bytes FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cidr ORDER BY bytes DESC, ip4) AS INTEGER) AS source_rank FROM
  (SELECT {NET} AS cidr, ip4, {DOT('ip4')} AS source, packets, bytes FROM sources) JOIN (SELECT cidr, group_rank, coalesce(sum(n) OVER (ORDER BY group_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM
  (SELECT {NET} AS cidr, count(*) AS n, CAST(row_number() OVER (ORDER BY sum(bytes) DESC, {NET}) AS INTEGER) AS group_rank FROM sources GROUP BY 1) WHERE group_rank <= 10) USING (cidr)) WHERE before + source_rank <= 15""", "sources")(lambda s, d: topology.top(topology.source_totals(A.packets(s, d)).withColumn("pps", F.col("packets")).withColumn("bps", F.col("bytes")), most_groups=10, most_rows=15).drop("bps"))
query("topology_overflow", "SELECT CASE WHEN rn <= 20 THEN ip4 END AS ip4, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS sources FROM (SELECT *, row_number() OVER (ORDER BY first_at, ip4) AS rn FROM (SELECT ip4, min((ts_ns, frame_no)) AS first_at, count(*) AS packets, sum(wire_len) AS bytes FROM packets GROUP BY ip4)) GROUP BY 1", "packets")(lambda s, d: topology.capped(A.packets(s, d), 20))
query("topology_grand_total", "SELECT count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes, count(DISTINCT ip4) AS sources FROM packets", "packets")(lambda s, d: topology.grand_total(A.packets(s, d)))
query("topology_ttl", f"SELECT ip4, last_ns FROM sources WHERE last_ns >= {NOW} - 300000000000", "sources")(lambda s, d: topology.alive(topology.source_totals(A.packets(s, d)), NOW).select("ip4", "last_ns"))
query("topology_nested", f"SELECT {NET} AS cidr, count(*) AS n FROM sources GROUP BY 1", "sources")(lambda s, d: topology.nested(topology.top(topology.rates(A.packets(s, d), NOW))).select("cidr", F.size("sources").cast("bigint").alias("n")))
query("rule_longest_prefix", "SELECT frame_no, rule_id FROM ruled", "ruled")(lambda s, d: topology.longest_prefix(A.packets(s, d), A.rules(s)).select("frame_no", "rule_id"))
DROPPED = "CAST('0x' || substr(md5(CAST(frame_no AS VARCHAR)), 1, 8) AS BIGINT) * 100 < r.drop_percent * CAST(4294967296 AS BIGINT)"
query("rule_counters", f"SELECT rule_id, count(*) AS seen_packets, CAST(sum(wire_len) AS BIGINT) AS seen_bytes, count(*) FILTER (WHERE dropped) AS dropped_packets, CAST(sum(CASE WHEN dropped THEN wire_len ELSE 0 END) AS BIGINT) AS dropped_bytes FROM (SELECT p.*, {DROPPED} AS dropped FROM ruled AS p JOIN rules AS r USING (rule_id) WHERE r.drop_percent > 0) GROUP BY rule_id", "ruled", "rules")(lambda s, d: topology.rule_counters(A.packets(s, d), A.rules(s)))
query("rule_active_at", f"SELECT rule_id FROM force WHERE created_ns <= {NOW} AND until_ns > {NOW}", "force")(lambda s, d: topology.active_rules(A.rules(s), NOW).select("rule_id"))
LATER = NOW + 30 * DAY
query("rule_audit", f"SELECT * FROM (SELECT rule_id, 'set' AS event, created_ns AS at_ns FROM force UNION ALL SELECT rule_id, 'expire', expires_ns FROM force WHERE until_ns = expires_ns UNION ALL SELECT rule_id, 'clear', cleared_ns FROM force WHERE until_ns = cleared_ns) WHERE at_ns <= {LATER} ORDER BY at_ns DESC, rule_id DESC, event LIMIT 32", "force")(lambda s, d: topology.audit(A.rules(s), LATER))
query("rule_rate", "SELECT frame_no, CASE WHEN dt > 0 THEN greatest(0, dv / dt) END AS rate FROM (SELECT frame_no, (ts_ns - lag(ts_ns) OVER w) / 1000000000.0 AS dt, CAST(wire_len - lag(wire_len) OVER w AS DOUBLE) AS dv FROM packets WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, frame_no))".replace("1000000000.0", "CAST(1000000000 AS DOUBLE)"), "packets")(lambda s, d: topology.counter_rate(A.packets(s, d), ["user_id"], "wire_len").select("frame_no", "rate"))
query("rule_targets_valid", "SELECT * FROM (VALUES ('10.1.1.1/32'), ('10.2.3.0/24')) AS t(target)")(lambda s, d: A.literal(s, tuple((addresses.parse_target(t),) for t in ("10.1.1.1", "10.2.3.9/24")), "target string"))
QUEUES = (("capture", 100, 32768), ("l7", 9000, 16384), ("match", 10, 16384))
query("live_pressure", "SELECT CAST(max(depth * 100 // capacity) AS BIGINT) AS live_pressure_pct FROM (" + A._values(QUEUES, "queue, depth, capacity") + ")")(lambda s, d: topology.pressure(A.literal(s, QUEUES, "queue string, depth long, capacity long")))
query("load_severity", "SELECT frame_no, CASE WHEN payload_len >= 90 THEN 'danger' WHEN payload_len >= 70 THEN 'warn' ELSE 'ok' END AS level FROM packets", "packets")(lambda s, d: A.packets(s, d).select("frame_no", topology.severity(F.col("payload_len"), 70, 90).alias("level")))
query("metrics_exposition", "SELECT * FROM (VALUES ('# TYPE riverbed_frames counter'), ('riverbed_frames 7'), ('# TYPE riverbed_queue gauge'), ('riverbed_queue 3')) AS t(line)")(lambda s, d: files.prometheus(A.literal(s, (("frames", "counter", 7), ("queue", "gauge", 3)), "name string, kind string, value long")))

# --- packets and sessions --------------------------------------------------------------------------------------------------------

query("packets_service_scope", "SELECT frame_no, dst_port IN (SELECT port FROM services WHERE enabled) AS to_service, dst_port IN (SELECT port FROM services WHERE enabled) OR src_port IN (SELECT port FROM services WHERE enabled) AS of_flow FROM packets", "packets", "services")(lambda s, d: sessions.service_scope(A.packets(s, d), A.services(s)).select("frame_no", "to_service", "of_flow"))
query("packets_flow_admission", "SELECT frame_no FROM packets WHERE dst_port IN (SELECT port FROM services WHERE enabled)", "packets", "services")(lambda s, d: sessions.visible(A.packets(s, d), A.services(s)).select("frame_no"))
query("packets_visible_offline", "SELECT frame_no FROM packets WHERE dst_port IN (SELECT port FROM services WHERE enabled) OR src_port IN (SELECT port FROM services WHERE enabled)", "packets", "services")(lambda s, d: sessions.visible(A.packets(s, d), A.services(s), offline=True).select("frame_no"))
query("local_egress_filter", "SELECT frame_no FROM packets WHERE frame_no % 5 <> 0", "packets")(lambda s, d: sessions.without_local_egress(A.packets(s, d).withColumn("eth_src", F.when(F.col("frame_no") % 5 == 0, "02:00").otherwise("02:01")), F.lit("02:00")).select("frame_no"))
query("flow_key_canonical", "SELECT frame_no, CASE WHEN src_ip = '192.168.0.10' THEN dst_ip ELSE src_ip END AS a_ip, '192.168.0.10' AS b_ip, CASE WHEN src_ip = '192.168.0.10' THEN 'b_to_a' ELSE 'a_to_b' END AS direction FROM packets", "packets")(lambda s, d: sessions.with_flow_key(A.packets(s, d)).select("frame_no", "a_ip", "b_ip", "direction"))
query("flow_sessions_idle", "SELECT frame_no, session FROM sess", "sess")(lambda s, d: sessions.idle_sessions(A.packets(s, d), ["user_id", "protocol"], A.IDLE_NS).select("frame_no", "session"))
query("flow_counters", "SELECT flow_id, packets_c2s, packets_s2c, bytes_c2s, bytes_s2c FROM flows", "flows")(lambda s, d: A.flows(s, d).select("flow_id", "packets_c2s", "packets_s2c", "bytes_c2s", "bytes_s2c"))
query("flow_summary_initiator", "SELECT flow_id, initiator_a, src_ip FROM flows", "flows")(lambda s, d: A.flows(s, d).select("flow_id", "initiator_a", "src_ip"))
query("udp_stream_offsets", "SELECT frame_no, CAST(coalesce(sum(payload_len) OVER (PARTITION BY user_id, a_to_b ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stream_offset FROM packets WHERE protocol = 'udp'", "packets")(lambda s, d: sessions.stream_offsets(A.packets(s, d).where("protocol = 'udp'"), ["user_id", "a_to_b"], F.col("payload_len"), ["frame_no"]).select("frame_no", "stream_offset"))
query("service_attribution", "SELECT frame_no, coalesce(a.name, b.name) AS service FROM packets LEFT JOIN services AS a ON a.enabled AND a.port = dst_port LEFT JOIN services AS b ON b.enabled AND b.port = src_port", "packets", "services")(lambda s, d: sessions.attribute(A.packets(s, d), A.services(s)).select("frame_no", "service"))
query("http_service_names", "SELECT frame_no, s.name AS http_service FROM packets LEFT JOIN services AS s ON s.enabled AND s.http AND s.port = dst_port", "packets", "services")(lambda s, d: sessions.http_service(A.packets(s, d), A.services(s)).select("frame_no", "http_service"))



@query("flow_generations", """SELECT frame_no, CAST(sum(CASE WHEN bare AND seq IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS generation FROM (
  SELECT *, last_value(CASE WHEN bare THEN seq END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
  SELECT frame_no, user_id, frame_no % 3 = 0 AS bare, frame_no // 7 % 2 AS seq FROM packets))""", "packets")
def flow_generations(s, d):
    p = A.packets(s, d).withColumn("flags", F.struct((F.col("frame_no") % 3 != 1).alias("syn"), (F.col("frame_no") % 3 == 2).alias("ack"))).withColumn("seq", F.floor(F.col("frame_no") / 7) % 2)
    return sessions.generations(p, ["user_id"]).select("frame_no", "generation")


# --- matching --------------------------------------------------------------------------------------------------------------------

query("pattern_view_expansion", "SELECT id, scan_view FROM pat JOIN (VALUES ('both', 'tcp_raw'), ('both', 'http_request_decoded_body'), ('both', 'http_response_decoded_body'), ('input', 'http_request_headers'), ('input', 'http_request_body'), ('input', 'http_request_decoded_body'), ('output', 'http_response_headers'), ('output', 'http_response_body'), ('output', 'http_response_decoded_body')) AS v(direction_type, scan_view) USING (direction_type) WHERE enabled AND view IS NULL UNION SELECT id, view FROM pat WHERE enabled AND direction_type = 'both' AND view IS NOT NULL", "pat")(lambda s, d: matching.expanded(registry.latest_patterns(A.patterns(s))).select("id", "scan_view"))
query("view_interest_filter", "SELECT content_id FROM content WHERE view = 'tcp_raw' OR view = 'http_response_body'", "content")(lambda s, d: matching.interesting(A.content(s, d), registry.latest_patterns(A.patterns(s)).where("service is null and id <> 'p7'")).select("content_id"))
DOCS = "(SELECT CAST(doc_id AS VARCHAR) AS content_id, coalesce(text, '') AS text FROM documents)"


def docs(s, d):
    return A.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("content_id"), F.coalesce("text", F.lit("")).alias("text"))


query("scan_text_literal", "SELECT content_id, offset_start, offset_start + 3 AS offset_end FROM (SELECT content_id, CAST(stream_offset + list_sum(list_transform(p[1:i], lambda x: octet_length(encode(x)))) + (i - 1) * 3 AS BIGINT) AS offset_start FROM (SELECT content_id, stream_offset, string_split(text, 'and') AS p, unnest(range(1, len(string_split(text, 'and')))) AS i FROM content WHERE view = 'tcp_raw' AND contains(text, 'and')))", "content")(lambda s, d: matching.literal_hits(A.content(s, d), A.literal(s, (("p1", "and", "tcp_raw"),), "id string, expression string, scan_view string")).select("content_id", "offset_start", "offset_end"))
query("scan_literal_counts", f"SELECT content_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS hits FROM {DOCS} WHERE contains(text, 'the')")(lambda s, d: matching.literal_counts(docs(s, d), "the"))
query("scan_binary_literal", f"SELECT content_id, CAST((length(text) - length(replace(text, 'on', ''))) // 2 AS BIGINT) AS hits FROM {DOCS} WHERE contains(text, 'on')")(lambda s, d: matching.literal_counts(docs(s, d), matching.binary_literal("6f:6e").decode()))
query("scan_regex", f"SELECT content_id, len(regexp_extract_all(text, '[0-9]+')) AS hits FROM {DOCS} WHERE regexp_matches(text, '[0-9]+')")(lambda s, d: matching.regex_counts(docs(s, d), "[0-9]+"))
query("scan_boundary_bridge", """SELECT content_id, stream_offset - 1 AS offset_start FROM (SELECT *, lag(text) OVER w AS before, lag(stream_offset + payload_len) OVER w AS ended FROM content WHERE view = 'tcp_raw' WINDOW w AS (PARTITION BY flow_id, direction, view ORDER BY stream_offset, content_id))
  WHERE ended = stream_offset AND right(before, 1) = '.' AND left(text, 1) = 'T'""", "content")(lambda s, d: matching.bridged(A.content(s, d).where("view = 'tcp_raw'"), ".T"))
query("scan_hit_limits", "SELECT content_id, least(hits, 3) AS hits FROM (SELECT content_id, CAST((length(text) - length(replace(text, 'er', ''))) // 2 AS BIGINT) AS hits FROM content WHERE view = 'tcp_raw') WHERE hits > 0", "content")(lambda s, d: _limited(s, d))


def _limited(s, d):
    """Each record is a stream of its own here, so no hit crosses a boundary."""
    alone = A.content(s, d).where("view = 'tcp_raw'").withColumn("flow_id", F.col("content_id"))
    one = [{"id": "x", "revision": 1, "expression": "er", "kind": "text", "action": "find", "direction_type": "both", "view": "tcp_raw", "service": None}]
    return matching.scan(alone, one, matching.Limits(pattern=3)).groupBy("content_id").agg(F.count("*").alias("hits"))


def rule_dicts() -> list[dict]:
    names = ("id", "revision", "expression", "kind", "action", "direction_type", "service", "view", "enabled")
    latest: dict[str, dict] = {}
    for row in A.PATTERNS:
        p = dict(zip(names, row, strict=True))
        if p["revision"] >= latest.get(p["id"], p)["revision"]:
            latest[p["id"]] = p
    return [p for p in latest.values() if p["enabled"]]


APART = ("the", "and", "of")
_rule = lambda k, e, **more: {"id": f"a{k}", "revision": 1, "expression": e, "kind": "text", "action": "find", "direction_type": "both", "service": None, "view": None} | more
COUNTED = " UNION ALL ".join(f"SELECT 'a{k}' AS pattern_id, flow_id, direction, CAST((length(text) - length(replace(text, '{e}', ''))) // {len(e)} AS BIGINT) AS hits FROM whole WHERE contains(text, '{e}')" for k, e in enumerate(APART))


def _by_stream(s, d, found):
    way = A.content(s, d).select("content_id", "direction")
    return found.join(way, "content_id").groupBy("pattern_id", "flow_id", "direction").agg(F.count("*").alias("hits"))


@query("scan_automaton", COUNTED, "whole")
def scan_automaton(s, d):
    """Literals that cannot overlap, over whole streams: records and the places between them give every hit once."""
    return _by_stream(s, d, matching.scan(A.content(s, d), [_rule(k, e) for k, e in enumerate(APART)], matching.Limits(1 << 30, 1 << 30)))


@query("scan_regex_stream", "SELECT 'r' AS pattern_id, flow_id, direction, CAST(len(regexp_extract_all(text, 'w[a-z]t')) AS BIGINT) AS hits FROM whole WHERE regexp_matches(text, 'w[a-z]t')", "whole")
def scan_regex_stream(s, d):
    rule = _rule("", "w[a-z]t", id="r", kind="regex")
    return _by_stream(s, d, matching.scan(A.content(s, d), [rule, rule | {"id": "none", "expression": "#{9}"}], matching.Limits(1 << 30, 1 << 30)))


@query("scan_groups", "SELECT content_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS hits FROM content WHERE view = 'http_request_body' AND ingest_seq % 2 = 0 AND contains(text, 'the')", "content")
def scan_groups(s, d):
    """A rule of one service and one view: records of other services and views are not looked at."""
    rule = _rule("", "the", id="g", direction_type="input", service="web", view="http_request_body")
    rows = A.content(s, d).withColumn("service", F.when(F.col("ingest_seq") % 2 == 0, "web").otherwise("shop")).withColumn("flow_id", F.col("content_id"))
    return matching.scan(rows, [rule], matching.Limits(1 << 30, 1 << 30)).groupBy("content_id").agg(F.count("*").alias("hits"))


@query("scan_carried_on", COUNTED, "whole")
def scan_carried_on(s, d):
    """The same hits in two goes: the tails of the first are where the second begins."""
    rules, limits, rows = [_rule(k, e) for k, e in enumerate(APART)], matching.Limits(1 << 30, 1 << 30), A.content(s, d)
    first = matching.carried(rows.where("ts_ns < 3000"), rules, None, limits)
    second = matching.carried(rows.where("ts_ns >= 3000"), rules, matching.tails_of(first), limits)
    return _by_stream(s, d, matching.hits_of(first).unionByName(matching.hits_of(second)))
query("replay_historical_matches", "SELECT content_id, CAST((length(text) - length(replace(text, 'of', ''))) // 2 AS BIGINT) AS hits FROM content WHERE view = 'http_request_body' AND ingest_seq <= 40 AND segment_path <> 'seg-1' AND contains(text, 'of')", "content")(lambda s, d: matching.replay(A.content(s, d).withColumn("flow_id", F.col("content_id")), [p for p in rule_dicts() if p["id"] == "p7"], 40, A.literal(s, (("seg-1",),), "segment_path string")).groupBy("content_id").agg(F.count("*").alias("hits")))


REPORT = "SELECT store, \"table\", CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS parts FROM (SELECT 'index' AS store, segment_path AS \"table\", count(*) AS rows, sum(payload_len) AS bytes FROM content GROUP BY segment_path, view UNION ALL SELECT 'facts', 'flows', count(*), sum(bytes_c2s) FROM flows) GROUP BY ROLLUP (store, \"table\")"


@query("storage_report", REPORT, "content", "flows")
def storage_report(s, d):
    flows = A.flows(s, d).agg(F.count("*").alias("rows"), F.sum("bytes_c2s").alias("bytes")).withColumn("table", F.lit("flows"))
    return facts.storage_report({"index": parts(s, d), "facts": flows})


# --- replay and rules as they change ---------------------------------------------------------------------------------------------

MOVED = (("j1", "running", 1), ("j2", "completed", 2), ("j3", "completed", 3), ("j3", "running", 4), ("j3", "failed", 5), ("j3", "queued", 6))
query("replay_job_progress", "SELECT * FROM (VALUES ('j1', 'completed'), ('j2', 'completed'), ('j3', 'queued')) AS t(id, status)")(lambda s, d: registry.progress(jobs(s), A.literal(s, MOVED, "id string, status string, at_ns long")).select("id", "status"))
query("replay_jobs_resumed", "SELECT * FROM (VALUES ('j1', 'completed'), ('j2', 'queued'), ('j3', 'failed')) AS t(id, status)")(lambda s, d: registry.resumed(jobs(s), A.literal(s, (("j2", "seg-0"),), "id string, path string"), A.content(s, d).select(F.col("segment_path").alias("path")).where("path <> 'seg-4'").distinct()).select("id", "status"))


@query("replay_checkpoints", "SELECT 'j' AS id, segment_path AS path, CAST(sum((length(text) - length(replace(text, 'of', ''))) // 2) AS BIGINT) AS hits FROM content WHERE view = 'http_request_body' GROUP BY segment_path", "content")
def replay_checkpoints(s, d):
    rows = A.content(s, d).withColumn("flow_id", F.col("content_id")).where("view = 'http_request_body'")
    rule = _rule("", "of", id="p7", direction_type="input", view="http_request_body")
    at = rows.select("content_id", F.lit("j").alias("id"), F.col("segment_path").alias("path"))
    return registry.checkpoints(matching.scan(rows, [rule], matching.Limits(1 << 30, 1 << 30), True).join(at, "content_id"), at)


@query("replay_lookback_job", "SELECT id AS pattern_id, revision AS pattern_revision, string_agg(DISTINCT segment_path, ',' ORDER BY segment_path) AS paths FROM pat, (SELECT segment_path FROM content GROUP BY segment_path HAVING max(ts_ns) >= 2000) WHERE id = 'p2' GROUP BY id, revision", "pat", "content")
def replay_lookback_job(s, d):
    files_ = A.content(s, d).groupBy(F.col("segment_path").alias("path")).agg(F.max("ts_ns").alias("newest_ns"))
    return registry.lookback_job(A.patterns(s), "p2", files_, 2000, NOW).select("pattern_id", "pattern_revision", F.array_join("segment_paths", ",").alias("paths"))


NEW_RULE = {"id": "p1", "expression": "or", "kind": "text", "action": "find", "direction_type": "both", "service": None, "view": None, "enabled": True}
query("pattern_create", "SELECT id, revision, expression FROM patterns UNION ALL SELECT 'p1', max(revision) + 1, 'or' FROM patterns WHERE id = 'p1'", "patterns")(lambda s, d: registry.with_pattern(A.patterns(s), NEW_RULE).select("id", "revision", "expression"))
SAMPLED = "SELECT user_id, ts_ns, frame_no, count(*) OVER w AS flows_opened, count(*) FILTER (WHERE frame_no % 3 = 0) OVER w AS flows_closed, CAST(sum(wire_len) OVER w AS BIGINT) AS packets FROM packets WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, frame_no ROWS UNBOUNDED PRECEDING)"


@query("stream_rates", f"SELECT frame_no, CASE WHEN ms > 0 THEN greatest(CAST(0 AS DOUBLE), CAST(grown * 60000 AS DOUBLE) / ms) END AS streams_per_minute, CASE WHEN flows_closed > 0 THEN CAST(packets AS DOUBLE) / flows_closed END AS packets_per_flow FROM (SELECT *, CAST(ts_ns - lag(ts_ns) OVER w AS DOUBLE) / 1000000 AS ms, flows_opened - lag(flows_opened) OVER w AS grown FROM ({SAMPLED}) WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, frame_no))", "packets")
def stream_rates(s, d):
    w = A.Window.partitionBy("user_id").orderBy("ts_ns", "frame_no").rowsBetween(A.Window.unboundedPreceding, 0)
    p = A.packets(s, d)
    samples = p.select("user_id", "ts_ns", "frame_no", F.count("*").over(w).alias("flows_opened"), F.count_if(F.col("frame_no") % 3 == 0).over(w).alias("flows_closed"), F.sum("wire_len").over(w).alias("packets"))
    return topology.stream_rates(samples, keys=["user_id"]).select("frame_no", "streams_per_minute", "packets_per_flow")


query("flow_cap_per_prefix", "SELECT count(*) AS flows FROM flows", "flows")(lambda s, d: connections.admitted(A.flows(s, d), 1 << 20, 24).agg(F.count("*").alias("flows")))

# --- files -----------------------------------------------------------------------------------------------------------------------

KEYED = "md5(content_id) AS content, md5(flow_id) AS flow"


def _uuid(c: str):
    h = F.md5(F.col(c).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def segments(s, d):
    rows = A.content(s, d).withColumn("content_id", _uuid("content_id")).withColumn("flow_id", _uuid("flow_id"))
    return files.segment_table(rows, 20_000)


@query("segments_read_back", f"SELECT {KEYED}, direction, view, stream_offset, ts_ns, payload_len AS bytes, md5(text) AS md5 FROM content", "content")
def segments_read_back(s, d):
    plain = lambda c: F.regexp_replace(c, "-", "")
    return files.scan_segments(segments(s, d)).select(plain("content_id").alias("content"), plain("flow_id").alias("flow"), "direction", "view", "stream_offset", "ts_ns", F.octet_length("data").cast("bigint").alias("bytes"), F.md5("data").alias("md5"))


@query("segments_read_at", "SELECT md5(content_id) AS content, false AS failed FROM content WHERE view = 'tcp_raw' UNION ALL SELECT NULL, true FROM (SELECT DISTINCT 1 FROM content)", "content")
def segments_read_at(s, d):
    table = segments(s, d)
    places = files.scan_segments(table).where("view = 'tcp_raw'").select("segment_path", "segment_offset")
    bad = places.agg(F.min("segment_path").alias("segment_path")).where("segment_path is not null").withColumn("segment_offset", F.lit(21).cast("bigint"))
    return files.read_at(table, places.unionByName(bad)).select(F.regexp_replace("content_id", "-", "").alias("content"), F.col("error").isNotNull().alias("failed"))


@query("segments_listed", "SELECT CAST(sum(payload_len + 68) AS BIGINT) AS bytes FROM content", "content")
def segments_listed(s, d):
    """Bytes of all segments but for their heads of 20: each record takes 68 bytes besides its payload."""
    return files.list_segments(segments(s, d)).agg(F.sum(F.col("bytes") - 20).alias("bytes"))


@query("spool_read_back", "SELECT 'flows' AS \"table\", count(*) AS rows, CAST(sum(bytes_c2s) AS BIGINT) AS total FROM flows UNION ALL SELECT 'matches', count(*), CAST(sum(offset_end) AS BIGINT) FROM matches UNION ALL SELECT 'http_messages', count(*), CAST(sum(ts_ns) AS BIGINT) FROM http_messages", "flows", "matches", "http_messages")
def spool_read_back(s, d):
    """Three rows, worked out at once. total is BIGINT, as in the SQL, where every total fits, else an exact DECIMAL(38,0): there the SQL only fails."""
    spool = files.spool_events({"flows": A.flows(s, d), "matches": A.matches(s, d), "http_messages": A.http_messages(s, d)}, 500)
    tables = files.demux(files.spooled(spool))
    sums = [tables[t].agg(F.lit(t).alias("table"), F.count("*").alias("rows"), F.sum(F.col(c).cast("decimal(38,0)")).alias("total")) for t, c in (("flows", "bytes_c2s"), ("matches", "offset_end"), ("http_messages", "ts_ns"))]
    found = sums[0].unionByName(sums[1]).unionByName(sums[2]).collect()
    fits = all(r["total"] is None or -(2**63) <= r["total"] < 2**63 for r in found)
    return A.literal(s, tuple(map(tuple, found)), f"table string, rows bigint, total {'bigint' if fits else 'decimal(38,0)'}")


# --- frames ----------------------------------------------------------------------------------------------------------------------

TRAFFIC = {
    "decode_statuses": traffic.status_counts,
    "decode_headers": traffic.headers,
    "frames_not_worth_decoding": traffic.rejected,
    "fragments_assembled": traffic.assembled,
    "flows_from_frames": traffic.flows,
    "flows_from_captures": traffic.flows_of_captures,
    "flows_from_filtered_frames": traffic.filtered,
    "capture_statistics": traffic.statistics,
    "streams_reassembled": traffic.streams,
    "stream_gaps": traffic.gaps,
    "http_messages_parsed": traffic.messages,
    "http_bodies_parsed": traffic.bodies,
    "http_parsed_from_chunks": traffic.parsed_alone,
    "frames_to_matches": traffic.hits,
    "live_flows_closed": traffic.closed_live,
}
for _name, _f in TRAFFIC.items():
    _sql, _needs = traffic.SQL.get(_name, traffic.SQL["flows_from_frames"])
    query(_name, _sql, *_needs)(_f)
