"""The flow list: a conjunction of optional predicates, newest first, one page, enriched."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import facts

COLUMNS = ("flow_id", "started_ns", "ended_ns", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "service", "packets_c2s", "packets_s2c", "bytes_c2s", "bytes_s2c", "truncated")


#: Rows of a page at most.
MOST = 500


@dataclass(frozen=True)
class TrafficFilter:
    service: str | None = None
    src_ip: str | None = None
    dst_ip: str | None = None
    port: int | None = None
    protocol: str | None = None
    from_ns: int | None = None
    to_ns: int | None = None
    pattern_id: str | None = None
    user_agent: str | None = None
    user_agent_equals: str | None = None
    user_agent_not_contains: str | None = None
    user_agent_regex: str | None = None
    favorite: bool | None = None
    limit: int | None = None
    offset: int | None = None


def select_flows(flows: DataFrame, f: TrafficFilter, http: DataFrame | None = None, matches: DataFrame | None = None, favorites: DataFrame | None = None, ignores: DataFrame | None = None) -> DataFrame:
    """Flows that meet every predicate of f. Tables are latest-per-key already; ignores holds (pattern_id, pattern_revision).

    Predicates on a flow's messages or matches are semi and anti joins, so flows without any message pass a not-contains.
    """
    c = F.col
    tests = [c(n) == v for n, v in (("service", f.service), ("src_ip", f.src_ip), ("dst_ip", f.dst_ip)) if v is not None]
    if f.port is not None:
        tests.append((c("src_port") == f.port) | (c("dst_port") == f.port))
    if f.protocol is not None:
        tests.append(c("protocol") == f.protocol.lower())
    if f.from_ns is not None:
        tests.append(c("started_ns") >= f.from_ns)
    if f.to_ns is not None:
        tests.append(c("started_ns") <= f.to_ns)
    out = flows.where(reduce(lambda a, b: a & b, tests)) if tests else flows
    ua = F.coalesce("user_agent", F.lit(""))
    has = lambda text: F.contains(F.lower(ua), F.lit(text.lower()))
    meets = lambda df, test, kind: out.join(df.where(test).select("flow_id").distinct(), "flow_id", kind)
    if ignores is not None:
        hidden = matches.where("action = 'ignore'").join(ignores, ["pattern_id", "pattern_revision"], "left_semi")
        out = meets(hidden, F.lit(True), "left_anti")
    if f.pattern_id is not None:
        out = meets(matches, c("pattern_id") == f.pattern_id, "left_semi")
    if f.user_agent is not None:
        out = meets(http, has(f.user_agent), "left_semi")
    if f.user_agent_equals is not None:
        out = meets(http, F.lower(ua) == f.user_agent_equals.lower(), "left_semi")
    if f.user_agent_not_contains is not None:
        out = meets(http, has(f.user_agent_not_contains), "left_anti")
    if f.user_agent_regex is not None:
        out = meets(http, ua.rlike(f.user_agent_regex), "left_semi")
    if f.favorite is not None:
        out = meets(favorites, F.lit(True), "left_semi" if f.favorite else "left_anti")
    return out


def page(flows: DataFrame, f: TrafficFilter) -> DataFrame:
    """Newest first, flow_id deciding ties; at most 500 rows, 100 unless asked otherwise."""
    cols = [c for c in COLUMNS if c in flows.columns]
    return flows.select(*cols).orderBy(F.desc("started_ns"), "flow_id").offset(f.offset or 0).limit(min(100 if f.limit is None else f.limit, MOST))


def enrich(rows: DataFrame, favorites: DataFrame, http: DataFrame, matches: DataFrame) -> DataFrame:
    """A page with favorite, user_agent and pattern_ids. Only the page's flows are looked up.

    A page has 500 rows at most, so it is worked out once, here, and its ids go to the look-ups; more rows are an error.
    """
    spark, found = rows.sparkSession, rows.limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"a page has {MOST} rows at most")
    rows = spark.createDataFrame(found, rows.schema)
    ids = F.broadcast(rows.select("flow_id"))
    fav = favorites.select("flow_id").distinct().withColumn("favorite", F.lit(True))
    out = rows.join(fav.join(ids, "flow_id", "left_semi"), "flow_id", "left").withColumn("favorite", F.coalesce("favorite", F.lit(False)))
    out = out.join(facts.latest_user_agent(http.join(ids, "flow_id", "left_semi")), "flow_id", "left")
    return out.join(facts.pattern_ids(matches.join(ids, "flow_id", "left_semi")), "flow_id", "left").withColumn("pattern_ids", F.coalesce("pattern_ids", F.array().cast("array<string>")))


def flow_detail(flows: DataFrame, http: DataFrame, matches: DataFrame, favorites: DataFrame, flow_id: str) -> DataFrame:
    """One flow with its messages and matches nested, in time order, and whether it is a favorite."""
    nest = lambda df, name, *cols: df.where(F.col("flow_id") == flow_id).groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = facts.flow_by_id(flows, flow_id)
    out = out.join(nest(http, "http", "ts_ns", "id", "method", "host", "path", "status", "user_agent"), "flow_id", "left")
    out = out.join(nest(matches, "matches", "ts_ns", "pattern_id", "pattern_revision", "content_id", "offset_start", "offset_end", "historical"), "flow_id", "left")
    fav = favorites.where(F.col("flow_id") == flow_id).select("flow_id").distinct().withColumn("favorite", F.lit(True))
    return out.join(fav, "flow_id", "left").withColumn("favorite", F.coalesce("favorite", F.lit(False)))
