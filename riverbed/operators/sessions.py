"""Flow sessions: idle splitting, counters, initiator-relative summaries, stream offsets, service attribution, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .addresses import canonical


def service_scope(packets: DataFrame, services: DataFrame) -> DataFrame:
    """packets with to_service (destination port is a service) and of_flow (either port is). services is a small dimension."""
    ports = services.where("enabled").select("port").distinct()
    to = ports.select(F.col("port").alias("dst_port"), F.lit(True).alias("__to"))
    frm = ports.select(F.col("port").alias("src_port"), F.lit(True).alias("__from"))
    both = packets.join(to, "dst_port", "left").join(frm, "src_port", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return both.withColumn("to_service", yes(F.col("__to"))).withColumn("of_flow", yes(F.col("__to")) | yes(F.col("__from"))).drop("__to", "__from")


def visible(packets: DataFrame, services: DataFrame, offline: bool = False, local_egress: bool = False) -> DataFrame:
    """Packets that a capture mode keeps: live remote traffic by destination port only, else either side's port."""
    scoped = service_scope(packets, services)
    return scoped.where("of_flow" if offline or local_egress else "to_service").drop("to_service", "of_flow")


def without_local_egress(packets: DataFrame, mac: Column) -> DataFrame:
    """Drop rows that the observing host sent itself."""
    return packets.where(F.col("eth_src").isNull() | (F.col("eth_src") != mac))


def idle_sessions(packets: DataFrame, keys: list[str], gap_ns: dict[str, int] | int, time: str = "ts_ns", order: str = "frame_no") -> DataFrame:
    """packets with session (1, 2, ... for each key): a gap above gap_ns starts a new one. gap_ns may differ by protocol."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    gap = F.lit(gap_ns) if isinstance(gap_ns, int) else F.element_at(F.create_map(*[F.lit(x) for kv in gap_ns.items() for x in kv]), F.col("protocol"))
    fresh = F.when(F.col(time) - F.lag(time).over(w) <= gap, 0).otherwise(1)
    return packets.withColumn("__fresh", fresh).withColumn("session", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def generations(packets: DataFrame, keys: list[str], order: str = "frame_no") -> DataFrame:
    """packets with generation: a bare SYN whose sequence number differs from the last SYN's opens a new flow on the same key."""
    w = Window.partitionBy(*keys).orderBy(order)
    bare = F.col("flags.syn") & ~F.col("flags.ack")
    before = F.last(F.when(bare, F.col("seq")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return packets.withColumn("generation", F.sum(F.when(bare & ~F.col("seq").eqNullSafe(before), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def summaries(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each session: times, counters by direction, relative to who sent the first packet. Sessions without payload go.

    sessions: a_to_b boolean, payload_len, ts_ns, frame_no besides keys and session.
    """
    g = sessions.groupBy(*keys, "session").agg(
        F.min("ts_ns").alias("started_ns"),
        F.max("ts_ns").alias("ended_ns"),
        F.min_by("a_to_b", F.struct("ts_ns", "frame_no")).alias("__first"),
        *[F.count_if(F.col("a_to_b") == d).alias(f"__n{int(d)}") for d in (True, False)],
        *[F.sum(F.when(F.col("a_to_b") == d, F.col("payload_len")).otherwise(0)).alias(f"__b{int(d)}") for d in (True, False)],
        F.count_if(F.col("payload_len") > 0).alias("__payload"),
    )
    side = lambda kind, own: F.when(F.col("__first") == own, F.col(f"__{kind}1")).otherwise(F.col(f"__{kind}0"))
    out = g.where("__payload > 0")
    return out.select(*keys, "session", "started_ns", "ended_ns", F.col("__first").alias("initiator_a"), side("n", True).alias("packets_c2s"), side("n", False).alias("packets_s2c"), side("b", True).alias("bytes_c2s"), side("b", False).alias("bytes_s2c"))


def stream_offsets(chunks: DataFrame, keys: list[str], length: Column, order: list[str]) -> DataFrame:
    """chunks with stream_offset: bytes before each chunk in its direction of its flow."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("stream_offset", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("bigint"))


def attribute(flows: DataFrame, services: DataFrame, first: str = "dst_port", second: str = "src_port") -> DataFrame:
    """flows with service: the name of the first of two ports that is a service, else null."""
    names = services.where("enabled").select("port", "name")
    a = names.toDF(first, "__a")
    b = names.toDF(second, "__b")
    return flows.join(a, first, "left").join(b, second, "left").withColumn("service", F.coalesce("__a", "__b")).drop("__a", "__b")


def http_service(flows: DataFrame, services: DataFrame, port: str = "dst_port") -> DataFrame:
    """flows with http_service: the service's name, or http:PORT where it has none."""
    names = services.where("enabled and http").select(F.col("port").alias(port), F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat(F.lit("http:"), F.col("port"))).alias("http_service"))
    return flows.join(names, port, "left")


def with_flow_key(packets: DataFrame) -> DataFrame:
    """packets with canonical endpoints a_ip, a_port, b_ip, b_port and direction."""
    return canonical(packets, "src_ip", "src_port", "dst_ip", "dst_port")
