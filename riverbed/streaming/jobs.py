"""Structured Streaming forms: topology windows, idle sessions, live matching, and the sink that fills the fact tables."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import connections, matching
from ..operators.sessions import with_flow_key
from ..sources.files import demux


def with_time(df: DataFrame, ts_ns: str = "ts_ns") -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros((F.col(ts_ns) / 1000).cast("long")))


def source_windows(packets: DataFrame, late: str = "30 seconds", length: str = "5 seconds", slide: str = "1 second") -> DataFrame:
    """Packets and bytes by source in sliding windows; the watermark lets a window go once nothing can come late to it."""
    g = with_time(packets).withWatermark("ts", late).groupBy(F.window("ts", length, slide), "ip4")
    return g.agg(F.count("*").alias("packets"), F.sum("wire_len").alias("bytes")).select(F.col("window.start").alias("start"), "ip4", "packets", "bytes")


def idle_sessions(packets: DataFrame, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions by key that a gap of silence ends."""
    g = with_time(packets).withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap))
    return g.agg(F.count("*").alias("packets"), F.sum("wire_len").alias("bytes")).select(*keys, F.col("session_window.start").alias("start"), "packets", "bytes")


def table_sink(events: DataFrame, path: str, checkpoint: str):
    """Fill the fact tables from a stream of metadata events: at least once, and rows that repeat go by key when they are read.

    Each batch writes its own folder by batch id, so a batch that runs twice replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name, rows in demux(batch.withColumn("seq", F.lit(batch_id))).items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def live_matches(content: DataFrame, patterns: list[dict], late: str = "10 seconds", ttl_ms: int = 120_000) -> DataFrame:
    """Hits in a stream of content records, across batches as across records; the tail of each stream is its state.

    A stream's state goes when event time has passed its last record by ttl_ms, or at once with a record whose column closed (where content
    has one) is true. Rules hold for as long as the query runs; swapping_matches() takes up new ones.
    """
    names = [f.split()[0] for f in matching.HITS.split(", ")]
    closing = "closed" in content.columns

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        matcher = matching.Matcher(patterns)
        if state.exists:
            end, tail, _ = state.get
            matcher.tails[tuple(key)] = end, bytes(tail)
        rows = pd.concat(list(frames)).sort_values(["stream_offset", "content_id"])
        records = rows.to_dict("records")
        out = [h for r in records for h in matcher.feed({**r, "service": r["service"] if isinstance(r["service"], str) else None})]
        if closing and rows["closed"].any():
            state.remove()
        elif tuple(key) in matcher.tails:
            last = int(rows["ts_ns"].max()) // 1_000_000
            state.update((*matcher.tails[tuple(key)], last))
            state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    timed = with_time(content).withWatermark("ts", late)
    return timed.groupBy("flow_id", "direction", "view").applyInPandasWithState(run, matching.HITS, "end_at long, tail binary, last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def swapping_matches(content: DataFrame, rules: Callable[[], list[dict]], path: str, checkpoint: str, ttl_ns: int = 120_000_000_000):
    """Write hits in a stream of content records under path/hits, with the rules that hold when a micro-batch begins.

    rules() is asked once for each micro-batch, so all its records see one set of rules. The tails of streams are a table under
    path/tails that each micro-batch writes anew (its number is in the folder's name, so one that runs twice replaces itself); those
    silent for ttl_ns go.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/tails/batch={batch_id - 1}"
        tails = spark.read.schema(matching.TAILS).parquet(before) if batch_id and _exists(spark, before) else None
        found = matching.carried(batch, rules(), tails)
        found.write.mode("overwrite").parquet(f"{path}/found/batch={batch_id}")
        found = spark.read.schema(found.schema).parquet(f"{path}/found/batch={batch_id}")
        latest = found.where("kind = 'tail'").agg(F.max("last_ns")).first()[0] or 0
        matching.tails_of(found).where(F.col("last_ns") >= latest - ttl_ns).write.mode("overwrite").parquet(f"{path}/tails/batch={batch_id}")
        matching.hits_of(found).write.mode("overwrite").parquet(f"{path}/hits/batch={batch_id}")

    return content.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _exists(spark, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def live_flows(packets: DataFrame, ports: list[int], timing: connections.Timing = connections.Timing(), late: str = "10 seconds", snapshots: bool = False) -> DataFrame:
    """Flow events of a stream of decoded packets: the tracker of a flow key is its state, and event time closes idle flows.

    Rows of a key are taken by arrival within a batch. A gap that a later packet shows closes a flow as well, so the result does not wait
    for the watermark. With snapshots, a flow that has given out payload also gives its row so far, a second of packet time apart at least.
    The state holds plain values only, so workers need no copy of this package.
    """
    names = [f.split()[0] for f in connections.EVENT.split(", ")]

    def run(key, frames, state):
        tracker = connections.Tracker(tuple(key), set(ports), timing)
        if state.exists:
            tracker.load(pickle.loads(state.get[0]))
        out: list[dict] = []
        if state.hasTimedOut:
            out = tracker.expire()
            state.remove()
        else:
            for p in pd.concat(list(frames)).sort_values(["arrival_ns", "path", "frame_no"]).to_dict("records"):
                p["seq"], p["ack"] = (None if p[c] is None or p[c] != p[c] else int(p[c]) for c in ("seq", "ack"))
                out += tracker.feed(p)
                if snapshots:
                    out += tracker.snapshot()
            state.update((pickle.dumps(tracker.dump()),))
            if tracker.flow:
                idle = timing.tcp_idle_ns if tracker.flow.first["protocol"] == "tcp" else timing.udp_idle_ns
                state.setTimeoutTimestamp(max((tracker.flow.last_ns + idle) // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
            else:  # only the memory of a flow just closed is left
                state.setTimeoutTimestamp(max(((tracker.grave_ns or 0) + timing.tombstone_ns) // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([{n: e.get(n) for n in names} for e in out], columns=names, dtype=object)

    cols = [*connections.COLUMNS, "ts"]
    keyed = with_time(with_flow_key(packets.where("status = 'packet'"))).withWatermark("ts", late).select(*dict.fromkeys(cols))
    return keyed.groupBy(*connections.KEYS).applyInPandasWithState(run, connections.EVENT, "tracker binary", "append", GroupStateTimeout.EventTimeTimeout)
