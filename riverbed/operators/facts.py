"""Fact tables: latest version per key, look-ups, statistics, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sorting key of each fact table; the row inserted last wins.
KEYS = {
    "flows": ["flow_id"],
    "http_messages": ["flow_id", "id"],
    "content_index": ["flow_id", "ts_ns", "stream_offset", "content_id"],
    "matches": ["pattern_id", "pattern_revision", "content_id", "offset_start"],
}


def latest(df: DataFrame, keys: list[str], seq: str = "ingest_seq") -> DataFrame:
    """The last inserted row of each key: one partial aggregation, no window sort."""
    names = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*names), seq).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def pattern_ids(matches: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """flow_id and the sorted distinct patterns that were found in it (action find)."""
    found = matches.where("action = 'find'")
    found = found.join(flows.select("flow_id"), "flow_id", "left_semi") if flows is not None else found
    return found.groupBy("flow_id").agg(F.array_sort(F.collect_set("pattern_id")).alias("pattern_ids"))


def latest_user_agent(http: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """flow_id and the user agent, not empty, of its last message that has one."""
    http = http.join(flows.select("flow_id"), "flow_id", "left_semi") if flows is not None else http
    ua = F.when(F.col("user_agent") != "", F.col("user_agent"))
    return http.groupBy("flow_id").agg(F.max_by(ua, F.when(ua.isNotNull(), F.struct("ts_ns", "id"))).alias("user_agent")).where("user_agent is not null")


def sessions_per_minute(flows: DataFrame, as_of_ns: Column) -> DataFrame:
    """Flows by service that ended in the minute before as_of; flows of no service do not count."""
    return flows.where((F.col("ended_ns") >= as_of_ns - 60_000_000_000) & (F.coalesce("service", F.lit("")) != "")).groupBy("service").agg(F.count("*").alias("spm"))


def of_flow(df: DataFrame, flow_id: str, *order: str, limit: int | None = None) -> DataFrame:
    out = df.where(F.col("flow_id") == flow_id).orderBy(*order)
    return out.limit(limit) if limit else out


def flow_by_id(flows: DataFrame, flow_id: str) -> DataFrame:
    return flows.where(F.col("flow_id") == flow_id).orderBy(F.desc("ended_ns")).limit(1)


def content_of_flow(index: DataFrame, flow_id: str, limit: int = 2000) -> DataFrame:
    return of_flow(index, flow_id, "ts_ns", "stream_offset", "content_id", limit=min(limit, 5000))


def storage_stats(parts: DataFrame) -> DataFrame:
    """Rows, bytes and parts by table, and in all (table null), from a listing of parts (table, rows, bytes)."""
    return parts.rollup("table").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts"))


def storage_report(stores: dict[str, DataFrame]) -> DataFrame:
    """storage_stats() of several stores (name: listing of parts) with their totals (table null) and the total of all (store null)."""
    every = None
    for name, parts in stores.items():
        rows = parts.select(F.lit(name).alias("store"), "table", F.col("rows").cast("bigint").alias("rows"), F.col("bytes").cast("bigint").alias("bytes"))
        every = rows if every is None else every.unionByName(rows)
    return every.rollup("store", "table").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts"))


def remove_files(spark: SparkSession, paths: DataFrame, path: str = "segment_path") -> int:
    """Remove the files of wholly_old() from whatever store they lie in; how many there were. Paths come to the driver a partition at a time."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for row in paths.select(path).toLocalIterator():
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(row[0])
        n += bool(at.getFileSystem(conf).delete(at, False))
    return n


def keep_since(df: DataFrame, time: str, cutoff_ns: int | Column) -> DataFrame:
    """What a retention run leaves: rows strictly older than the cutoff go."""
    return df.where(F.col(time) >= cutoff_ns)


def wholly_old(content: DataFrame, cutoff_ns: int | Column, path: str = "segment_path") -> DataFrame:
    """Files whose newest record is older than the cutoff."""
    return content.groupBy(path).agg(F.max("ts_ns").alias("newest_ns"), F.count("*").alias("records")).where(F.col("newest_ns") < cutoff_ns)


def cleanup(tables: dict[str, DataFrame], cutoff_ns: int, confirm: str) -> dict[str, DataFrame]:
    """The fact tables after a retention run. confirm must be DELETE, so that no run happens by mistake."""
    if confirm != "DELETE" or cutoff_ns <= 0:
        raise ValueError("cleanup needs a positive cutoff and confirm='DELETE'")
    time = {"flows": "ended_ns", "http_messages": "ts_ns", "matches": "ts_ns", "content_index": "ts_ns", "content": "ts_ns"}
    return {name: keep_since(df, time[name], cutoff_ns) for name, df in tables.items()}


def numbered(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
