"""Content records: interval union, hiding of covered raw records, projection of hits, presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIRE_VIEWS = ("http_request_headers", "http_request_body", "http_response_headers", "http_response_body")
REQUEST_VIEWS = ("http_request_headers", "http_request_body", "http_request_decoded_body")
RESPONSE_VIEWS = ("http_response_headers", "http_response_body", "http_response_decoded_body")
KEYS = ["flow_id", "direction"]
#: Bytes of a stream that one bin of the overlap join covers.
BIN = 65_536


def with_range(content: DataFrame) -> DataFrame:
    return content.withColumn("s", F.col("stream_offset")).withColumn("e", F.col("stream_offset") + F.col("payload_len"))


def merged_ranges(content: DataFrame) -> DataFrame:
    """Islands (flow_id, direction, s, e) of the wire views' ranges; ranges that touch are one."""
    rows = with_range(content).where(F.col("view").isin(*WIRE_VIEWS) & (F.col("payload_len") > 0))
    w = Window.partitionBy(*KEYS).orderBy("s", "e")
    top = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.when(F.col("s") <= top, 0).otherwise(1))
    island = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*KEYS, "__island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("__island")


def hidden_raw(content: DataFrame) -> DataFrame:
    """Raw records that lie in one island as a whole; empty ones never do."""
    raw = with_range(content).where("view = 'tcp_raw' and payload_len > 0")
    # islands lie apart and in order, so the last one that begins at or before a record is the only one that can hold it
    islands = merged_ranges(content).select(*KEYS, "s", F.col("e").alias("__end"))
    rows = raw.select(*KEYS, "s", F.lit(None).cast("bigint").alias("__end"), F.struct(*content.columns).alias("__row"))
    w = Window.partitionBy(*KEYS).orderBy("s", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = islands.unionByName(rows, allowMissingColumns=True).withColumn("__cover", F.last("__end", ignorenulls=True).over(w))
    return both.where(F.col("__row").isNotNull() & (F.col("__cover") >= F.col("__row.stream_offset") + F.col("__row.payload_len"))).select("__row.*")


def visible(content: DataFrame) -> DataFrame:
    """content without the raw records that semantic ones cover."""
    return content.join(hidden_raw(content).select("content_id"), "content_id", "left_anti").select(*content.columns)


def projected_hits(content: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches on the records that show them: direct ones, and those of hidden raw records on every wire view they overlap.

    Hits have offsets in the stream. Equal hits of one record (pattern, revision, offsets, historical) count once.
    """
    shown, hidden = with_range(visible(content)), hidden_raw(content).select("content_id", *KEYS)
    cols = ["pattern_id", "pattern_revision", "offset_start", "offset_end", "historical"]
    direct = matches.join(shown.select("content_id"), "content_id", "left_semi").select(F.col("content_id").alias("target_id"), *cols)
    moved = matches.drop("flow_id").join(hidden, "content_id")
    target = shown.where(F.col("view").isin(*WIRE_VIEWS)).select(F.col("content_id").alias("target_id"), *KEYS, "s", "e")
    # only records and hits that share a bin of the stream meet; a hit that is met in two bins counts once in the end
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / BIN))).alias("__bin")
    over = moved.select("*", bins("offset_start", "offset_end")).join(target.select("*", bins("s", "e")), [*KEYS, "__bin"])
    over = over.where("offset_start < e and offset_end > s").select("target_id", *cols)
    return direct.unionByName(over).dropDuplicates()


def presentation(content: DataFrame, flows: DataFrame, most: int = 4096) -> DataFrame:
    """content_id, request (does the client speak), preview (first bytes as text) of every record."""
    side = flows.select("flow_id", F.when(F.col("initiator_a"), "a_to_b").otherwise("b_to_a").alias("__client"))
    request = F.when(F.col("view").isin(*REQUEST_VIEWS), True).when(F.col("view").isin(*RESPONSE_VIEWS), False).otherwise(F.col("direction") == F.col("__client"))
    return content.join(side, "flow_id", "left").select("content_id", request.alias("request"), text(F.substring("data", 1, most)).alias("preview"))


def text(data):
    """Bytes as text; what is not UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(data.cast("string"))


def formatted(content: DataFrame, form: str = "base64") -> DataFrame:
    """content_id and body: the payload as raw bytes, lower-case hex, text, or base64 without line breaks (the default)."""
    data = F.col("data")
    body = {"raw": data, "hex": F.lower(F.hex(data)), "text": text(data)}.get(form, F.regexp_replace(F.base64(data), "[\r\n]", ""))
    return content.select("content_id", body.alias("body"))


def hexdump(content: DataFrame, width: int = 16) -> DataFrame:
    """content_id, offset, hex and printable columns, a row for every width bytes."""
    lines = content.select("content_id", "data", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("data") / width).cast("int") - 1))).alias("line"))
    part = F.substring("data", F.col("line") * width + 1, F.lit(width))
    printable = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7E]", ".")
    return lines.select("content_id", (F.col("line") * width).cast("bigint").alias("offset"), F.trim(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 ")).alias("hex"), printable.alias("printable"))


def highlight(content: DataFrame, hits: DataFrame, most: int = 4096) -> DataFrame:
    """content_id, start, end: spans to mark in the preview, clipped to it; a span that begins inside an earlier one is left out."""
    at = hits.join(content.select(F.col("content_id").alias("target_id"), F.col("stream_offset").alias("__from"), F.least(F.col("payload_len"), F.lit(most)).alias("__n")), "target_id")
    spans = at.select("target_id", F.greatest(F.col("offset_start") - F.col("__from"), F.lit(0)).alias("start"), F.least(F.col("offset_end") - F.col("__from"), F.col("__n")).alias("end")).where("start < end").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("start", "end")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    step = lambda acc, x: F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc)
    kept = spans.select("target_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")).groupBy("target_id").agg(ordered.alias("all"))
    return kept.select(F.col("target_id").alias("content_id"), F.explode(F.aggregate("all", start, step, lambda a: a["out"])).alias("x")).select("content_id", "x.*")
