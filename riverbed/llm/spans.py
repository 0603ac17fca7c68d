"""Spans of regular expressions as Spark expressions: offsets in code points, end exclusive, leftmost and without overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the matches: the pieces between them, and their own lengths, give the offsets."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.length(x["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    both = F.zip_with(pieces, found, lambda a, b: F.struct(a.alias("piece"), b.alias("value")))
    return F.aggregate(F.filter(both, lambda x: x["value"].isNotNull()), start, step, lambda acc: acc["out"])


def spans_where(text: Column, needed: Column, pattern: str) -> Column:
    """spans(), worked out only where needed holds (a cheap test that every match passes); else empty."""
    return F.when(needed, spans(text, pattern)).otherwise(F.array().cast(SPAN))


def cut_out(text: Column, parts: Column, put) -> Column:
    """text with each of parts (structs with start and end, in order, apart from one another) replaced by put(part)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        kept = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(kept, put(x))).alias("out"))

    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(parts) > 0, F.aggregate(parts, start, step, done)).otherwise(text)
