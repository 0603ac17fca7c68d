"""Source topology: totals, rates, network groups, bounded lists; and rules by longest prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .addresses import cidr, dotted, mask, parse_target

SECOND = 1_000_000_000


def source_totals(packets: DataFrame) -> DataFrame:
    return packets.groupBy("ip4").agg(F.count("*").alias("packets"), F.sum("wire_len").alias("bytes"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def rates(packets: DataFrame, now_ns: int | Column, window: int = 5) -> DataFrame:
    """source_totals with pps and bps over the last window seconds; a source seen for less is divided by the seconds seen, 1 at least."""
    now = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    second = lambda c: F.floor(c / SECOND)
    recent = second(F.col("ts_ns")) > second(now) - window
    g = packets.groupBy("ip4").agg(F.count("*").alias("packets"), F.sum("wire_len").alias("bytes"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.count_if(recent).alias("__p"), F.sum(F.when(recent, F.col("wire_len")).otherwise(0)).alias("__b"))
    span = F.greatest(F.lit(1), F.least(F.lit(window), second(now) - second(F.col("first_ns")) + 1))
    return g.select("ip4", "packets", "bytes", "first_ns", "last_ns", (F.col("__p") / span).alias("pps"), (F.col("__b") / span).alias("bps"))


def alive(sources: DataFrame, now_ns: int, ttl_s: int = 300) -> DataFrame:
    """Sources seen within the time to live."""
    return sources.where(F.col("last_ns") >= now_ns - ttl_s * SECOND)


def groups(sources: DataFrame, prefix: int = 24) -> DataFrame:
    """Network groups of sources (with packets, bytes, pps, bps)."""
    return sources.groupBy(cidr(F.col("ip4"), prefix).alias("cidr")).agg(F.count("*").alias("sources"), *[F.sum(c).alias(c) for c in ("packets", "bytes", "pps", "bps")])


def capped(packets: DataFrame, most: int) -> DataFrame:
    """Totals by source where only the first `most` sources to arrive are kept apart; the others make up the row whose ip4 is null."""
    first = packets.groupBy("ip4").agg(F.min(F.struct("ts_ns", "frame_no")).alias("at"), F.count("*").alias("packets"), F.sum("wire_len").alias("bytes"))
    kept = first.orderBy("at", "ip4").limit(most).select("ip4").withColumn("__kept", F.lit(True))
    named = first.join(kept, "ip4", "left").withColumn("ip4", F.when(F.col("__kept"), F.col("ip4")))
    return named.groupBy("ip4").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.count("*").alias("sources"))


def top(sources: DataFrame, prefix: int = 24, most_groups: int = 256, most_rows: int = 2048) -> DataFrame:
    """Group, source and place: groups by bytes a second, each with its sources, until the global number of source rows is used up.

    The group list is cut first; only its groups' sources are ranked, so the one unpartitioned window sees most_groups rows.
    """
    keyed = sources.withColumn("cidr", cidr(F.col("ip4"), prefix))
    head = groups(sources, prefix).orderBy(F.desc("bps"), "cidr").limit(most_groups)
    rank = head.select("cidr", F.col("sources").alias("n"), F.col("bps").alias("group_bps"), F.row_number().over(Window.orderBy(F.desc("bps"), "cidr")).alias("group_rank"))
    before = rank.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("group_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < most_rows)
    own = Window.partitionBy("cidr").orderBy(F.desc("bps"), "ip4")
    rows = keyed.join(F.broadcast(before), "cidr").withColumn("source_rank", F.row_number().over(own))
    return rows.where(F.col("before") + F.col("source_rank") <= most_rows).select("group_rank", "cidr", "source_rank", dotted(F.col("ip4")).alias("source"), "packets", "bytes", "bps")


def nested(rows: DataFrame) -> DataFrame:
    """top() as one row for each group with an array of its sources; bounded by top()."""
    return rows.groupBy("group_rank", "cidr").agg(F.array_sort(F.collect_list(F.struct("source_rank", "source", "packets", "bytes", "bps"))).alias("sources"))


def grand_total(packets: DataFrame) -> DataFrame:
    return packets.agg(F.count("*").alias("packets"), F.sum("wire_len").alias("bytes"), F.count_distinct("ip4").alias("sources"))


FOREVER = 2**63 - 1


def in_force(rules: DataFrame) -> DataFrame:
    """rules with until_ns: a rule (net, prefix, rule_id, created_ns, expires_ns) holds from created_ns until it expires (0 or null: never),
    is cleared (cleared_ns, where rules have it), or another is set for its target. So one rule at most holds for a target at any time."""
    w = Window.partitionBy("net", "prefix").orderBy("created_ns", "rule_id")
    ends = [F.when(F.col("expires_ns") > 0, F.col("expires_ns")), F.lead("created_ns").over(w), F.lit(FOREVER)]
    ends += [F.col("cleared_ns")] if "cleared_ns" in rules.columns else []
    return rules.withColumn("until_ns", F.least(*ends))


def longest_prefix(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """packets with the id of the most specific rule in force that covers ip4, or null: one equi-join for each prefix length that rules have.

    There are 33 lengths at most. A packet stays one row, as one rule at most holds for a target at a time.
    """
    lengths = sorted((r[0] for r in rules.select("prefix").distinct().collect()), reverse=True)
    out, live = packets, in_force(rules)
    for k in lengths:
        own = live.where(F.col("prefix") == k).select(F.col("net").alias("__n"), F.col("rule_id").alias(f"__r{k}"), F.col("created_ns").alias("__from"), F.col("until_ns").alias("__until"))
        fits = (F.col("ip4").bitwiseAND(F.lit(mask(k)).cast("bigint")) == F.col("__n")) & (F.col("ts_ns") >= F.col("__from")) & (F.col("ts_ns") < F.col("__until"))
        out = out.join(own, fits, "left").drop("__n", "__from", "__until")
    order = [F.col(f"__r{k}") for k in lengths] or [F.lit(None).cast("bigint")]
    return out.withColumn("rule_id", F.coalesce(*order)).drop(*[f"__r{k}" for k in lengths])


def sampled(key: Column, percent: Column) -> Column:
    """True for about percent of all keys, by a hash: the first 32 bits of the md5 of the key as text."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") * 100 < percent.cast("bigint") * F.lit(1 << 32)


def rule_counters(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """Seen and dropped packets and bytes of each rule, of packets that came while it held. A rule that drops nothing counts nothing."""
    hit = longest_prefix(packets, rules).where("rule_id is not null").join(rules.where("drop_percent > 0").select("rule_id", "drop_percent"), "rule_id")
    drop = sampled(F.col("frame_no"), F.col("drop_percent"))
    return hit.groupBy("rule_id").agg(F.count("*").alias("seen_packets"), F.sum("wire_len").alias("seen_bytes"), F.count_if(drop).alias("dropped_packets"), F.sum(F.when(drop, F.col("wire_len")).otherwise(0)).alias("dropped_bytes"))


def active_rules(rules: DataFrame, at_ns: int) -> DataFrame:
    """Rules in force at a time."""
    return in_force(rules).where((F.col("created_ns") <= at_ns) & (F.col("until_ns") > at_ns)).drop("until_ns")


def audit(rules: DataFrame, now_ns: int, most: int = 32) -> DataFrame:
    """The last events of the rules: set; clear, where they were taken back; expire, where their time came while they held."""
    live = in_force(rules)
    event = lambda name, time, test: live.where(test).select("rule_id", F.lit(name).alias("event"), F.col(time).alias("at_ns"))
    out = event("set", "created_ns", F.lit(True)).unionByName(event("expire", "expires_ns", F.col("until_ns") == F.col("expires_ns")))
    if "cleared_ns" in rules.columns:
        out = out.unionByName(event("clear", "cleared_ns", (F.col("until_ns") == F.col("cleared_ns")) & ~F.col("until_ns").eqNullSafe(F.col("expires_ns"))))
    return out.where(F.col("at_ns") <= now_ns).orderBy(F.desc("at_ns"), F.desc("rule_id"), "event").limit(most)


def valid_rule(target: str, drop_percent: int, ttl_s: int, group_prefix: int = 24, most_ttl_s: int = 86_400) -> str:
    """The target of a rule in canonical form. ValueError for another target, a percentage outside 1..100, or a time outside 1..most_ttl_s."""
    if not 1 <= drop_percent <= 100:
        raise ValueError("drop_percent must be 1 to 100")
    if not 1 <= ttl_s <= most_ttl_s:
        raise ValueError(f"ttl_s must be 1 to {most_ttl_s}")
    return parse_target(target, group_prefix)


def counter_rate(samples: DataFrame, keys: list[str], value: str, time: str = "ts_ns", order: str = "frame_no") -> DataFrame:
    """samples with rate: growth a second since the sample before, never below 0; null for the first."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    dt = (F.col(time) - F.lag(time).over(w)) / SECOND
    return samples.withColumn("rate", F.when(dt > 0, F.greatest(F.lit(0.0), (F.col(value) - F.lag(value).over(w)) / dt)))


def stream_rates(samples: DataFrame, time: str = "ts_ns", order: str = "frame_no", keys: list[str] | None = None) -> DataFrame:
    """samples (counters flows_opened, flows_closed, packets) with streams_per_minute since the sample before and packets_per_flow so far.

    keys part the samples by what is counted (a capture, a host); without them all are one series, a row for each sample.
    """
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(time, order)
    ms = (F.col(time) - F.lag(time).over(w)) / 1_000_000
    grown = F.col("flows_opened") - F.lag("flows_opened").over(w)
    each = F.when(F.col("flows_closed") > 0, F.col("packets") / F.col("flows_closed"))
    return samples.withColumn("streams_per_minute", F.when(ms > 0, F.greatest(F.lit(0.0), grown * 60_000 / ms))).withColumn("packets_per_flow", each)


def severity(value: Column, warn: float, danger: float) -> Column:
    return F.when(value >= danger, "danger").when(value >= warn, "warn").otherwise("ok")


def pressure(queues: DataFrame) -> DataFrame:
    """The highest fill of any queue in percent, from (queue, depth, capacity)."""
    return queues.agg(F.coalesce(F.max(F.floor(F.col("depth") * 100 / F.greatest(F.col("capacity"), F.lit(1)))), F.lit(0)).alias("live_pressure_pct"))
