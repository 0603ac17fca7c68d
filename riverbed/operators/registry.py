"""Small mutable tables as append-only versions: patterns, services, favorites, replay jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import latest

KINDS, ACTIONS, DIRECTIONS = ("text", "binary", "regex"), ("find", "ignore"), ("both", "input", "output")


def latest_patterns(patterns: DataFrame) -> DataFrame:
    """The last revision of each pattern, deleted and disabled ones included."""
    return latest(patterns, ["id"], "revision")


def enabled_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns whose last revision is enabled: the filter comes after the choice of revision."""
    return latest_patterns(patterns).where("enabled")


def active_ignores(patterns: DataFrame) -> DataFrame:
    return enabled_patterns(patterns).where("action = 'ignore'").select(F.col("id").alias("pattern_id"), F.col("revision").alias("pattern_revision"))


def next_revision(patterns: DataFrame, pattern_id: str) -> DataFrame:
    return patterns.where(F.col("id") == pattern_id).agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("revision"))


def with_enabled(patterns: DataFrame, pattern_id: str, enabled: bool) -> DataFrame:
    """patterns and one more revision of a pattern, enabled or (a deletion's tombstone) not."""
    more = latest_patterns(patterns).where(F.col("id") == pattern_id).withColumn("revision", F.col("revision") + 1).withColumn("enabled", F.lit(enabled))
    return patterns.unionByName(more.select(*patterns.columns))


def pattern_revision(patterns: DataFrame, pattern_id: str, revision: int | None = None) -> DataFrame:
    own = patterns.where(F.col("id") == pattern_id)
    return own.where(F.col("revision") == revision) if revision is not None else latest_patterns(own)


def validate(kind: str, expression: str, action: str = "find", direction: str = "both") -> None:
    """ValueError for a pattern that cannot be compiled."""
    import re

    if kind not in KINDS or action not in ACTIONS or direction not in DIRECTIONS:
        raise ValueError("unknown kind, action or direction")
    if not expression:
        raise ValueError("empty expression")
    if kind == "binary":
        from .matching import binary_literal

        binary_literal(expression)
    if kind == "regex":
        if re.search(r"\(\?(=|!|<=|<!)|\\[1-9]", expression):
            raise ValueError("look-around and back references are not supported")
        re.compile(expression.encode())


def valid_service(port: int, name: str) -> None:
    """ValueError for a port that is none, or a name that is blank or longer than 64 characters."""
    if not 1 <= port <= 65535:
        raise ValueError("port must be 1 to 65535")
    if not name.strip() or len(name) > 64:
        raise ValueError("name must have 1 to 64 characters")


def with_pattern(patterns: DataFrame, new: dict) -> DataFrame:
    """patterns and the next revision of a pattern (its columns but revision; the first one where its id is new). ValueError if invalid."""
    validate(new["kind"], new["expression"], new["action"], new["direction_type"])
    own = patterns.where(F.col("id") == new["id"]).agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("revision"))
    kinds = dict(patterns.dtypes)
    return patterns.unionByName(own.select(*[F.col("revision").cast(kinds[c]).alias(c) if c == "revision" else F.lit(new.get(c)).cast(kinds[c]).alias(c) for c in patterns.columns]))


def lookback_job(patterns: DataFrame, pattern_id: str, segments: DataFrame, since_ns: int, now_ns: int) -> DataFrame:
    """The queued replay job (id, status, created_at, pattern_id, pattern_revision, segment_paths) for a pattern that was just changed.

    It pins the pattern's last revision and the segments (path, newest_ns) that may hold content since since_ns; no row where the pattern is
    disabled or nothing is to be read.
    """
    paths = segments.where(F.col("newest_ns") >= since_ns).agg(F.array_sort(F.collect_list("path")).alias("segment_paths")).where(F.size("segment_paths") > 0)
    own = enabled_patterns(patterns).where(F.col("id") == pattern_id).select(F.col("id").alias("pattern_id"), F.col("revision").alias("pattern_revision"), F.lit(1).alias("__k"))
    job = own.join(paths.withColumn("__k", F.lit(1)), "__k")
    return job.select(F.concat_ws("-", F.lit("replay"), "pattern_id", "pattern_revision", F.lit(now_ns)).alias("id"), F.lit("queued").alias("status"), F.lit(now_ns).cast("bigint").alias("created_at"), "pattern_id", "pattern_revision", "segment_paths")


def list_services(services: DataFrame) -> DataFrame:
    return services.where("enabled").orderBy("port")


def upsert_services(services: DataFrame, new: DataFrame) -> DataFrame:
    """services with new rows in place of those of the same port."""
    return services.join(new.select("port"), "port", "left_anti").select(*services.columns).unionByName(new.select(*services.columns))


def set_favorites(favorites: DataFrame, add: DataFrame | None = None, drop: DataFrame | None = None) -> DataFrame:
    """favorites after adding and dropping flows; doing either twice changes nothing."""
    out = favorites.select("flow_id")
    out = out.unionByName(add.select("flow_id")) if add is not None else out
    out = out.join(drop.select("flow_id"), "flow_id", "left_anti") if drop is not None else out
    return out.distinct()


def list_jobs(jobs: DataFrame, most: int = 100) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "id").limit(most)


#: What a job may become.
MOVES = {"queued": {"running", "failed"}, "running": {"queued", "completed", "failed"}, "completed": set(), "failed": {"queued"}}


def progress(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """jobs after status changes (id, status, at_ns), taken in their order; a change that MOVES does not allow is left out.

    A job has a handful of changes, so they are folded over as one array.
    """
    moves = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))).cast("array<string>"))])
    steps = changes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at_ns", "status"))).alias("__steps"))
    fold = F.aggregate(F.coalesce("__steps", F.array().cast("array<struct<at_ns:bigint,status:string>>")), F.col("status"), lambda now, x: F.when(F.array_contains(F.element_at(moves, now), x["status"]), x["status"]).otherwise(now))
    return jobs.join(steps, "id", "left").withColumn("status", fold).select(*jobs.columns)


def resumed(jobs: DataFrame, done: DataFrame, segments: DataFrame) -> DataFrame:
    """jobs as they are taken up again: running ones are queued, and one that has still to read a segment that is gone has failed.

    done: (id, path) read to the end; segments: (path) that there are.
    """
    gone = remaining_segments(jobs, done).join(segments.select("path"), "path", "left_anti").select("id").distinct().withColumn("__gone", F.lit(True))
    status = F.when(F.col("__gone") & F.col("status").isin("queued", "running"), "failed").when(F.col("status") == "running", "queued").otherwise(F.col("status"))
    return jobs.join(gone, "id", "left").withColumn("status", status).select(*jobs.columns)


def checkpoints(hits: DataFrame, read: DataFrame) -> DataFrame:
    """(id, path, hits) of segments that a job has read to the end, with the hits that it wrote: a segment counts as done only when its
    hits are written. hits: (id, path) for each hit; read: (id, path)."""
    n = hits.groupBy("id", "path").agg(F.count("*").alias("hits"))
    return read.select("id", "path").distinct().join(n, ["id", "path"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("bigint"))


def remaining_segments(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """(id, path) that a job which is to be taken up again has still to read."""
    todo = jobs.where(F.col("status").isin("queued", "running")).select("id", F.explode("segment_paths").alias("path"))
    return todo.join(done, ["id", "path"], "left_anti")
