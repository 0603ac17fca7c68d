"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='riverbed-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back. It survives lost executors.

    It goes when the scratch() that it was written in ends, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of materialize() that nothing needs any more."""
    _remove(df._written_to)


@contextmanager
def scratch():
    """Tables that materialize() writes inside go at the end, but for those given to the function that this yields."""
    mine: list[str] = []
    _scopes.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        mine.remove(df._written_to)  # ValueError for a table of another scope
        if len(_scopes) > 1:
            _scopes[-2].append(df._written_to)
        return df

    try:
        yield keep
    finally:
        _scopes.remove(mine)
        for path in mine:
            _remove(path)


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # the session may have ended: nothing to delete through  # noqa: BLE001, S110
            pass


atexit.register(_clean)


def kept_by_worker(name: str, make):
    """What a Python worker keeps from task to task under a name; keeping another drops it, so that one operator's tables are held at a time."""
    held = sys.modules.setdefault("_riverbed_worker", types.ModuleType("_riverbed_worker")).__dict__
    if held.get("name") != name:
        held.pop("value", None)
        held["value"] = make()
        held["name"] = name
    return held["value"]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20):
    """Inside, Arrow batches hold at most so many rows and bytes (and never more than the session allows): whole texts can be long."""
    name = "spark.sql.execution.arrow.max{}PerBatch"
    before = {name.format(k): (spark.conf.get(name.format(k)), most) for k, most in (("Records", rows), ("Bytes", size))}
    for key, (now, most) in before.items():
        n = int(now.lower().removesuffix("b"))
        spark.conf.set(key, str(min(n, most) if n > 0 else most))
    try:
        yield
    finally:
        for key, (now, _) in before.items():
            spark.conf.set(key, now)


def pieces(batch: pa.RecordBatch, column: int, most: int = 2 << 20):
    """A batch in slices whose texts (at position column) take about `most` bytes, one row at least: what is made of them is held at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo parts; a null id falls in no fold (-1)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % parts, F.lit(-1))


def share(col: Column | str, fraction: float) -> Column:
    """True for about this fraction of the values of col, the same ones on every run."""
    return F.pmod(F.xxhash64(col), F.lit(1_000_000)) < int(min(1.0, fraction) * 1_000_000)
