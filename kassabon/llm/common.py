"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast only after it was counted and found at most this long.
BROADCAST_ROWS = 500_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="kassabon-"), f"{top.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where a session of one machine has none (tests) a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext.getCheckpointDir()
        if jsc:
            return jsc
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="kassabon-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """End the lineage of a small table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes that a Python worker gets at a time, and rows that a reader of Parquet unpacks at a time, while ``stored`` writes.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in ARROW}
    try:
        for k, v in ARROW.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame) -> DataFrame:
    """Write a large intermediate table to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    schema = df.schema
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Hint a broadcast if the counted rows stay within ``limit``; else leave a shuffle join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def running(df: DataFrame, keys: list[str], order: str, value: str, out: str, fan: int = 1024) -> DataFrame:
    """Exclusive running sum of ``value`` by ``order`` (dense-ish integers from 0) within ``keys``.

    Two levels: sums inside runs of ``fan`` consecutive orders, then sums of run totals, so
    that no window holds more than ``fan`` rows or one row a run.
    """
    run = F.floor(F.col(order) / F.lit(fan)).cast("long")
    df = df.withColumn("_run", run)
    inner = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_run").agg(F.sum(value).alias("_total"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(outer), F.lit(0)).cast("long")).drop("_total")
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long"))
    return local.join(totals, [*keys, "_run"]).withColumn(out, F.col("_local") + F.col("_before")).drop("_run", "_local", "_before")


def hexed(value: Column, width: int) -> Column:
    """Lower-case hexadecimal digits of a non-negative long, padded with zeros."""
    return F.lpad(F.lower(F.hex(value)), width, "0")


def unique_ids(docs: DataFrame) -> bool:
    """Whether ``doc_id`` is never null and never repeats."""
    got = docs.select("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    return got["n"] == got["d"]


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text) with a key of each row: ``doc_id`` where that is a whole number and unique, else a hash of id and text."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    key = F.col("doc_id").cast("long") if whole and unique_ids(docs) else F.xxhash64("doc_id", "text")
    return own.select(key.alias("key"), "doc_id", "text")


_made: dict[str, tuple[bytes, object]] = {}


def only(kind: str, data: bytes, make: Callable[[bytes], Any]) -> Any:
    """What ``make`` makes of ``data``, kept in this process until another model is asked for: workers serve one stage after the other."""
    if kind not in _made or _made[kind][0] != data:
        _made.clear()
        _made[kind] = data, make(data)
    return _made[kind][1]


def release() -> None:
    """Drop what ``only`` keeps, at the start of work that needs none of it."""
    _made.clear()
    trim()


def trim() -> None:
    """Give memory that this process has freed back to the system, at both ends of a task: a worker that waits for its next one keeps it else."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def spans(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Slices of consecutive items of about ``most`` together, a larger item alone."""
    first, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if sizes:
        yield first, len(sizes)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
