"""Shared storage, batching and ordering helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

#: Bytes of text that a Python worker handles at a time, beyond a single longer document.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` where it is set.

    Without that setting a local session gets a temporary folder of its own and any
    other session a folder in the warehouse, which its executors share.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        _OWN[app] = tempfile.mkdtemp(prefix="layoutlint-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_layoutlint"
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/layoutlint/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_kept: dict = {}


def kept(key: str, make):
    """What a Python worker keeps from task to task of one stage; it goes when the worker begins something else."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release(run, *shared, keep: str | None = None):
    """``run`` for ``mapInArrow``, so that a Python worker, which serves other stages too, holds none of their tables meanwhile and no broadcast value afterwards."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key in [k for k in _kept if k != keep]:
            del _kept[key]
            _trim()
        # batches make no cycles, and walking the tables again and again costs a lot
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            for x in shared:
                x.__dict__.pop("_value", None)
            gc.collect()
            pa.default_memory_pool().release_unused()
            _trim()

    return task


def _trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (case-insensitively), one for each wanted name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind, width = np.int64, 8
    else:
        column, kind, width = column.cast(pa.string()), np.int32, 4
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * width).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together, or a single longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def row_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most ``limit`` bytes together, or a single longer text."""
    _, offsets = utf8_views(batch.column(column))
    for i, j in slices(offsets, limit):
        yield batch.slice(i, j - i)


def order_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values that cut the integer column ``key`` into ranges of about equal counts."""
    if parts < 2:
        return []
    row = df.select(F.percentile_approx(F.col(key), [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("b")).first()
    return sorted(set(row["b"] or []))


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """Number of the range that holds ``key``; null keys go to range 0. Two short scans, not one over all bounds."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every = F.array(*[F.lit(int(b)).cast("long") for b in bounds[step - 1 :: step]])
    every_one = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    block = F.size(F.filter(every, lambda b: b <= key))
    rest = F.size(F.filter(F.slice(every_one, block * step + 1, F.lit(step)), lambda b: b <= key))
    return F.coalesce(F.when(key.isNotNull(), block * step + rest), F.lit(0)).cast("int")
