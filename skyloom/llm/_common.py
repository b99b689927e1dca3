"""Helpers shared by the text operators: column access, shared folder, ragged arrays."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000
#: Text bytes that one step of a Python pass holds at a time; bounds worker memory.
BLOCK_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster names one; a
    temporary folder only where nothing is set and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='skyloom-')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``id`` and ``text`` (UTF-8 bytes, null as empty); other columns are left behind,
    so their names cannot clash with an operator's outputs."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def bounded_batches(spark: SparkSession) -> None:
    """Texts are long: at most BATCH_ROWS of them in an Arrow batch, unless the session already asks for less.
    The setting is the session's and stays, as plans are run after the call that makes them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def trim() -> None:
    """Give memory that a finished pass has freed back to the system: workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What passes keep in a worker between tasks.
KEPT: list = []


def kept(size: int):
    """An ``lru_cache`` of what a pass keeps between tasks; it can be made again, so a pass that needs the room may drop it."""

    def wrap(make):
        held = functools.lru_cache(maxsize=size)(make)
        KEPT.append(held)
        return held

    return wrap


def drop_kept() -> None:
    """Free what earlier passes of other kinds keep in this worker."""
    if any(held.cache_info().currsize for held in KEPT):
        for held in KEPT:
            held.cache_clear()
        trim()


def trimmed(run):
    """A pass that trims when it ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def blocks(batches, limit: int = BLOCK_BYTES):
    """Regroup Arrow batches into tables of at most about ``limit`` text bytes each (one row at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    try:
        yield from _regrouped(batches, limit, held, size)
    finally:
        trim()


def _regrouped(batches, limit: int, held: list, size: int):
    for batch in batches:
        lens = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)
        ends = np.cumsum(lens)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max(1, limit - size), "right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - base)
            start = stop
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pieces(batch: pa.RecordBatch, column: str, limit: int):
    """Slices of ``batch`` with at most about ``limit`` text bytes in ``column`` each (one row at least)."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def ragged_take(flat: np.ndarray, off: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``idx`` of the ragged array (flat, off), end to end, and their new offsets."""
    lens = off[idx + 1] - off[idx]
    out = np.zeros(len(idx) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    if not out[-1]:
        return flat[:0], out
    where = np.arange(out[-1], dtype=np.int64)
    where += np.repeat(off[idx] - out[:-1], lens)
    return flat[where], out


def readable(texts: pa.Array) -> pa.Array:
    """Texts, or their UTF-8 bytes, as strings; bytes that are no UTF-8 become U+FFFD."""
    raw = texts.cast(pa.binary())
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t if t is None else t.decode("utf-8", "replace") for t in raw.to_pylist()], pa.string())


def binary_array(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """An Arrow binary column of the byte ranges ``off`` of ``data`` without a copy per row."""
    if len(off) and off[-1] >= 1 << 31:
        raise ValueError("a row of 2 GB or more does not fit a binary column")
    data = np.ascontiguousarray(data).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])


class Interner(dict):
    """Numbers keys in order of their first appearance."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n
