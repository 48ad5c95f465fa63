"""What the operators share: tables, slices of Arrow batches, tables written to the shared folder."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from crashlens.sources.sinks import scratch_path, write_result

#: Bytes of text that a task works on at a time; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

#: The session option by which Spark removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="crashlens-"), "crashlens.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(path)  # Spark serves the file from the driver; no executor reads the driver's folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the folder that ``spark.checkpoint.dir`` names and return it read back.

    This cuts the lineage: an executor lost later costs a reread, not the work so far. The shuffle files of the plan go once it
    has been written.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return write_result(df, scratch_path(df.sparkSession, name))
    finally:
        conf.set(CLEANUP, before)


@cache
def _allocator():
    """The C library's malloc_trim, if it has one.

    Arrays of over 16 MB get pages of their own, so these go back when an array does; smaller ones use the same pages again, as fresh
    ones cost more time than the work on them. Up to 32 MB of free pages stay while a task runs.
    """
    library = ctypes.CDLL(None)
    if not hasattr(library, "malloc_trim"):
        return None
    library.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
    library.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
    return library.malloc_trim


def give_back() -> None:
    """Return free memory of this worker to the system: workers stay between tasks and stages, and an executor's memory holds them all."""
    pa.default_memory_pool().release_unused()
    if trim := _allocator():
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice has much over ``limit`` bytes of ``column``; no row is cut or left out. What a task leaves is given back."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            yield batch.slice(start, end - start)
    give_back()


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one array of UTF-8 bytes, and where each starts; a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    """A column as Python strings, null as the empty one."""
    return [text or "" for text in column.to_pylist()]
