"""Helpers for operators that work on Arrow batches in Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Code points handled at once, so that memory doesn't follow the batch size.
SLICE_CHARS = 1_000_000
#: Bytes of rows that a worker gets at once.
BATCH_BYTES = 4 << 20


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) pieces of a batch; null is the empty string.

    A piece holds whole texts and at most SLICE_CHARS code points, unless one
    text alone is longer.
    """
    start, held, chars = 0, [], 0
    for row, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        if held and chars + len(text) > SLICE_CHARS:
            yield start, held
            start, held, chars = row, [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield start, held


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of `schema` from arrays or lists."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def give_back() -> None:
    """Return freed memory to the system.

    Workers outlive tasks, and the pools of Arrow and of the C library keep
    what earlier tasks have freed.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), with memory given back after each task.

    Rows hold whole texts, so a batch is bounded by its bytes.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)
