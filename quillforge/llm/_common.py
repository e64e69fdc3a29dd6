"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.storage import checkpointed, few, release, remove, shared_folder, stored

__all__ = ["SPACE", "checkpointed", "few", "field", "fresh", "let", "pieces", "raw_utf8", "release", "remove", "rows_of", "shared_folder", "stored", "tidied", "without"]
#: C-locale white space: what separates words in every operator here.
SPACE = r"\x20\x09-\x0D"


def let(value, body):
    """Bind a Column once inside an expression, so lambdas in ``body`` never re-evaluate it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(*taken: str, stem: str) -> str:
    """A column name that clashes with none of ``taken``, letter case aside."""
    low, name = {t.lower() for t in taken}, stem
    while name.lower() in low:
        name = f"{name}_"
    return name


def field(df: DataFrame, col: str, name: str | None = None) -> T.StructField:
    return T.StructField(name or col, df.schema[col].dataType, True)


def without(docs: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """The rows of ``docs`` whose ``id`` is not in the one column of ``ids``; nulls equal nulls."""
    name = fresh(*docs.columns, stem="gone")
    ids = checkpointed(ids.toDF(name).distinct())
    ids = F.broadcast(ids) if few(ids) else ids.hint("shuffle_hash")
    return docs.join(ids, F.col(f"`{id}`").eqNullSafe(F.col(name)), "left_anti")


def raw_utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls read as empty texts. Nothing is copied where Arrow allows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int):
    """Slices of rows of at most ``most`` bytes together (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def tidied(run):
    """``run`` over batches, after which memory that it freed goes back to the system: Python workers live on, and would keep it."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def rows_of(batch: pa.RecordBatch, most: int, at: int = 1):
    """Sub-batches whose texts, of column ``at``, hold at most ``most`` bytes, longer rows alone."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for i, j in pieces(offsets, most):
        yield batch.slice(i, j - i)
