"""Usable vectors, scaled to length one, and their groups of exact copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.storage import latest, materialize

DIM = 64


def matrix(column: pa.Array, dtype: str = "float32") -> np.ndarray:
    """Rows of a binary column as one matrix, without copying per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), dtype=dtype)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=dtype, offset=int(offsets[0]), count=int(offsets[-1] - offsets[0]) // np.dtype(dtype).itemsize).reshape(len(column), -1)


def binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def unit_vectors(df: DataFrame, key: str, vector: str, dim: int = DIM, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, vec)`` of the usable rows: ``vec`` holds ``dim`` float32 of length one.

    A vector is usable if it has ``dim`` finite numbers that are not all zero;
    null, short and broken ones and rows without an id give nothing. Repeated
    deliveries count once.
    """
    one = latest(df, key, vector, *keep)
    schema = one.select(F.col(key).cast("bigint").alias("id"), *keep).schema

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = np.asarray(column.value_lengths().fill_null(-1))
            fit = np.flatnonzero(sizes == dim)
            picked = column.take(pa.array(fit))
            x = np.asarray(picked.flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
            largest = np.abs(x).max(axis=1, initial=0.0)
            good = np.isfinite(largest) & (largest > 0)
            x = x[good] / largest[good, None]
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            rows = pa.array(fit[good])
            columns = [batch.column(i).take(rows) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, binary(x.astype(np.float32))], [*batch.schema.names[:-1], "vec"])

    return one.select(F.col(key).cast("bigint").alias("id"), *keep, F.col(vector).alias("v")).mapInArrow(scale, schema.add("vec", "binary"))


def with_copies(units: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(all, distinct, copies)``: each distinct vector under its smallest id, and ``(*keep, id, rep)`` for groups of copies.

    Groups are formed by a map-side minimum, so a vector that a third of all rows
    share is no hot task, and no later stage compares copies with each other.
    """
    base = materialize(units, "units")
    groups = base.groupBy(*keep, "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    distinct = materialize(groups, "distinct")
    copies = base.join(distinct.where("n > 1").select(*keep, "vec", "rep"), [*keep, "vec"]).select(*keep, "id", "rep")
    return base, distinct.select(*keep, F.col("rep").alias("id"), "vec"), materialize(copies, "copies")
