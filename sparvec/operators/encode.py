"""Encoding as a narrow DataFrame step: Arrow batches through the kernels, or Catalyst expressions with the same bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import IndexConfig
from ..functions import expressions, kernels
from .workers import reach


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as a matrix; rows of another length are an error."""
    if column.null_count or (len(column) and not (np.diff(column.offsets.to_numpy()) == width).all()):
        raise ValueError(f"vectors must have {width} values")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("vectors must be finite")
    return flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), width)


def lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, m.size + 1, m.shape[1] if m.size else 1, dtype=np.int32)[: len(m) + 1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(m).reshape(-1), kind))


def encode(df: DataFrame, config: IndexConfig, vector: str = "embedding") -> DataFrame:
    """Replace the vector column by codes (array of bytes) and scale, with a residual pass also codes2 and scale2.

    No shuffle; other columns pass through. Errors on rows of another length, with missing or infinite values, or zero.
    """
    reach(df.sparkSession)
    rest = [c for c in df.columns if c != vector]
    passes = ("", "2") if config.residual else ("",)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"codes{p} array<tinyint>, scale{p} float" for p in passes])

    def run(batches):
        for b in batches:
            got = kernels.encode(matrix(b.column(vector), config.dim), config)
            out = [b.column(c) for c in rest]
            for p in passes:
                out += [lists(got["codes" + p].astype(np.int8), pa.int8()), pa.array(got["scale" + p], pa.float32())]
            yield pa.RecordBatch.from_arrays(out, [*rest, *(x + p for p in passes for x in ("codes", "scale"))])

    return df.select(*rest, vector).mapInArrow(run, schema)


def encode_in_sql(df: DataFrame, config: IndexConfig, vector: str = "embedding") -> DataFrame:
    """The same, in expressions that Catalyst sees; codes are integers."""
    return expressions.encoded(df, config, vector).drop(vector)
