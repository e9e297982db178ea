"""The quantiser as SQL functions of a session, on Arrow batches through the kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..operators.workers import reach
from . import kernels

NAMES = ("vq_rotate", "vq_quantize", "vq_encode", "vq_prepare", "vq_score", "vq_signature", "vq_l1_2bit", "vq_cosine")


def rows(column: pd.Series, kind: type = np.float32) -> np.ndarray:
    return np.array(list(column), kind) if len(column) else np.zeros((0, 0), kind)


def register(spark: SparkSession, config: IndexConfig) -> None:
    """Register NAMES for a configuration; registering again replaces them.

    vq_rotate(v): rotated coordinates. vq_quantize(rotated): codes. vq_encode(v): a struct of codes and scale (and codes2, scale2). vq_prepare(v): a query.
    vq_score(encoded, query): the estimated cosine. vq_signature(codes), vq_l1_2bit(signature, signature): the first stage of a two-stage search.
    vq_cosine(a, b): the exact cosine. Vectors must have config.dim finite values, not all zero; other rows are errors, null ones included.
    """
    reach(spark)
    passes = ("", "2") if config.residual else ("",)
    encoded = "struct<" + ",".join(f"codes{p}:array<tinyint>,scale{p}:float" for p in passes) + ">"

    def rotate(v: pd.Series) -> pd.Series:
        return pd.Series(list(kernels.rotate(rows(v), config)) if len(v) else [])

    def quantize(rotated: pd.Series) -> pd.Series:
        return pd.Series(list(kernels.quantize(rows(rotated), config.bits).astype(np.int8)))

    def encode(v: pd.Series) -> pd.DataFrame:
        got = kernels.encode(rows(v), config)
        return pd.DataFrame({x + p: list(got[x + p].astype(np.int8)) if x == "codes" else got[x + p] for p in passes for x in ("codes", "scale")})

    def prepare(v: pd.Series) -> pd.Series:
        return pd.Series(list(kernels.prepare(rows(v), config)[0]) if len(v) else [])

    def score(own: pd.DataFrame, query: pd.Series) -> pd.Series:
        q, total = rows(query), None
        for p in passes:
            bits = 4 if p else config.bits
            s = kernels.products_sum(kernels.dequantize(rows(own["codes" + p], np.uint8), bits) * q, bits) * own["scale" + p].to_numpy(np.float32)
            total = s if total is None else total + s
        return pd.Series(total)

    def signature(codes: pd.Series) -> pd.Series:
        return pd.Series(list(kernels.signature(rows(codes, np.uint8)).astype(np.int8)))

    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.abs(rows(a, np.int64) - rows(b, np.int64)).sum(axis=1) if len(a) else [], dtype=np.int64)

    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = rows(a), rows(b)
        return pd.Series(kernels.running_sum(x * y) / (kernels.norms(x) * kernels.norms(y)))

    kinds = ("array<float>", "array<tinyint>", encoded, "array<float>", "float", "array<tinyint>", "bigint", "float")
    for name, kind, fn in zip(NAMES, kinds, (rotate, quantize, encode, prepare, score, signature, distance, cosine)):
        spark.udf.register(name, F.pandas_udf(fn, kind))
