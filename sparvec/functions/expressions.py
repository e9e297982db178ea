"""The same functions as Spark expressions, in the same order of operations.

Division and square root return doubles in Spark; a double result of float operands, cast back, is the correctly rounded float.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import IndexConfig
from . import kernels
from .constants import BOUNDARIES, CENTROIDS, FLOOR


def floats(values) -> Column:
    return F.expr("array(" + ", ".join(f"CAST({float(v)!r} AS FLOAT)" for v in values) + ")")


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def total(terms: Column) -> Column:
    return F.aggregate(terms, f32(0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return f32(F.sqrt(F.aggregate(v, f32(0), lambda a, x: a + x * x)))


def truncate(v: Column, config: IndexConfig) -> Column:
    return F.slice(v, 1, config.working_dim)


def checked(v: Column, config: IndexConfig) -> Column:
    """The vector, or an error for a row of another length, with a missing or infinite value, or zero."""
    bad = F.size(v) != config.dim
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(v.isNull() | bad, F.raise_error(F.lit(f"vectors must have {config.dim} values")))
        .when(odd, F.raise_error(F.lit("vectors must be finite")))
        .when(norm(truncate(v, config)) == 0, F.raise_error(F.lit("a vector is zero in its leading coordinates")))
        .otherwise(v)
    )


def normalize(v: Column) -> Column:
    return F.transform(v, lambda x: f32(x / norm(v)))


def signs(config: IndexConfig) -> Column:
    return floats(kernels.sign_stream(config.seed, config.padded))


def pad(v: Column, config: IndexConfig) -> Column:
    missing = config.padded - config.working_dim
    return F.concat(v, F.array_repeat(f32(0), missing)) if missing else v


def hadamard(v: Column, padded: int) -> Column:
    steps = [1 << k for k in range(padded.bit_length() - 1)]
    if not steps:
        return v
    places = F.sequence(F.lit(0), F.lit(padded - 1))

    def butterfly(x: Column, h: Column) -> Column:
        return F.transform(places, lambda i: F.when(i.bitwiseAND(h) == 0, F.get(x, i) + F.get(x, i + h)).otherwise(F.get(x, i - h) - F.get(x, i)))

    return F.aggregate(F.array(*map(F.lit, steps)), v, butterfly)


def quantize(x: Column, bits: int) -> Column:
    return F.size(F.filter(floats(BOUNDARIES[bits]), lambda b: x > b))


def dequantize(code: Column, bits: int) -> Column:
    return F.get(floats(CENTROIDS[bits]), code)


def signature(codes: Column) -> Column:
    return F.transform(codes, lambda c: F.shiftright(c, 2))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return f32(dot(a, b) / f32(norm(a) * norm(b)))


def raw_score(codes: Column, q: Column, bits: int, padded: int) -> Column:
    table = floats(CENTROIDS[bits])
    term = lambda i: F.get(q, i) * F.get(table, F.get(codes, i))
    along = lambda start, stop, step: F.sequence(F.lit(start), F.lit(stop - 1), F.lit(step))
    if bits != 4:
        lanes = [F.aggregate(along(k, padded, 4), f32(0), lambda a, i: a + term(i)) if k < padded else f32(0) for k in range(4)]
        return (lanes[0] + lanes[1]) + (lanes[2] + lanes[3])
    pair = (lambda b: term(b * 2) + term(b * 2 + 1)) if padded > 1 else (lambda b: term(b * 2))
    n = max(1, padded // 2)
    blocks = n // 8 * 8
    acc = [F.aggregate(along(k, blocks, 8), f32(0), lambda a, b: a + pair(b)) if blocks else f32(0) for k in range(8)]
    tail = F.aggregate(along(blocks, n, 1), f32(0), lambda a, b: a + pair(b)) if blocks < n else f32(0)
    return ((acc[0] + acc[1]) + (acc[2] + acc[3])) + ((acc[4] + acc[5]) + (acc[6] + acc[7])) + tail


def rotated(df, config: IndexConfig, vector: str = "embedding", check: bool = True):
    """df with ``rotated``; intermediate columns keep each step evaluated once a row."""
    v = F.col(vector)
    df = df.withColumn("__v", truncate(checked(v, config) if check else v, config)).withColumn("__n", norm(F.col("__v")))
    unit = F.transform("__v", lambda x: f32(x / F.col("__n")))
    return df.withColumn("rotated", hadamard(F.zip_with(pad(unit, config), signs(config), lambda a, s: a * s), config.padded)).drop("__v", "__n")


def encoded(df, config: IndexConfig, vector: str = "embedding"):
    """df with ``codes`` and ``scale`` (and ``codes2`` and ``scale2``)."""
    bits, one = config.bits, F.lit(1.0)
    df = rotated(df, config, vector).withColumn("codes", F.transform("rotated", lambda x: quantize(x, bits)))
    df = df.withColumn("__d0", F.transform("codes", lambda c: dequantize(c, bits)))
    df = df.withColumn("__root", f32(F.sqrt(total(F.transform("__d0", lambda d: d * d)))))
    if not config.residual:
        return df.withColumn("scale", f32(one / F.col("__root"))).drop("rotated", "__d0", "__root")
    df = df.withColumn("__sq", total(F.transform("__d0", lambda d: d * d)))
    df = df.withColumn("__e", F.zip_with("rotated", "__d0", lambda r, d: r - d))
    df = df.withColumn("__rms", f32(F.sqrt(F.greatest(f32(total(F.transform("__e", lambda e: e * e)) / config.padded), f32(FLOOR)))))
    df = df.withColumn("codes2", F.transform("__e", lambda e: quantize(f32(e / F.col("__rms")), 4)))
    df = df.withColumn("__d1", F.transform("codes2", lambda c: dequantize(c, 4)))
    rms = F.col("__rms")
    both = F.col("__sq") + f32(2) * rms * dot(F.col("__d0"), F.col("__d1")) + rms * rms * total(F.transform("__d1", lambda d: d * d))
    df = df.withColumn("__den", f32(F.sqrt(F.greatest(both, f32(FLOOR)))))
    df = df.withColumn("scale", f32(f32(f32(one / F.col("__root")) * F.col("__root")) / F.col("__den"))).withColumn("scale2", f32(rms / F.col("__den")))
    return df.drop("rotated", "__d0", "__root", "__sq", "__e", "__rms", "__d1", "__den")


def score(config: IndexConfig, q: Column, prefix: str = "") -> Column:
    """The estimated cosine of a row (codes, scale, ...) with a prepared query."""
    s = raw_score(F.col(prefix + "codes"), q, config.bits, config.padded) * F.col(prefix + "scale")
    if config.residual:
        s = s + raw_score(F.col(prefix + "codes2"), q, 4, config.padded) * F.col(prefix + "scale2")
    return s
