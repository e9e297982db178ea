"""Single-precision kernels on batches of vectors, in a fixed order of operations.

Each sum runs from left to right in float32, one coordinate at a time over all rows of a batch; so a row's result depends neither on its batch
nor on the partitioning, and equals that of the expressions in ``expressions``.
"""

from __future__ import annotations

import numpy as np

from ..config import IndexConfig
from .constants import FLOOR, SEED_FOR_ZERO, STREAM_MULTIPLIER, STREAM_SHIFTS, boundaries, centroids

F32 = np.float32
#: Sums of all queries that share a pass.
SUMS = 1 << 16
_MASK = (1 << 64) - 1


def sign_stream(seed: int, padded: int) -> np.ndarray:
    """The diagonal of signs of a seed."""
    a, b, c = STREAM_SHIFTS
    x, out = seed or SEED_FOR_ZERO, np.empty(padded, F32)
    for i in range(padded):
        x ^= x >> a
        x = (x ^ (x << b)) & _MASK
        x ^= x >> c
        drawn = (x * STREAM_MULTIPLIER & _MASK) >> 11
        out[i] = -1.0 if drawn * 2.0**-53 < 0.5 else 1.0
    return out


def running_sum(terms: np.ndarray) -> np.ndarray:
    """Sum of each row from left to right."""
    total = np.zeros(len(terms), F32)
    for column in terms.T:
        total = total + column
    return total


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(running_sum(x * x))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, p = x.shape
    half = 1
    while half < p:
        pairs = x.reshape(n, p // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, p)
        half *= 2
    return x


def checked(x: np.ndarray, config: IndexConfig) -> np.ndarray:
    if x.ndim != 2 or x.shape[1] != config.dim:
        raise ValueError(f"vectors must have {config.dim} values")
    if not np.isfinite(x).all():
        raise ValueError("vectors must be finite")
    return np.ascontiguousarray(x, F32)


def rotate(x: np.ndarray, config: IndexConfig) -> np.ndarray:
    """Leading coordinates, scaled to norm one, padded, signed and transformed."""
    x = checked(x, config)[:, : config.working_dim]
    length = norms(x)
    if not (length > 0).all():
        raise ValueError("a vector is zero in its leading coordinates")
    unit = np.zeros((len(x), config.padded), F32)
    unit[:, : config.working_dim] = x / length[:, None]
    return hadamard(unit * sign_stream(config.seed, config.padded))


def quantize(x: np.ndarray, bits: int) -> np.ndarray:
    """Number of boundaries strictly below each value."""
    return np.searchsorted(boundaries(bits), x, side="left").astype(np.uint8)


def dequantize(codes: np.ndarray, bits: int) -> np.ndarray:
    return centroids(bits)[codes]


def encode(x: np.ndarray, config: IndexConfig) -> dict[str, np.ndarray]:
    """codes and scale, and with a residual pass codes2 and scale2."""
    r = rotate(x, config)
    first = quantize(r, config.bits)
    d0 = dequantize(first, config.bits)
    square = running_sum(d0 * d0)
    one = F32(1)
    if not config.residual:
        return {"codes": first, "scale": one / np.sqrt(square)}
    rest = r - d0
    rms = np.sqrt(np.maximum(running_sum(rest * rest) / F32(config.padded), F32(FLOOR)))
    second = quantize(rest / rms[:, None], 4)
    d1 = dequantize(second, 4)
    both = square + F32(2) * rms * running_sum(d0 * d1) + rms * rms * running_sum(d1 * d1)
    denominator = np.sqrt(np.maximum(both, F32(FLOOR)))
    root = np.sqrt(square)
    return {"codes": first, "scale": one / root * root / denominator, "codes2": second, "scale2": rms / denominator}


def prepare(q: np.ndarray, config: IndexConfig) -> tuple[np.ndarray, np.ndarray]:
    """Rotated queries of norm one, and the norms that they had."""
    r = rotate(q, config)
    length = norms(r)
    return r / length[:, None], length


def products_sum(products: np.ndarray, bits: int) -> np.ndarray:
    """Sums of the rows of products, in the order of a width: four lanes, or for 4 bits eight buckets of pairs and a tail."""
    n, p = products.shape
    if bits != 4:
        lanes = np.zeros((n, 4), F32)
        whole = p // 4 * 4
        for i in range(0, whole, 4):
            lanes = lanes + products[:, i : i + 4]
        for i in range(whole, p):
            lanes[:, i % 4] = lanes[:, i % 4] + products[:, i]
        return (lanes[:, 0] + lanes[:, 1]) + (lanes[:, 2] + lanes[:, 3])
    if p % 2:
        products = np.concatenate([products, np.zeros((n, 1), F32)], axis=1)
    terms = products[:, 0::2] + products[:, 1::2]  # one for each byte of two codes
    blocks = terms.shape[1] // 8 * 8
    acc, tail = np.zeros((n, 8), F32), np.zeros(n, F32)
    for i in range(0, blocks, 8):
        acc = acc + terms[:, i : i + 8]
    for i in range(blocks, terms.shape[1]):
        tail = tail + terms[:, i]
    a = acc.T
    return ((a[0] + a[1]) + (a[2] + a[3])) + ((a[4] + a[5]) + (a[6] + a[7])) + tail


def together(n: int) -> int:
    """How many queries share a pass over the columns of n rows, so that their sums stay in cache and few rows are worth a pass."""
    return max(1, SUMS // max(1, n))


def column_scores(columns: np.ndarray, qs: np.ndarray, bits: int) -> np.ndarray:
    """The same sums from columns of decoded codes (one row a coordinate), which stay in cache: the fast way for many queries, one a row of the result."""
    p, n = columns.shape
    m = len(qs)
    along = np.ascontiguousarray(qs.T)[:, :, None]
    part, term = np.empty((m, n), F32), np.empty((m, n), F32)
    if bits != 4:
        lanes = np.zeros((4, m, n), F32)
        for i in range(p):
            np.multiply(columns[i], along[i], out=part)
            lanes[i % 4] += part
        return (lanes[0] + lanes[1]) + (lanes[2] + lanes[3])
    pairs = (p + 1) // 2
    blocks = pairs // 8 * 8
    acc, tail = np.zeros((8, m, n), F32), np.zeros((m, n), F32)
    for b in range(pairs):
        np.multiply(columns[2 * b], along[2 * b], out=term)
        if 2 * b + 1 < p:
            np.multiply(columns[2 * b + 1], along[2 * b + 1], out=part)
            term += part
        if b < blocks:
            acc[b % 8] += term
        else:
            tail += term
    return ((acc[0] + acc[1]) + (acc[2] + acc[3])) + ((acc[4] + acc[5]) + (acc[6] + acc[7])) + tail


def column_sums(columns: np.ndarray, qs: np.ndarray) -> np.ndarray:
    """Inner products from columns, each in one running sum; one query a row of the result."""
    n = columns.shape[1]
    along = np.ascontiguousarray(qs.T)[:, :, None]
    part, total = np.empty((len(qs), n), F32), np.zeros((len(qs), n), F32)
    for column, x in zip(columns, along):
        np.multiply(column, x, out=part)
        total += part
    return total


def raw_scores(codes: np.ndarray, q: np.ndarray, bits: int) -> np.ndarray:
    """Inner products of each row's centroids with one prepared query."""
    return products_sum(dequantize(codes, bits) * q[None, :], bits)


def scores(rows: dict[str, np.ndarray], q: np.ndarray, config: IndexConfig) -> np.ndarray:
    """Estimated cosines of encoded rows with one prepared query."""
    s = raw_scores(rows["codes"], q, config.bits) * rows["scale"]
    if config.residual:
        s = s + raw_scores(rows["codes2"], q, 4) * rows["scale2"]
    return s


def signature(codes: np.ndarray) -> np.ndarray:
    """Two bits of each 4-bit code."""
    return codes >> 2


def query_signature(q: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of prepared queries: a division and a multiplication apart from the rotation, which can differ by one step."""
    return quantize(q * length[:, None], 4) >> 2


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact cosines of the rows of a with one vector b."""
    return running_sum(a * b[None, :]) / (norms(a) * np.sqrt(running_sum((b * b)[None, :])))


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes as bytes, the lowest bit first."""
    planes = (codes[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(len(codes), -1), axis=1, bitorder="little")


def unpack(data: np.ndarray, bits: int, padded: int) -> np.ndarray:
    planes = np.unpackbits(data, axis=1, bitorder="little")[:, : bits * padded].reshape(len(data), padded, bits)
    return (planes << np.arange(bits, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def half(x: np.ndarray, halved_subnormals: bool = False) -> np.ndarray:
    """float32 through half precision and back. halved_subnormals: as readers that decode subnormals to half their value."""
    h = x.astype(np.float16)
    out = h.astype(F32)
    if halved_subnormals:
        out = np.where(np.abs(out) < F32(2.0**-14), out * F32(0.5), out)
    return out
