from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparvec.config import IndexConfig
from sparvec.functions import constants, kernels


def clustered(n, dim, clusters, seed, spread):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(clusters, dim))
    x = c[np.arange(n) % clusters] / np.linalg.norm(c[np.arange(n) % clusters], axis=1, keepdims=True) + spread * rng.normal(size=(n, dim)) / dim**0.5
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("bits", [4, 5, 6])
def test_codebooks_are_sorted_and_interleaved(bits):
    c, b = constants.centroids(bits), constants.boundaries(bits)
    assert len(c) == constants.levels(bits) == 2**bits and len(b) == len(c) - 1
    assert (np.diff(c) > 0).all() and (np.diff(b) > 0).all()
    assert (c[:-1] < b).all() and (b < c[1:]).all()


@pytest.mark.parametrize("bits", [4, 5, 6])
def test_a_value_on_a_boundary_gets_the_lower_code(bits):
    b = constants.boundaries(bits)
    assert (kernels.quantize(b, bits) == np.arange(len(b))).all()
    assert (kernels.quantize(np.nextafter(b, np.float32(9)), bits) == np.arange(1, len(b) + 1)).all()


def test_other_widths_are_errors():
    for bits in (2, 3, 7, 8):
        with pytest.raises(ValueError):
            constants.centroids(bits)
        with pytest.raises(ValueError):
            IndexConfig(8, bits=bits)


@pytest.mark.parametrize("bad", [dict(dim=0), dict(dim=8, working_dim=0), dict(dim=8, working_dim=9), dict(dim=70_001, working_dim=70_000), dict(dim=8, bits=5, residual=True), dict(dim=8, bits=4, residual=True, working_dim=4)])
def test_configurations_that_are_refused(bad):
    with pytest.raises(ValueError):
        IndexConfig(**bad)


def test_a_large_dimension_is_fine_when_it_is_not_truncated():
    assert IndexConfig(70_000).padded == 131_072
    assert [IndexConfig(384, bits=b).code_bytes for b in (4, 5, 6)] == [256, 320, 384]


def test_rotation_is_seeded_and_keeps_norms():
    c = IndexConfig(48, seed=7)
    x = clustered(20, 48, 5, 1, 0.5)
    r = kernels.rotate(x, c)
    assert r.shape == (20, 64) and (r == kernels.rotate(x, c)).all()
    assert not (r == kernels.rotate(x, IndexConfig(48, seed=8))).all()
    assert np.allclose(np.linalg.norm(r, axis=1), 8, atol=1e-4)


def test_seed_zero_is_the_replacement_seed():
    assert (kernels.sign_stream(0, 64) == kernels.sign_stream(constants.SEED_FOR_ZERO, 64)).all()


def test_rows_that_are_refused():
    c = IndexConfig(8)
    for x in (np.zeros((1, 8)), np.ones((1, 7)), np.full((1, 8), np.nan), np.full((1, 8), np.inf)):
        with pytest.raises(ValueError):
            kernels.encode(x.astype(np.float32), c)
    with pytest.raises(ValueError):
        kernels.encode(np.array([[0, 0, 0, 0, 1, 1, 1, 1]], np.float32), IndexConfig(8, working_dim=4))


@settings(deadline=None, max_examples=40)
@given(st.integers(1, 130), st.sampled_from([4, 5, 6]), st.integers(1, 9))
def test_packing_round_trips(padded, bits, n):
    codes = np.random.default_rng(padded).integers(0, 2**bits, (n, padded)).astype(np.uint8)
    data = kernels.pack(codes, bits)
    assert data.shape[1] == -(-padded * bits // 8) and (kernels.unpack(data, bits, padded) == codes).all()


@pytest.mark.parametrize("dim,bits", [(1, 4), (2, 4), (8, 4), (8, 5), (20, 6), (128, 4), (100, 5)])
def test_scores_equal_a_plain_walk(dim, bits):
    c = IndexConfig(dim, bits=bits)
    x = clustered(30, dim, 6, dim, 0.4)
    got, (q, _) = kernels.encode(x, c), kernels.prepare(x[:1], c)
    plain = (kernels.dequantize(got["codes"], bits).astype(float) * q[0].astype(float)).sum(1) * got["scale"]
    assert np.abs(kernels.scores(got, q[0], c) - plain).max() < 1e-5


def test_scores_are_near_exact_cosines_and_more_bits_are_nearer():
    x = clustered(200, 128, 20, 3, 0.5)
    worst = []
    for bits in (4, 5, 6):
        c = IndexConfig(128, bits=bits)
        rows = kernels.encode(x, c)
        q, _ = kernels.prepare(x[:5], c)
        worst.append(max(np.abs(kernels.scores(rows, q[i], c) - kernels.cosine(x, x[i])).max() for i in range(5)))
    assert worst[0] < 0.2 and worst[0] > worst[1] > worst[2]


def test_the_residual_pass_halves_the_error():
    x = clustered(50, 128, 10, 19, 0.5)
    r = kernels.rotate(x, IndexConfig(128))
    plain, both = kernels.encode(x, IndexConfig(128, bits=4)), kernels.encode(x, IndexConfig(128, bits=4, residual=True))
    width = np.sqrt(128)
    a = kernels.dequantize(plain["codes"], 4) * plain["scale"][:, None] * width
    b = (kernels.dequantize(both["codes"], 4) * both["scale"][:, None] + kernels.dequantize(both["codes2"], 4) * both["scale2"][:, None]) * width
    assert ((b - r) ** 2).mean() < 0.5 * ((a - r) ** 2).mean()


def test_full_working_dim_is_the_same_bits():
    x = clustered(20, 64, 4, 2, 0.5)
    a, b = kernels.encode(x, IndexConfig(64)), kernels.encode(x, IndexConfig(64, working_dim=64))
    assert all((a[k] == b[k]).all() for k in a)


def test_half_precision():
    x = np.array([1.0, 0.1, 65504.0, 6e-8, 0.12345], np.float32)
    assert (kernels.half(x) == x.astype(np.float16).astype(np.float32)).all()
    tiny = np.array([2.0**-20], np.float32)
    assert kernels.half(tiny)[0] == tiny[0] and kernels.half(tiny, True)[0] == tiny[0] / 2
