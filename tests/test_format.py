from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparvec.config import IndexConfig
from sparvec.functions import kernels
from sparvec.functions.constants import VERSIONS
from sparvec.operators import search
from sparvec.operators.encode import encode
from sparvec.sources import format as fmt
from sparvec.sources import raw
from test_kernels import clustered

CONFIGS = [IndexConfig(16, seed=3, bits=4), IndexConfig(16, bits=5), IndexConfig(20, bits=6, working_dim=9), IndexConfig(16, bits=4, residual=True)]


def made(c, n=12, keys=True):
    x = clustered(n, c.dim, 4, 1, 0.5)
    return fmt.Shard(c, "", kernels.encode(x, c), {i: i + 2**63 for i in range(0, n, 2)} if keys else {})


@pytest.mark.parametrize("c", CONFIGS)
def test_round_trip_is_byte_identical(c):
    data = fmt.to_bytes(made(c))
    got = fmt.from_bytes(data)
    assert got.config == c and got.keys == made(c).keys and fmt.to_bytes(got) == data
    assert got.version == ("1.4" if c.residual else "1.3" if c.bits == 4 else "1.5")
    assert (got.rows["codes"] == made(c).rows["codes"]).all()
    assert (got.rows["scale"] == kernels.half(made(c).rows["scale"])).all()
    assert fmt.from_bytes(data, view=True).keys == {}


@pytest.mark.parametrize("c", CONFIGS)
def test_every_truncation_is_an_error(c):
    data = fmt.to_bytes(made(c, 3))
    for n in range(len(data)):
        for view in (False, True):
            with pytest.raises(fmt.FormatError) as e:
                fmt.from_bytes(data[:n], view)
            assert e.value.kind == ("NotAStableFile" if view and n < fmt.HEADER.size else "Truncated")


def test_old_versions_and_bad_files():
    data = bytearray(fmt.to_bytes(made(CONFIGS[0], 3, keys=False)))
    body = bytes(data[: -4])
    for version in ("1.1", "1.2"):
        data[4:6] = struct.pack("<H", VERSIONS[version])
        assert fmt.from_bytes(bytes(data[:-4])).version == version
    with pytest.raises(fmt.FormatError, match="UnsupportedVersion"):
        fmt.from_bytes(body[:4] + struct.pack("<H", VERSIONS["1.1"]) + body[6:], view=True)
    rows = made(CONFIGS[0], 3).rows
    one = body[:4] + struct.pack("<H", 1) + body[6:24] + rows["scale"].astype("<f4").tobytes() + kernels.pack(rows["codes"], 4).tobytes()
    assert (fmt.from_bytes(one).rows["scale"] == rows["scale"]).all()
    for bad, kind in (
        (b"garbage" * 9, "NotAStableFile"),
        (body[:4] + struct.pack("<H", 999) + body[6:], "UnsupportedVersion"),
        (body[:6] + struct.pack("<H", 17) + body[8:] + b"\0" * 4, "InvalidWorkingDim"),
        (body[:8] + b"\0" * 4 + body[12:], "InvalidHeader"),
    ):
        with pytest.raises(fmt.FormatError, match=kind):
            fmt.from_bytes(bad)
    for table in (struct.pack("<IIQ", 1, 3, 7), struct.pack("<IIQIQ", 2, 1, 7, 1, 8)):
        for view in (False, True):
            with pytest.raises(fmt.FormatError, match="InvalidKeyTable"):
                fmt.from_bytes(body + table, view)
    wide = bytearray(fmt.to_bytes(made(CONFIGS[1], 3)))
    wide[24] = 7
    with pytest.raises(fmt.FormatError, match="InvalidWidth"):
        fmt.from_bytes(bytes(wide))


@pytest.mark.parametrize("c", CONFIGS)
def test_blobs_of_shards(spark, c):
    x = clustered(50, c.dim, 5, 2, 0.5)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "slot long, embedding array<float>")
    slots = encode(df, c).withColumn("key", F.when(F.col("slot") > 9, F.col("slot") * 3)).withColumn("alive", F.col("slot") != 4)
    blobs = fmt.to_blobs(slots, c, 20)
    got = fmt.from_blobs(blobs).orderBy("shard", "slot").collect()
    assert [sum(r["shard"] == k for r in got) for k in range(3)] == [19, 20, 10]
    assert [int(r["key"]) for r in got if r["shard"] == 1] == [i * 3 for i in range(20, 40)]
    whole = fmt.table_slots(blobs).orderBy("slot").collect()
    assert [r["slot"] for r in whole] == list(range(49)) and [r[:1] + r[2:] for r in whole] == [r[:1] + r[2:] for r in got]
    again = fmt.upsert_blobs(blobs, blobs.filter("shard = 1"))
    assert again.count() == 3


def test_files_tables_and_raw_matrices(spark, tmp_path):
    c = IndexConfig(16)
    x = clustered(40, 16, 5, 2, 0.5)
    (tmp_path / "raw").mkdir()
    x.astype("<f4").tofile(tmp_path / "raw" / "base.f32")
    df = raw.load_f32(spark, str(tmp_path / "raw"), 16, 40).drop("path")
    assert np.array_equal(np.array([r["embedding"] for r in df.orderBy("slot").collect()], np.float32), x)
    with pytest.raises(Exception):  # noqa: B017
        raw.load_f32(spark, str(tmp_path / "raw"), 16, 41).collect()
    (tmp_path / "meta.json").write_text('{"n_base": 40, "n_query": 2, "dim": 16, "base_seed": 1, "query_seed": 2}')
    assert tuple(raw.load_meta(spark, str(tmp_path / "meta.json")).first()) == (40, 2, 16, 1, 2)
    slots = encode(df, c)
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a").write_bytes(bytes(fmt.to_blobs(slots, c).first()["blob"]))
    queries = df.filter("slot < 3").withColumnRenamed("slot", "qid")
    seen = search.search(fmt.read_files(spark, str(tmp_path / "files"), view=True), queries, c, 3)
    assert {(r["qid"], r["slot"]) for r in seen.filter("rank = 1").collect()} == {(i, i) for i in range(3)}
    fmt.write_table(slots, c, str(tmp_path / "table"))
    back, config = fmt.read_table(spark, str(tmp_path / "table"))
    assert config == c and back.count() == 40
    assert raw.clustered(spark, 30, 8, 3, 1, 0.1).repartition(3).count() == 30
