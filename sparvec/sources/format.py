"""The binary index file: a codec, and DataFrame readers and writers around it.

Little-endian: magic, version, reserved (working_dim, 0 for dim), dim, seed, count, in version 1.5 the width; scales; codes; in 1.4 scales and codes of
the second pass; from 1.3 on a key table of (slot, key). Scales are float32 in version 1 and half precision later.
A file holds one shard; a table is written as shards of bounded size, each made and read in one task.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import IndexConfig
from ..functions import kernels
from ..functions.constants import MAGIC, VERSIONS
from ..operators.encode import lists, matrix
from ..operators.search import decimals
from ..operators.workers import reach

SHARD_ROWS = 100_000
HEADER = struct.Struct("<4sHHIQI")
NAMES = {v: k for k, v in VERSIONS.items()}


class FormatError(ValueError):
    """kind: NotAStableFile, UnsupportedVersion, Truncated, InvalidWorkingDim, InvalidWidth, InvalidKeyTable or InvalidHeader."""

    def __init__(self, kind: str) -> None:
        super().__init__(kind)
        self.kind = kind


@dataclass
class Shard:
    config: IndexConfig
    version: str
    rows: dict[str, np.ndarray]
    keys: dict[int, int]  # by slot

    def __len__(self) -> int:
        return len(self.rows["scale"])


def _half(x: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return x.astype("<f2").tobytes()


def to_bytes(shard: Shard) -> bytes:
    """The file of a shard, whose rows are the live slots in order. The version follows from the configuration."""
    c, rows = shard.config, shard.rows
    version = "1.4" if c.residual else "1.3" if c.bits == 4 else "1.5"
    parts = [HEADER.pack(MAGIC, VERSIONS[version], 0 if c.working_dim == c.dim else c.working_dim, c.dim, c.seed, len(shard))]
    if version == "1.5":
        parts.append(bytes([c.bits]))
    for p in ("", "2") if c.residual else ("",):
        parts += [_half(rows["scale" + p]), kernels.pack(rows["codes" + p], c.bits).tobytes()]
    table = np.array(sorted(shard.keys.items()), dtype=[("slot", "<u4"), ("key", "<u8")]) if shard.keys else np.zeros(0, dtype=[("slot", "<u4"), ("key", "<u8")])
    return b"".join([*parts, struct.pack("<I", len(table)), table.tobytes()])


def from_bytes(data: bytes, view: bool = False, halved_subnormals: bool = False) -> Shard:
    """Parse any version. view: as the keyless reader of versions from 1.2 on does; its keys are checked but left out."""
    if len(data) < HEADER.size:
        raise FormatError("NotAStableFile" if view else "Truncated")
    magic, number, reserved, dim, seed, count = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise FormatError("NotAStableFile")
    if number not in NAMES or view and number < VERSIONS["1.2"]:
        raise FormatError("UnsupportedVersion")
    if not dim:
        raise FormatError("InvalidHeader")
    working = reserved if number >= VERSIONS["1.2"] and reserved else dim
    if working > dim:
        raise FormatError("InvalidWorkingDim")
    at, bits = HEADER.size, 4
    if number == VERSIONS["1.5"]:
        if len(data) <= at:
            raise FormatError("Truncated")
        bits, at = data[at], at + 1
        if bits not in (4, 5, 6):
            raise FormatError("InvalidWidth")
    residual = number == VERSIONS["1.4"]
    try:
        config = IndexConfig(dim, seed, working, bits, residual)
    except ValueError:
        raise FormatError("InvalidHeader") from None

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise FormatError("Truncated")
        at += n
        return data[at - n : at]

    def scales() -> np.ndarray:
        if number == VERSIONS["1"]:
            return np.frombuffer(take(4 * count), "<f4").astype(np.float32)
        h = np.frombuffer(take(2 * count), "<f2")
        return kernels.half(h.astype(np.float32), halved_subnormals)

    rows = {}
    for p in ("", "2") if residual else ("",):
        rows["scale" + p] = scales()
        rows["codes" + p] = kernels.unpack(np.frombuffer(take(count * config.code_bytes), np.uint8).reshape(count, config.code_bytes), bits, config.padded)
    keys: dict[int, int] = {}
    if number >= VERSIONS["1.3"]:
        entries = struct.unpack("<I", take(4))[0]
        table = np.frombuffer(take(12 * entries), dtype=[("slot", "<u4"), ("key", "<u8")])
        if (table["slot"] >= count).any() or len(np.unique(table["slot"])) != entries:
            raise FormatError("InvalidKeyTable")
        keys = {} if view else dict(zip(table["slot"].tolist(), table["key"].tolist()))
    return Shard(config, NAMES[number], rows, keys)


def to_blobs(slots: DataFrame, config: IndexConfig, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, dim, seed, blob): the live slots of each run of shard_rows slots as one file."""
    reach(slots.sparkSession)
    passes = ("", "2") if config.residual else ("",)
    cols = [x + p for p in passes for x in ("codes", "scale")]
    live = (slots.filter("alive") if "alive" in slots.columns else slots).withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("long"))
    live = live.withColumn("key", F.col("key").cast("decimal(20,0)") if "key" in slots.columns else F.lit(None).cast("decimal(20,0)"))

    def write(part: pa.Table) -> pa.Table:
        part = part.sort_by("slot").combine_chunks()
        b = part.to_batches()[0]
        rows = {}
        for p in passes:
            rows["codes" + p] = matrix(b.column("codes" + p), config.padded).astype(np.uint8)
            rows["scale" + p] = b.column("scale" + p).to_numpy(zero_copy_only=False)
        keys = {i: int(k) for i, k in enumerate(b.column("key").to_pylist()) if k is not None}
        blob = to_bytes(Shard(config, "", rows, keys))
        return pa.table({"shard": pa.array([b.column("shard")[0].as_py()], pa.int64()), "blob": pa.array([blob], pa.binary())})

    made = live.select("shard", "slot", "key", *cols).groupBy("shard").applyInArrow(write, "shard long, blob binary")
    return made.select("shard", F.lit(config.dim).alias("dim"), F.lit(config.seed).cast("decimal(20,0)").alias("seed"), "blob")


def from_blobs(blobs: DataFrame, view: bool = False, blob: str = "blob", shard: str = "shard") -> DataFrame:
    """(shard, slot, key, codes, scale, codes2, scale2) of all blobs; slots are the dense places in a blob."""
    reach(blobs.sparkSession)
    schema = f"shard {dict(blobs.dtypes)[shard]}, slot long, key decimal(20,0), codes array<tinyint>, scale float, codes2 array<tinyint>, scale2 float"

    def read(batches):
        for b in batches:
            for name, data in zip(b.column(shard), b.column(blob).to_pylist()):
                got = from_bytes(data, view)
                n = len(got)
                words, known, at = np.zeros(n, np.uint64), np.zeros(n, bool), np.array(list(got.keys), np.int64)
                words[at], known[at] = np.array(list(got.keys.values()), np.uint64), True
                for k in range(0, n, 4096):
                    part = {c: v[k : k + 4096] for c, v in got.rows.items()}
                    m = len(part["scale"])
                    key = decimals(words[k : k + m], known[k : k + m])
                    out = [pa.array([name.as_py()] * m, b.column(shard).type), pa.array(range(k, k + m), pa.int64()), key, lists(part["codes"].astype(np.int8), pa.int8()), pa.array(part["scale"])]
                    if got.config.residual:
                        out += [lists(part["codes2"].astype(np.int8), pa.int8()), pa.array(part["scale2"])]
                    else:
                        out += [pa.nulls(m, pa.list_(pa.int8())), pa.nulls(m, pa.float32())]
                    yield pa.RecordBatch.from_arrays(out, ["shard", "slot", "key", "codes", "scale", "codes2", "scale2"])

    return blobs.select(shard, blob).mapInArrow(read, schema)


def table_slots(blobs: DataFrame, view: bool = False) -> DataFrame:
    """As from_blobs for the shards of one table, with slots that are dense over all of them: those of a shard follow those of the shards before it.

    The counts come from the headers; only they, one row a shard, meet in one task.
    """
    count = F.concat(*(F.hex(F.substring("blob", k, 1)) for k in range(HEADER.size, HEADER.size - 4, -1)))
    upto = Window.orderBy(F.asc_nulls_last("shard")).rowsBetween(Window.unboundedPreceding, -1)
    counts = blobs.select("shard", F.conv(count, 16, 10).cast("long").alias("n"))
    before = counts.select(F.col("shard").alias("__shard"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__before"))
    rows = from_blobs(blobs, view)
    placed = rows.join(F.broadcast(before), F.col("shard").eqNullSafe(F.col("__shard"))).withColumn("slot", F.col("slot") + F.col("__before"))
    return placed.select(rows.columns)


def read_files(spark: SparkSession, path: str, view: bool = False) -> DataFrame:
    """All index files below a path, through Spark's own file reader; the shard is the file's path."""
    files = spark.read.format("binaryFile").load(path)
    return from_blobs(files.select(F.col("path").alias("shard"), F.col("content").alias("blob")), view=view)


def write_table(slots: DataFrame, config: IndexConfig, path: str) -> None:
    """The index as Parquet, with its configuration beside it; the form for anything larger than a shard."""
    slots.write.mode("overwrite").parquet(f"{path}/slots")
    spark = slots.sparkSession
    one = spark.range(1).select(F.lit(config.dim).alias("dim"), F.lit(config.working_dim).alias("working_dim"), F.lit(str(config.seed)).cast("decimal(20,0)").alias("seed"), F.lit(config.bits).alias("bits"), F.lit(config.residual).alias("residual"))
    one.coalesce(1).write.mode("overwrite").json(f"{path}/config")


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, IndexConfig]:
    c = spark.read.schema("dim int, working_dim int, seed decimal(20,0), bits int, residual boolean").json(f"{path}/config").first()
    return spark.read.parquet(f"{path}/slots"), IndexConfig(c["dim"], int(c["seed"]), c["working_dim"], c["bits"], c["residual"])


def upsert_blobs(table: DataFrame, new: DataFrame) -> DataFrame:
    """A blob table with the shards of new replaced or added."""
    return table.join(new.select("shard"), "shard", "left_anti").unionByName(new)
