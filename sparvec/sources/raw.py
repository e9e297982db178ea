"""Raw float matrices and their metadata, and seeded synthetic vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import lists
from ..operators.workers import reach

META = "n_base int, n_query int, dim int, base_seed long, query_seed long"


def load_f32(spark: SparkSession, path: str, dim: int, n: int | None = None) -> DataFrame:
    """(path, slot, embedding) of little-endian float32 row-major files; n, where given, is each file's number of rows."""
    return parse_f32(spark.read.format("binaryFile").load(path).select("path", "content"), dim, n)


def parse_f32(files: DataFrame, dim: int, n: int | None = None) -> DataFrame:
    """The same of files (path, content) as a table; the path may be of any kind."""
    reach(files.sparkSession)

    def read(batches):
        for b in batches:
            for name, data in zip(b.column("path"), b.column("content").to_pylist()):
                if len(data) % (4 * dim) or n is not None and len(data) != 4 * dim * n:
                    raise ValueError(f"{name} doesn't hold rows of {dim} floats" + (f", {n} of them" if n is not None else ""))
                m = np.frombuffer(data, "<f4").reshape(-1, dim)
                for k in range(0, len(m), 4096):
                    part = m[k : k + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part), b.column("path").type), pa.array(range(k, k + len(part)), pa.int64()), lists(part, pa.float32())], ["path", "slot", "embedding"])

    return files.select("path", "content").mapInArrow(read, f"path {dict(files.dtypes)['path']}, slot long, embedding array<float>")


def to_f32(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(path, content): the vectors (path, slot, vector) of each path as one such file, in the order of their slots."""

    def write(part: pa.Table) -> pa.Table:
        part = part.sort_by("slot").combine_chunks()
        flat = part.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"path": part.column("path").slice(0, 1), "content": pa.array([flat.astype("<f4").tobytes()], pa.binary())})

    return vectors.select("path", "slot", vector).groupBy("path").applyInArrow(write, f"path {dict(vectors.dtypes)['path']}, content binary")


def load_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META).option("multiLine", True).json(path)


def parse_meta(texts: DataFrame, column: str = "value") -> DataFrame:
    """META of a column of JSON texts."""
    return texts.select(F.from_json(column, META).alias("m")).select("m.*")


def clustered(spark: SparkSession, n: int, dim: int, clusters: int, seed: int, spread: float) -> DataFrame:
    """(slot, embedding, label): unit vectors around seeded unit centres; made in the tasks, each row from its own seed."""
    reach(spark)

    def make(batches):
        centres = np.random.default_rng(seed).normal(size=(clusters, dim))
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        for b in batches:
            ids = b.column("id").to_numpy()
            x = np.stack([centres[i % clusters] + spread * np.random.default_rng((seed, int(i))).normal(size=dim) / dim**0.5 for i in ids]) if len(ids) else np.zeros((0, dim))
            x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists(x, pa.float32()), pa.array((ids % clusters).astype(np.int32))], ["slot", "embedding", "label"])

    return spark.range(n).mapInArrow(make, "slot long, embedding array<float>, label int").withColumn("slot", F.col("slot"))
