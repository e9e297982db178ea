"""What the operators of this subpackage share: reading tables, written intermediates, Arrow steps."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.workers import reach

#: Limits of an Arrow batch: texts can be long, so bytes count before rows do.
BATCH_ROWS, BATCH_BYTES = 20_000, 2 << 20
#: The driver's garbage is collected for the sake of shuffle files at most so often.
COLLECT_SECONDS = 5
_collected = -1e9


def prepare(spark: SparkSession) -> None:
    """Set what Python steps need, for the session: small Arrow batches, and a module path that reaches this package on local workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    reach(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master without it (tests) gets a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sparvec-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and a lost executor loses nothing.

    The folder goes with ``discard``, or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing that is still to run reads it; and let Spark drop the shuffles that led to it."""
    for t in tables:
        spark, path = t.sparkSession, t._written
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    global _collected
    if tables and time.monotonic() - _collected > COLLECT_SECONDS:
        _collected = time.monotonic()
        tables[0].sparkSession.sparkContext._jvm.System.gc()  # Spark deletes shuffle files when their plans are collected


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, changed as far as needed so that df has no column of any of them in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def partitions_for(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def arrow_step(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as an empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]
