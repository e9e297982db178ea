"""Keyed changes from a stream: a micro-batch writes its encoded changes only, and readers merge them into the last full table.

A folder holds ``version=b`` (the whole table after batch b) and ``change=b`` (what batch b brought). Every MERGE_EVERY batches the table is
written anew, and what is older than the version before it goes; so a batch costs its own rows and a share of one rewriting, and the folder
stays bounded. A batch that runs again overwrites its own change, so each change counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import IndexConfig
from ..operators import keyed
from ..operators.encode import encode

MERGE_EVERY = 16
#: Changes are numbered within a batch; so many numbers belong to one.
BATCH_NUMBERS = 1 << 40


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _finished(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the folders of a kind that were written to the end, in order."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(kind + "=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(_folder(spark, f"{p}/_SUCCESS")[0]))


def latest(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The table after the last finished batch (or batch ``upto``), or None where there is none."""
    known = lambda kind: [n for n in _finished(spark, path, kind) if upto is None or n <= upto]
    base = max(known("version"), default=-1)
    more = [n for n in known("change") if n > base]
    if base < 0 and not more:
        return None
    changes = None
    for n in more:
        one = spark.read.parquet(f"{path}/change={n}")
        changes = one if changes is None else changes.unionByName(one)
    if base >= 0:
        slots = spark.read.parquet(f"{path}/version={base}")
    else:
        rest = [c for c in changes.columns if c not in ("seq", "key")]
        slots = changes.select(F.col("seq").alias("slot"), "key", F.col("seq").alias("key_pos"), F.lit(True).alias("alive"), *rest).filter("false")
    # batches are applied in the order of their numbers, and that is the order of seq
    return slots if changes is None else keyed.add_keyed(slots, changes)


def _expire(spark: SparkSession, path: str, version: int) -> None:
    """Delete what no reader of this version or the one before it needs."""
    at, fs = _folder(spark, path)
    older = [n for n in _finished(spark, path, "version") if n < version]
    keep = max(older, default=-1)
    for kind, last in (("version", keep - 1), ("change", keep)):
        for n in _finished(spark, path, kind):
            if n <= last:
                fs.delete(_folder(spark, f"{path}/{kind}={n}")[0], True)


def upsert_stream(changes: DataFrame, config: IndexConfig, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that applies a stream of (seq, key, embedding) as inserts and replacements; a null key is an anonymous vector."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = keyed.numbered(batch.select("seq", F.col("key").cast(keyed.KEY).alias("key"), "embedding"), "seq", "place")
        new = encode(new.select((F.col("place") + number * BATCH_NUMBERS).alias("seq"), "key", "embedding"), config)
        new.write.mode("overwrite").parquet(f"{path}/change={number}")
        if (number + 1) % MERGE_EVERY == 0:
            latest(spark, path, number).write.mode("overwrite").parquet(f"{path}/version={number}")
            _expire(spark, path, number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
