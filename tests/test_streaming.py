from __future__ import annotations

from pyspark.sql import functions as F

from sparvec.config import IndexConfig
from sparvec.streaming import upsert
from test_kernels import clustered


def test_micro_batches_upsert_once(spark, tmp_path):
    x = clustered(12, 8, 3, 1, 0.5)
    source, schema = str(tmp_path / "in"), "seq long, key long, embedding array<float>"
    at = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    at([(i, i, [float(v) for v in x[i]]) for i in range(6)])
    run = lambda: upsert.upsert_stream(spark.readStream.schema(schema).parquet(source), IndexConfig(8), str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    run()
    first = upsert.latest(spark, str(tmp_path / "index"))
    assert first.count() == 6
    at([(10 + i, 4 + i, [float(v) for v in x[6 + i]]) for i in range(4)])
    run()
    second = upsert.latest(spark, str(tmp_path / "index"))
    assert [(r["slot"], int(r["key"])) for r in second.orderBy("slot").collect()] == [(i, i) for i in range(8)]
    a, b = ({r["slot"]: r["codes"] for r in d.collect()} for d in (first, second))
    assert a[3] == b[3] and a[4] != b[4]
    assert second.filter(~F.col("alive")).isEmpty()


def test_versions_are_merged_and_expire(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upsert, "MERGE_EVERY", 2)
    x = clustered(30, 8, 3, 1, 0.5)
    source, index, schema = str(tmp_path / "in"), str(tmp_path / "index"), "seq long, key long, embedding array<float>"
    want: dict = {}
    for batch in range(6):
        rows = [(3 * i + 1, None if i == 3 else (batch * 2 + i) % 7, [float(v) for v in x[batch * 4 + i]]) for i in range(4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        upsert.upsert_stream(spark.readStream.schema(schema).parquet(source), IndexConfig(8), index, str(tmp_path / "check")).awaitTermination()
        for s, k, _ in rows:
            want.setdefault(k if k is not None else (batch, s), len(want))
    got = upsert.latest(spark, index).orderBy("slot").collect()
    assert [r["slot"] for r in got] == list(range(len(want)))
    assert [None if r["key"] is None else int(r["key"]) for r in got] == [k if isinstance(k, int) else None for k in want]
    assert upsert._finished(spark, index, "version") == [3, 5] and upsert._finished(spark, index, "change") == [4, 5]
    # a batch that runs again changes nothing
    assert sorted(map(repr, upsert.latest(spark, index, 5).collect())) == sorted(map(repr, got))
