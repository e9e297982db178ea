from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparvec.config import IndexConfig
from sparvec.functions import expressions as E
from sparvec.functions import kernels
from sparvec.operators import metrics, search
from sparvec.operators.encode import encode, encode_in_sql
from test_kernels import clustered

CONFIGS = [IndexConfig(24, bits=4), IndexConfig(24, bits=5), IndexConfig(24, bits=6, working_dim=10), IndexConfig(24, bits=4, residual=True)]


@pytest.fixture(scope="module")
def data(spark):
    x = clustered(120, 24, 12, 5, 0.5)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "slot long, embedding array<float>").cache()
    return x, df, df.filter("slot % 20 = 0").withColumnRenamed("slot", "qid")


@pytest.mark.parametrize("c", CONFIGS)
def test_expressions_and_batches_give_the_same_bits(spark, data, c):
    x, df, _ = data
    a = {r["slot"]: r for r in encode(df, c).collect()}
    b = {r["slot"]: r for r in encode_in_sql(df, c).collect()}
    want = kernels.encode(x, c)
    for i in range(len(x)):
        for name in want:
            w = want[name][i]
            got = (a[i][name], b[i][name])
            if name.startswith("codes"):
                assert list(got[0]) == list(got[1]) == w.tolist()
            else:
                assert got[0] == got[1] == float(w)


@pytest.mark.parametrize("c", CONFIGS)
def test_search_equals_a_scan_and_does_not_depend_on_partitions(spark, data, c):
    x, df, queries = data
    rows, want = kernels.encode(x, c), []
    for i in range(0, 120, 20):
        s = kernels.scores(rows, kernels.prepare(x[i : i + 1], c)[0][0], c)
        want += [(i, r + 1, int(j), float(s[j])) for r, j in enumerate(np.lexsort((np.arange(120), -s))[:7])]
    for n in (1, 4, 16):
        got = search.search(encode(df.repartition(n), c), queries, c, 7).orderBy("qid", "rank").collect()
        assert [tuple(r) for r in got] == want


def test_in_catalyst_scores_are_the_same_bits(spark, data):
    x, df, _ = data
    for c in CONFIGS:
        q, _ = kernels.prepare(x[:1], c)
        got = encode_in_sql(df, c).select("slot", E.score(c, E.floats(q[0])).alias("s")).collect()
        want = kernels.scores(kernels.encode(x, c), q[0], c)
        assert all(r["s"] == float(want[r["slot"]]) for r in got)


def test_k_is_at_least_one_and_ends_at_the_live_slots(spark, data):
    _, df, queries = data
    c = CONFIGS[1]
    slots, one = encode(df, c), queries.filter("qid = 0")
    assert search.search(slots, one, c, 0).count() == 1
    assert search.search(slots, one, c, 10_000).count() == 120
    assert search.search(slots.filter("false"), one, c, 5).count() == 0
    dead = slots.withColumn("alive", F.col("slot") > 100)
    assert {r["slot"] for r in search.search(dead, one, c, 500).collect()} == set(range(101, 120))


def test_ties_go_to_the_lower_slot(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0]) for i in (5, 3, 9, 1)], "slot long, embedding array<float>")
    c = IndexConfig(4)
    got = search.search(encode(df, c), df.filter("slot = 5").withColumnRenamed("slot", "qid"), c, 2).orderBy("rank").collect()
    assert [r["slot"] for r in got] == [1, 3]


def test_keyed_hits_are_cut_before_keys_are_merged(spark, data):
    _, df, queries = data
    c = CONFIGS[1]
    slots = encode(df, c).withColumn("key", F.when(F.col("slot") % 3 > 0, (F.col("slot") % 2)).cast("decimal(20,0)"))
    got = search.search_keyed(slots, queries, c, 6).collect()
    assert all(r["key"] is not None for r in got) and max(r["rank"] for r in got) <= 2


def test_the_two_stages(spark, data):
    _, df, queries = data
    for c in (CONFIGS[0], CONFIGS[3]):
        slots = encode(df, c)
        full = search.search(slots, queries, c, 10).orderBy("qid", "rank").collect()
        assert search.search_cascade(slots, queries, c, 10, 10_000).orderBy("qid", "rank").collect() == full
        truth = search.exact_search(df, queries, 24, 10)
        shares = [metrics.recall(search.search_cascade(slots, queries, c, 10, r), truth, 10).first()["recall_at_k"] for r in (10, 40, 120)]
        assert shares[0] <= shares[1] + 1e-9 and shares[1] <= shares[2] + 1e-9
        assert search.search_cascade(slots, queries, c, 10, 1).groupBy("qid").count().filter("count <> 10").isEmpty()
    with pytest.raises(ValueError):
        search.prefilter(encode(df, CONFIGS[1]), queries, CONFIGS[1], 5)


def test_rows_that_are_refused(spark):
    c = IndexConfig(2)
    for v in ([0.0, 0.0], [1.0], [1.0, float("nan")], [1.0, float("inf")], [1.0, None], None):
        df = spark.createDataFrame([(1, v)], "slot long, embedding array<float>")
        for way in (encode, encode_in_sql):
            with pytest.raises(Exception):  # noqa: B017
                way(df, c).collect()


def test_exact_search_of_unit_vectors_by_dot(spark, data):
    _, df, queries = data
    a = search.exact_search(df, queries, 24, 5).orderBy("qid", "rank").collect()
    b = search.exact_search(df, queries, 24, 5, dot=True).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["slot"]) for r in a] == [(r["qid"], r["slot"]) for r in b]


def test_many_query_blocks_are_joined_without_a_broadcast(spark, data, monkeypatch):
    _, df, _ = data
    monkeypatch.setattr(search, "QUERY_BLOCK", 16)
    monkeypatch.setattr(search, "BROADCAST_BLOCKS", 2)
    c = CONFIGS[1]
    got = search.search(encode(df, c), df.withColumnRenamed("slot", "qid"), c, 1)
    assert got.filter("qid <> slot").isEmpty() and got.count() == 120
