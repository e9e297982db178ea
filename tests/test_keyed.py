from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparvec.operators import keyed

BIG = 2**64 - 1


@pytest.fixture()
def base(spark):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "slot long, val string")
    return keyed.table_of(rows, "slot", F.expr("CASE WHEN slot < 4 THEN CAST(slot * 10 AS DECIMAL(20, 0)) END"))


def changes(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(s, Decimal(k), v) for s, k, v in rows], "seq long, key decimal(20,0), val string")


def dump(df):
    return [(r["slot"], None if r["key"] is None else int(r["key"]), r["key_pos"], r["alive"], r["val"]) for r in df.orderBy("slot").collect()]


def test_insert_and_replace_last_write_wins(spark, base):
    got = dump(keyed.add_keyed(base, changes(spark, [(1, 10, "a"), (2, 77, "b"), (3, 10, "c"), (4, BIG, "d"), (5, 77, "e")])))
    assert got[1] == (1, 10, 0, True, "c") and got[6:] == [(6, 77, 0, True, "e"), (7, BIG, 0, True, "d")] and len(got) == 8


def test_a_removed_key_comes_back_in_a_new_slot(spark, base):
    gone = keyed.remove_keyed(base, changes(spark, [(1, 20, "")]))
    assert dump(gone)[2] == (2, None, None, False, "v2")
    assert not keyed.contains_key(gone, changes(spark, [(1, 20, "")])).first()["found"]
    back = dump(keyed.add_keyed(gone, changes(spark, [(1, 20, "new")])))
    assert back[2][3] is False and back[6] == (6, 20, 0, True, "new")


def test_lists_of_slots(spark, base):
    many = keyed.add_keyed_multi(base, changes(spark, [(1, 10, "x"), (2, 10, "y")]))
    assert [r[:3] for r in dump(many) if r[1] == 10] == [(1, 10, 0), (6, 10, 1), (7, 10, 2)]
    less = keyed.remove_keyed_at(many, 10, 1)
    assert [(r["slot"], r["key_pos"]) for r in less.filter("key = 10").orderBy("key_pos").collect()] == [(7, 0), (6, 1)]
    assert keyed.primary(less).filter("key = 10").first()["slot"] == 7
    assert dump(keyed.remove_keyed_at(less, 10, 3)) == dump(less) == dump(keyed.remove_keyed_at(less, 11, 6))
    dense = keyed.compact(less)
    assert keyed.primary(dense).filter("key = 10").first()["slot"] == 5 and dense.count() == 7
    assert dump(keyed.add_keyed(less, changes(spark, [(1, 10, "z")])))[7][4] == "z"


@pytest.mark.parametrize("old,new,done", [(10, 99, True), (10, 20, False), (98, 99, False), (10, 10, True), (98, 98, False)])
def test_relabel(spark, base, old, new, done):
    df, verdict = keyed.relabel(base, old, new)
    assert verdict.first()["done"] is done
    assert (dump(df) == dump(base)) == (not done or old == new)


def test_anonymous_slots_and_lookups(spark, base):
    more = keyed.add(base, changes(spark, [(1, 1, "p"), (2, 2, "q")]).drop("key"))
    assert [r[:2] for r in dump(more)][6:] == [(6, None), (7, None)]
    got = keyed.key_of(more, spark.createDataFrame([(1,), (5,), (70,)], "slot long"))
    assert {r["slot"]: r["key"] and int(r["key"]) for r in got.collect()} == {1: 10, 5: None, 70: None}
    s = keyed.stats(keyed.remove_keyed(more, changes(spark, [(1, 0, "")]))).first()
    assert tuple(s) == (8, 7, 1, 3)


def test_compacting_nothing_and_everything(spark, base):
    assert dump(keyed.compact(base)) == dump(base)
    assert dump(keyed.compact(base.withColumn("alive", F.lit(False)))) == []
    none = base.filter("false")
    assert dump(keyed.add_keyed(none, changes(spark, [(1, 5, "a")]))) == [(0, 5, 0, True, "a")]


def test_vectors_without_a_key_all_get_slots(spark, base):
    rows = spark.createDataFrame([(1, None, "a"), (5, 10, "b"), (9, None, "c"), (7, 88, "d")], "seq long, key long, val string")
    got = dump(keyed.add_keyed(base, rows))
    assert got[1][4] == "b" and got[6:] == [(6, None, None, True, "a"), (7, 88, 0, True, "d"), (8, None, None, True, "c")]
    many = dump(keyed.add_keyed_multi(base, rows))
    assert many[6:] == [(6, None, None, True, "a"), (7, 10, 1, True, "b"), (8, 88, 0, True, "d"), (9, None, None, True, "c")]
    assert [r[3] for r in dump(keyed.remove_keyed(base, spark.createDataFrame([(None,), (10,)], "key long")))] == [True, False, True, True, True, True]


@pytest.mark.parametrize("blocks", [4, 1024])
def test_numbers_follow_any_sequence(spark, blocks, monkeypatch):
    monkeypatch.setattr(keyed, "BLOCKS", blocks)
    values = [(-1) ** i * (i * 7919**3 % 2**61) for i in range(1, 3000)] + [2**63 - 1, -(2**63), 0]
    got = keyed.numbered(spark.createDataFrame([(v,) for v in values], "seq long").repartition(7), "seq", "n").collect()
    assert {r["seq"]: r["n"] for r in got} == {v: i for i, v in enumerate(sorted(values))}
    assert keyed.numbered(spark.range(0).withColumnRenamed("id", "seq"), "seq", "n").count() == 0
    plan = keyed.numbered(spark.range(5000).withColumnRenamed("id", "seq"), "seq", "n")
    assert plan.agg(F.max("n"), F.countDistinct("n")).first()[:] == (4999, 5000)
