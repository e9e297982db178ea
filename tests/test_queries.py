from __future__ import annotations

import duckdb
import pytest

from sparvec.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_sql(spark, small, duck, name):
    got = plans.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    mine = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
    assert mine
    if name in plans.SQL:
        other = duck.sql(plans.SQL[name])
        assert sorted(other.columns) == columns
        assert sorted(map(repr, other.select(*columns).fetchall())) == mine


@pytest.mark.parametrize("name", ["legacy_v1_read", "parse_bytes", "parse_bytes_residual"])
def test_slots_go_on_over_all_shards(spark, small, tmp_path, name):
    duckdb.sql(f"COPY (SELECT * REPLACE (vec_id * 1000 AS vec_id) FROM '{small}/embeddings.parquet') TO '{tmp_path}/embeddings.parquet'")  # five shards
    got = plans.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    other = con.sql(plans.SQL[name])
    assert sorted(map(repr, other.select(*got.columns).fetchall())) == sorted(map(repr, (tuple(r) for r in got.collect())))


def test_entry_imports_and_names_match(spark):
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["qid", "rank", "vec_id", "score"]


def test_top_k_is_cut_before_the_exchange(spark, small):
    plan = plans.QUERIES["search_topk_5bit"](spark, small)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    scan = plans.QUERIES["storage_ratio"](spark, small)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<>" in scan
