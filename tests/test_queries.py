import pytest

import __spark_entry__ as entry
from linkloom.plans import evidence, evidence_sql, linkage, linkage_sql, problems, problems_sql
from tests.oracle import agree

CORE = {**linkage.QUERIES, **evidence.QUERIES, **problems.QUERIES}
SQL = {**linkage_sql.SQL, **evidence_sql.SQL, **problems_sql.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, name):
    agree(spark, data, CORE[name], SQL[name])


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["vec_id", "entity_head"]
    assert set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_prune_columns_and_push_filters(spark, data):
    plan = linkage.QUERIES["consensus_vote"](spark, data)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(value,2.0)" in plan and "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in plan


def test_entities_hold_each_clip_once(spark, data):
    out = linkage.QUERIES["linkage_entities"](spark, data).collect()
    seen = set()
    for r in out:
        assert r["entity_head"] <= r["vec_id"]
        assert (r["entity_head"], r["vec_id"] % 3) not in seen
        seen.add((r["entity_head"], r["vec_id"] % 3))
    assert len(out) == spark.read.parquet(f"{data}/embeddings.parquet").count()
