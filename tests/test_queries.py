import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(float(v), 9) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, con, name):
    got = plans.QUERIES[name](spark, SF)
    cursor = con.execute(plans.SQL[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(n for n in plans.SQL if n.startswith("sample_")))
def test_samples_never_broadcast_the_raster(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
