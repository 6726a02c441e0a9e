import os

import duckdb
import pytest

from lectern.plans import registry
from lectern.plans.base import table

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


def rows(found, columns):
    return sorted(tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in registry.ORACLE_SQL:
        assert got
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(got, df.columns) == rows(want.fetchall(), want.columns)


def test_entry_works_without_the_subpackage():
    import __spark_entry__

    assert "typography_normalize" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_are_pruned(spark):
    """A query of few columns reads those only."""
    plan = registry.QUERIES["find_cycle"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_linenumber:int>" in plan
    assert table(spark, SF, "orders").where("o_orderkey = 1")._jdf.queryExecution().executedPlan().toString().count("PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,1)]") == 1
