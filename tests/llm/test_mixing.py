from fractions import Fraction

import duckdb
import pytest
from conftest import SF  # noqa: F401

from lectern.llm import mixing
from lectern.llm.queries_mixing import ORACLE_SQL, op3_mixing


def filled(sizes: dict) -> dict:
    """Targets by resharing the excess until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10}, {"a": 1, "b": 100, "c": 3, None: 50}, {"a": 0, "b": 5}, {"x": 7}, {f"s{i:02}": i * i + 1 for i in range(20)}])
def test_targets(spark, sizes):
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = filled(sizes)
    assert {r.source: pytest.approx(float(want[r.source])) for r in rows} == {r.source: r.target for r in rows}
    assert all(r.rate <= 2 for r in rows)


def test_query_equals_sql(spark):
    got = sorted(tuple(r) for r in op3_mixing(spark, SF).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.sql(ORACLE_SQL["op3_mixing"]).fetchall())


def test_odd_rows(spark, odd_docs):
    out = mixing.mix(odd_docs)
    assert out.columns == odd_docs.columns
    planned = mixing.plan_mix(odd_docs).collect()
    assert len(planned) == odd_docs.count() and {r["size"] for r in planned if not (r.doc.text or "").strip()} == {0}
    assert out.count() == sum(r.copies for r in planned)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(odd_docs).collect()))
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_no_python_in_the_plan(odd_docs):
    plan = mixing.mix(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_joined_where_sources_are_many(make_docs, monkeypatch):
    docs = make_docs(*[(i, "a b c", f"s{i % 7}") for i in range(50)])
    want = sorted(map(str, mixing.plan_mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.plan_mix(docs).collect())) == want
