"""Queries over whole tables, against brute force."""

from lectern.operators import structure
from lectern.plans import registry


def test_image_hints_of_every_order(spark, tmp_path):
    lines = [(k, n, k * 7 + n * n) for k in range(1, 41) for n in range(1, k % 5 + 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for k, _, s in sorted(lines):
        want.setdefault(k, {})[str(s % 3)] = None
    got = {r.l_orderkey: r.hints for r in registry.QUERIES["image_hints"](spark, str(tmp_path)).collect()}
    assert got == {k: "+".join(h) for k, h in want.items()}


def test_four_captions_of_a_table(spark):
    four = ["Таблица 1", "Таблица 1. Данные", "Table 1", "Table 1. Data"]
    docs = {1: [*four, None], 2: ["Таблица 9. Ещё", *four, None], 3: ["text", *four[:2], None, "text"], 4: [*four, "text", None]}
    rows = [(doc, i, "table" if t is None else "paragraph", t or "") for doc, texts in docs.items() for i, t in enumerate(texts)]
    found = structure.table_captions(spark.createDataFrame(rows, "doc int, idx int, kind string, text string")).collect()
    got = {doc: [r.of_table for r in sorted(found, key=lambda r: r.idx) if r.doc == doc] for doc in docs}
    assert got == {1: [4] * 4 + [None], 2: [None] + [5] * 4 + [None], 3: [None, 3, 3, None, None], 4: [None] * 6}
