import pytest
from pyspark.sql import functions as F

from lectern.functions import search
from lectern.functions import text as X
from lectern.functions import typography as Y
from lectern.operators import corpus
from lectern.operators import documents as D
from lectern.streaming.edits import import_stream, save_points


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    "function, text, expected",
    [
        (Y.normalize, "слово , слово !", "слово, слово!"), (Y.normalize, "a – b, 1–2, 1 – 2", "a — b, 1–2, 1 – 2"), (Y.normalize, "в и на юге", "в и на юге"), (Y.normalize, None, None),
        (Y.typed_dashes, "1--2 a--b ---", "1–2 a—b —"), (Y.unit_spaces, "№ 5 и 5 кг", "№ 5 и 5 кг"),
        (X.section_type, "2. Результаты и обсуждение", "results"), (X.section_type, "", "other"), (X.section_type, None, "other"), (X.flexible_date, "5.1.2024", "2024-01-05"), (X.flexible_date, None, ""),
        (X.doi, "doi 10.1000/abc.1).", "10.1000/abc.1"), (X.udc, "УДК 533.9", "533.9"), (X.caption_number, "Рис. 12. X", 12), (X.caption_number, "no", None), (X.formula_label, "(12)", "(12)"),
        (X.formula_label, "SEQ Eq \\* ARABIC 7", "(7)"), (X.shortened, "x" * 90, "x" * 79 + "…"), (X.is_caption, None, False), (X.likely_english, "", False),
        (lambda c: search.count(c, "aa"), "aaa", 2), (lambda c: search.count(c, "кот", word=True), "кот котик", 1), (lambda c: search.count(c, ""), "aaa", 0),
        (lambda c: search.replace_all(c, "a.b", "$1\\"), "a.b axb", "$1\\ axb"),
    ],
)
def test_columns(spark, function, text, expected):
    assert one(spark, text, function) == expected


def test_quotes_nest(spark):
    assert one(spark, 'x "a" "b"', Y.russian_quotes) == "x «a» «b»"
    assert one(spark, '""', Y.russian_quotes) == "«„"


def test_guards_and_totals(spark):
    schema = "file int, figure_blocks double, parse_error string"
    few = spark.createDataFrame([(1, 1.0, None)], schema)
    with pytest.raises(ValueError):
        corpus.checked_baseline(few)
    broken = spark.createDataFrame([(i, 1.0, "x") for i in range(6)], schema)
    with pytest.raises(ValueError):
        corpus.checked_baseline(broken)
    r = corpus.totals(broken, ("figure_blocks",)).first()
    assert (r.files_ok, r.files_error, r.sum_figure_blocks, r.mean_figure_blocks) == (0, 6, 0.0, 0.0)
    assert corpus.totals(few.limit(0), ("figure_blocks",)).first().files_ok == 0
    reports = spark.createDataFrame([("x", None), (None, 2)], "error string, mismatches int")
    assert corpus.mismatch_total(reports).first().mismatch_total == 3


def test_envelopes():
    assert D.envelope("")["version"] == "0.1" and D.envelope("{")["pm"] is None and D.envelope(None)["references"] == []
    assert D.envelope('{"type":"doc","content":[]}')["pm"] == {"type": "doc", "content": []}
    e = D.envelope('{"version":"1","meta":{"title":{"en":"T"},"junk":1,"keywords":{"ru":["a"]}},"references":3}')
    assert e["meta"]["title"] == {"ru": "", "en": "T"} and "junk" not in e["meta"] and e["meta"]["keywords"] == {"ru": ["a"], "en": []} and e["references"] == []


def test_streams(spark, tmp_path):
    from helpers import archive, para

    src, out = tmp_path / "in", tmp_path / "edits"
    src.mkdir()
    (src / "a.docx").write_bytes(archive(para("one")))
    seen = []
    query = import_stream(spark, str(src), str(tmp_path / "check"), lambda batch, n: seen.extend(r.text for r in batch.collect()))
    query.awaitTermination(60)
    assert seen == ["one"]
    spark.sql("SELECT 1 AS doc, TIMESTAMP'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,CAST(id AS INT)) AS ts FROM range(3)").write.parquet(str(out))
    stream = spark.readStream.schema("doc int, ts timestamp").parquet(str(out))
    query = save_points(stream).writeStream.format("memory").queryName("saves").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.edits for r in spark.table("saves").collect()] == [3]
