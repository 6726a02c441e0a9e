"""Work per row and its spread: each rewrite of a text stands in the plan once, and after the shuffle that deals the rows."""

import os

import pytest
from pyspark.sql import functions as F

from lectern.functions import typography
from lectern.operators import metadata
from lectern.plans import registry

SF = "/root/testdata/sf0.001"


def physical(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize(("name", "work", "most"), [("author_email", "regexp_replace", 23), ("author_contributors", "regexp_replace", 18), ("imported_markup", "regexp_replace", 15),
    ("omml_latex", "ArrowEvalPython", 1), ("paste_cleaning", "regexp_replace", 18), ("tree_violations", "ArrowEvalPython", 1), ("html_export", "ArrowEvalPython", 1)])
def test_work_is_dealt_and_done_once(spark, name, work, most):
    above, shuffle, below = physical(spark, name).rpartition("REPARTITION_BY_NUM")
    assert shuffle and work in above and work not in below
    assert above.count(work) <= most


def test_import_passes_over_a_text_seven_times(spark):
    assert physical(spark, "typography_imported").count("regexp_replace") == 7


def test_quotes_are_turned_from_one_to_the_next(spark):
    """Steps of the fold are the straight quotes, not the letters."""
    assert 'split(concat(' in (plan := physical(spark, "typography_quotes")) and plan.count('), ", -1)') == 1
    texts = [None, "", 'a', '"', '""', '"a "b" c"', '«"a" b" "', '"a" "b"']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", typography.russian_quotes(F.col("t")).alias("q")).collect()
    assert [r.q for r in sorted(rows)] == [None, "", "a", "«", "«„", "«a »b« c»", "«„a\" b» «", "«a» «b»"]


def test_figures_are_searched_once(spark):
    assert physical(spark, "figure_scores").count("Generate posexplode") == 1


def test_authors_of_odd_lines(spark):
    lines = [(0, None), (1, ""), (2, "nobody, , *"), (3, "А . Б . Иванов**"), (4, "C. Smith;, Ё.Ы.Я Я"), (5, "A. B*, C. D")]
    authors = metadata.with_email(metadata.parse_authors(F.col("t")), F.lit("a@b"), F.lit(True))
    found = spark.createDataFrame(lines, "i int, t string").select("i", authors.alias("a")).collect()
    got = {r.i: r.a and [(a.initials, a.surname, a.starred, a.email) for a in r.a] for r in found}
    assert got == {
        0: None, 1: [], 2: [], 3: [("А.Б.", "Иванов", True, "a@b")], 4: [("C.", "Smith", False, ""), ("Ё.Ы.", "Я", False, "")], 5: [("A.", "B", True, "a@b"), ("C.", "D", False, "")],
    }
