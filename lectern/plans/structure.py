"""Queries over the structuring passes."""

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import structure as S
from lectern.plans.base import derived, duck, table
from lectern.plans.corpus import BLOCKS

CAPTIONS = """
SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN concat('Рис. ', CAST(o_custkey AS STRING), '. Схема<br/>Fig. ', CAST(o_custkey AS STRING), '. Scheme')
  WHEN 1 THEN concat('Рис. ', CAST(o_custkey AS STRING), '. Схема <strong>Fig. ', CAST(o_custkey AS STRING), '</strong> Scheme') WHEN 2 THEN concat('Рис. ', CAST(o_custkey AS STRING), '. Схема. Fig. 7. Scheme')
  WHEN 3 THEN concat('Рис. ', CAST(o_custkey AS STRING), ' Схема') ELSE 'Fig. 1 only' END AS html FROM {orders}"""
MERGED = """
SELECT o_custkey AS doc, o_orderkey AS idx, 'fig-caption' AS style_type, CASE o_orderkey % 3 WHEN 0 THEN concat('Рис. ', CAST(o_orderkey AS STRING), '. Схема. Здесь показан опыт') WHEN 1 THEN 'Рис. 1. Схема. Здесь x'
  ELSE 'Обычный текст. Здесь показан опыт' END AS text FROM {orders}"""
TABLES = """
SELECT o_custkey AS doc, o_orderkey AS idx, CASE WHEN o_orderkey % 4 = 3 THEN 'table' ELSE 'paragraph' END AS kind,
  CASE o_orderkey % 4 WHEN 1 THEN 'Таблица 2' WHEN 2 THEN concat('Таблица ', CAST(o_orderkey AS STRING), '. Данные') WHEN 3 THEN '' ELSE 'text' END AS text FROM {orders}"""


def bilingual_captions(spark, sf_dir):
    pair = S.bilingual_caption(F.col("html"))
    return derived(spark, sf_dir, CAPTIONS).select("k", pair["ru"].alias("ru"), pair["en"].alias("en"))


def merged_captions(spark, sf_dir):
    return S.split_merged_captions(derived(spark, sf_dir, MERGED)).select("doc", "idx", "part", "style_type", "text")


def table_captions(spark, sf_dir):
    return S.table_captions(derived(spark, sf_dir, TABLES)).select("doc", "idx", "role", "of_table")


def placed_figures(spark, sf_dir):
    """Images and captions, each caption once: as many placeholders as captions are left over."""
    found = S.placed_figures(derived(spark, sf_dir, BLOCKS))
    return found.groupBy("doc").agg(F.count_if(~F.col("placeholder")).alias("images"), F.count("caption_idx").alias("captions"), F.count_distinct("caption_idx").alias("distinct_captions"))


def uppercase_headings(spark, sf_dir):
    html = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("<p>"), F.col("c_custkey"), F.lit(". ВВЕДЕНИЕ</p>"))).when(F.col("c_custkey") % 3 == 1, "<p><strong>RESULTS AND</strong></p>").otherwise("<p>NOT bold</p>")
    return table(spark, sf_dir, "customer").select("c_custkey", S.is_uppercase_heading(html).alias("heading"))


def equation_tables(spark, sf_dir):
    cells = F.when(F.col("c_custkey") % 2 == 0, F.lit("<td></td>")).otherwise("")
    html = F.concat(F.lit("<p>a</p><table><tr>"), cells, F.lit("<td> x_"), F.col("c_nationkey"), F.lit(" </td><td>("), F.col("c_custkey"), F.lit(")</td></tr></table>"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.equation_tables(html).alias("html"), X.tex_source(F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).alias("tex"))


def unstyled_preamble(spark, sf_dir):
    text = F.when(F.col("n") == 0, F.concat(F.lit("A title of some length "), F.col("c_custkey"))).when(F.col("n") == 4, F.repeat(F.lit("abstract "), 30)).otherwise(F.try_element_at(F.array(*[F.lit(x) for x in ("", "A. B. Smith, C. Jones", "Department of Physics, University of X", "E-mail: a@b.org")]), F.col("n") + 1))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n"))
    found = S.unstyled_preamble(rows.select(F.col("c_custkey").alias("doc"), F.col("n").alias("idx"), text.alias("text")))
    return found.select("doc", "title_ru", "title_en", F.array_join("authors.surname", ",").alias("surnames"), "affiliation", "email", F.length("abstract").cast("long").alias("n_abstract"))


def formula_spacing(spark, sf_dir):
    pick = lambda i, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % i + 1).cast("int"))
    s = S.inline_formula_spacing(pick(3, "word", "(", "x,"), pick(4, "next", ", and", ")", "(a"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("["), s["left"], F.lit("|"), s["right"], F.lit("]")).alias("spacing"))


def figure_tables(spark, sf_dir):
    cells = F.concat(F.lit('<table><tr><td><img src="a"></td>'), F.repeat(F.lit("<td>x</td>"), (F.col("c_custkey") % 5).cast("int")), F.when(F.col("c_custkey") % 2 == 0, "<td>Рис. 1. A</td>").otherwise("<td>A</td>"), F.lit("</tr></table>"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.is_figure_table(cells).alias("figure"))


def caption_list_removed(spark, sf_dir):
    """Documents of orders, with the announcing line at the first order divisible by ten."""
    rows = derived(spark, sf_dir, BLOCKS).withColumn("text", F.when(F.col("idx") % 10 == 0, "Подписи к рисункам").otherwise(F.col("text")))
    return S.without_caption_list(rows).groupBy("doc").agg(F.count("*").alias("n"), F.sum("idx").alias("total"))


QUERIES = {f.__name__: f for f in (formula_spacing, figure_tables, caption_list_removed, bilingual_captions, merged_captions, table_captions, placed_figures, uppercase_headings, equation_tables, unstyled_preamble)}

ORACLE_SQL = {
    "formula_spacing": "SELECT c_custkey, concat('[', CASE WHEN c_custkey % 3 IN (0, 2) THEN ' ' ELSE '' END, '|', CASE WHEN c_custkey % 4 IN (0, 3) THEN ' ' ELSE '' END, ']') AS spacing FROM customer",
    "figure_tables": "SELECT c_custkey, c_custkey % 2 = 0 AND c_custkey % 5 <= 2 AS figure FROM customer",
    "caption_list_removed": f"""WITH b AS ({duck(BLOCKS)}), t AS (SELECT doc, idx, kind, CASE WHEN idx % 10 = 0 THEN 'mark' ELSE text END AS text FROM b),
  s AS (SELECT *, max((text = 'mark')::INT) OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING) AS seen FROM t)
SELECT doc, count(*) AS n, sum(idx)::BIGINT AS total FROM s WHERE NOT (seen = 1 AND (text = 'mark' OR (kind = 'paragraph' AND (text = '' OR text LIKE 'Рис.%' OR text LIKE 'Fig.%')))) GROUP BY doc""",
    "bilingual_captions": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 IN (0, 1) THEN concat('Рис. ', o_custkey::VARCHAR, '. Схема') WHEN o_orderkey % 5 = 2 THEN concat('Рис. ', o_custkey::VARCHAR, '. Схема.') END AS ru,
  CASE o_orderkey % 5 WHEN 0 THEN concat('Fig. ', o_custkey::VARCHAR, '. Scheme') WHEN 1 THEN concat('<strong>Fig. ', o_custkey::VARCHAR, '</strong> Scheme') WHEN 2 THEN 'Fig. 7. Scheme' END AS en FROM orders""",
    "merged_captions": f"""WITH d AS ({duck(MERGED)}) SELECT doc, idx, 0 AS part, style_type, CASE WHEN idx % 3 = 0 THEN replace(text, ' Здесь показан опыт', '') ELSE text END AS text FROM d
UNION ALL SELECT doc, idx, 1, 'body', 'Здесь показан опыт' FROM d WHERE idx % 3 = 0""",
    "table_captions": f"""WITH d AS ({duck(TABLES)}), r AS (SELECT doc, idx, CASE WHEN kind = 'table' THEN 'table' WHEN text = 'Таблица 2' THEN 'number' WHEN text LIKE 'Таблица%' THEN 'caption' ELSE 'other' END AS role FROM d),
  n AS (SELECT *, lead(role, 1) OVER w AS r1, lead(role, 2) OVER w AS r2, lead(role, 3) OVER w AS r3, lead(role, 4) OVER w AS r4, lead(idx, 1) OVER w AS i1, lead(idx, 2) OVER w AS i2, lead(idx, 3) OVER w AS i3, lead(idx, 4) OVER w AS i4 FROM r WINDOW w AS (PARTITION BY doc ORDER BY idx))
SELECT doc, idx, role, CASE WHEN role IN ('table', 'other') THEN NULL WHEN r1 = 'table' THEN i1 WHEN r1 = 'other' THEN NULL WHEN r2 = 'table' THEN i2 WHEN r2 = 'other' THEN NULL WHEN r3 = 'table' THEN i3 WHEN r3 = 'other' THEN NULL WHEN r4 = 'table' THEN i4 END AS of_table FROM n""",
    "placed_figures": f"""WITH b AS ({duck(BLOCKS)}), g AS (SELECT doc, count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'paragraph' AND (text LIKE 'Рис.%' OR text LIKE 'Fig.%')) AS captions FROM b GROUP BY doc)
SELECT doc, images, captions, captions AS distinct_captions FROM g WHERE images + captions > 0""",
    "uppercase_headings": "SELECT c_custkey, c_custkey % 3 <> 2 AS heading FROM customer",
    "equation_tables": """SELECT c_custkey, concat('<p>a</p><div class="math-block" data-latex="x_', c_nationkey::VARCHAR, '">x_', c_nationkey::VARCHAR, '<span class="math-label">(', c_custkey::VARCHAR, ')</span></div>') AS html, c_name AS tex FROM customer""",
    "unstyled_preamble": """SELECT c_custkey AS doc, NULL::VARCHAR AS title_ru, concat('A title of some length ', c_custkey::VARCHAR) AS title_en, 'Smith,Jones' AS surnames, 'Department of Physics, University of X' AS affiliation, 'a@b.org' AS email, 270::BIGINT AS n_abstract FROM customer""",
}
