"""Queries over predicates, extractors, classifiers and markup."""

from pyspark.sql import functions as F

from lectern.functions import html as H
from lectern.functions import text as X
from lectern.operators import corpus
from lectern.plans.base import derived, duck, spread, table

HEADINGS = """
SELECT l_orderkey AS k, l_linenumber AS n, concat(CASE l_partkey % 3 WHEN 0 THEN '1. ' WHEN 1 THEN '2.3) ' ELSE '' END,
  CASE (l_orderkey + l_linenumber) % 16 WHEN 0 THEN 'Введение' WHEN 1 THEN 'Materials and Methods' WHEN 2 THEN 'Результаты и обсуждение' WHEN 3 THEN 'RESULTS.'
  WHEN 4 THEN 'Numerical analysis of models' WHEN 5 THEN 'A model of growth' WHEN 6 THEN 'Discussion:' WHEN 7 THEN 'Выводы' WHEN 8 THEN 'Funding' WHEN 9 THEN 'Conflict of interest'
  WHEN 10 THEN 'Список литературы' WHEN 11 THEN 'Приложение Б' WHEN 12 THEN 'Аннотация' WHEN 13 THEN 'Научная новизна' WHEN 14 THEN 'Problem statement' ELSE 'Anything else' END) AS text
FROM {lineitem}"""
TYPES = "introduction methods results results results methods discussion conclusion funding conflicts references appendix abstract results methods other".split()

STYLES = """
SELECT l_orderkey AS k, l_linenumber AS n,
  CASE l_partkey % 9 WHEN 0 THEN 'TitleArticle' WHEN 1 THEN 'author' WHEN 2 THEN 'EMail' WHEN 3 THEN 'Keywords' WHEN 4 THEN 'References' WHEN 5 THEN 'Heading2'
    WHEN 6 THEN 'EquationMy' WHEN 7 THEN 'FigCaption' ELSE NULL END AS style,
  CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Fig. 3 shows' ELSE 'some text' END AS text,
  l_linenumber % 4 = 0 AS has_image, l_linenumber % 5 = 0 AS has_ole
FROM {lineitem}"""

STRINGS = """
SELECT o_orderkey AS k,
  concat('See doi 10.', CAST(1000 + o_custkey % 9000 AS STRING), '/abc.', CAST(o_orderkey AS STRING), '). and more') AS doi_text,
  concat(CASE o_orderkey % 3 WHEN 0 THEN 'УДК ' WHEN 1 THEN 'UDC: ' ELSE 'X ' END, CAST(500 + o_custkey AS STRING), '.', CAST(o_orderkey % 10 AS STRING), ' ') AS udc_text,
  concat('* e-mail: name', CAST(o_custkey AS STRING), '@site.org. Dept of X') AS mail_text,
  CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(1 + o_orderkey % 28 AS STRING), '.', CAST(1 + o_custkey % 12 AS STRING), '.2024') WHEN 1 THEN concat('7/', CAST(1 + o_custkey % 12 AS STRING), '/2023 year')
    WHEN 2 THEN '2022-03-04T10:00' ELSE 'spring' END AS date_text,
  CASE o_orderkey % 5 WHEN 0 THEN 'Equation.3' WHEN 1 THEN 'MathType.4' WHEN 2 THEN 'MathTypeX' WHEN 3 THEN 'Word.Picture' ELSE 'mathtype' END AS prog_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'https://a.b/c' WHEN 1 THEN 'data:image/png;base64,AA' WHEN 2 THEN 'javascript:alert(1)' WHEN 3 THEN 'img/x.png' WHEN 4 THEN ' ' ELSE 'ftp://a/b' END AS url,
  concat('alpha, beta', CAST(o_custkey AS STRING), '; ;gamma ,') AS words,
  concat('Статьи/Ёж ', CAST(o_orderkey AS STRING), ' – Щука.DOCX') AS path
FROM {orders}"""


def section_type(spark, sf_dir):
    return derived(spark, sf_dir, HEADINGS).select("k", "n", X.section_type(F.col("text")).alias("section_type"))


def heading_text(spark, sf_dir):
    return derived(spark, sf_dir, HEADINGS).select("k", "n", X.heading_text(F.col("text")).alias("heading"))


def imported_as(spark, sf_dir):
    c = F.col
    return derived(spark, sf_dir, STYLES).select("k", "n", X.imported_as(c("style"), c("text"), c("has_image"), c("has_ole")).alias("imported_as"))


def extract_strings(spark, sf_dir):
    c = F.col
    return derived(spark, sf_dir, STRINGS).select(
        "k", X.doi(c("doi_text")).alias("doi"), X.udc(c("udc_text")).alias("udc"), X.affiliation_email(c("mail_text")).alias("email"),
        X.without_email_lines(c("mail_text")).alias("affiliation"), X.flexible_date(c("date_text")).alias("iso"), F.array_join(X.keyword_list(c("words")), "|").alias("keywords"),
    )


def predicates(spark, sf_dir):
    c = F.col
    return derived(spark, sf_dir, STRINGS).select(
        "k", X.is_equation_program(c("prog_id")).alias("equation"), X.is_equation_program_loose(c("prog_id")).alias("equation_loose"),
        X.is_allowed_image(c("url")).alias("image"), X.is_allowed_image(c("url"), relative=False).alias("formula_image"), X.is_usable_image(c("url")).alias("usable"),
    )


def artifact_slug(spark, sf_dir):
    return derived(spark, sf_dir, STRINGS).select("k", X.artifact_slug(F.col("path")).alias("slug"))


def likely_english(spark, sf_dir):
    t = F.col("text")
    mixed = F.when(F.col("doc_id") % 3 == 0, F.concat(t, F.repeat(F.lit("ж"), 40))).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", X.likely_english(mixed).alias("english"))


def email_extract(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9])"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, " ").alias("emails"))


def html_metrics(spark, sf_dir):
    return H.with_metrics(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "html").select("page_id", *H.METRICS)


def html_metrics_totals(spark, sf_dir):
    files = html_metrics(spark, sf_dir).withColumn("parse_error", F.when(F.col("page_id") % 10 == 0, "broken"))
    return corpus.totals(files, ("headings_h1", "figure_blocks", "math_extraction_rate"))


def page_blocks(spark, sf_dir):
    return H.blocks(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", F.col("idx").cast("long").alias("idx"), "tag", F.length("text").cast("long").alias("n_chars"))


def paste_cleaning(spark, sf_dir):
    image = F.when(F.col("c_custkey") % 2 == 0, '<img alt=" x<y " class="my-equation">').otherwise('<img alt="" class="equation">')
    word = F.concat(
        F.lit('<!--[if gte mso 9]>\nx<![endif]--><p class="MsoNormal" style="x:y;font-family:Arial"><b>a</b> <o:p>gone</o:p><span>'), F.col("c_name"), F.lit("</span><span> </span></p><!-- x -->"),
        F.repeat(F.lit("<p>&nbsp;</p>"), (F.col("c_custkey") % 4).cast("int")), image, F.lit('<b style="font-weight:normal">plain</b><w:x>kept</w:x>'),
    )
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", H.word_html(word).alias("clean"), X.is_word_html(word).alias("word_html"))


def formula_scores(spark, sf_dir):
    markup = F.concat(F.repeat(F.lit("<mi>x</mi>"), F.col("l_linenumber") % 3), F.when(F.col("l_suppkey") % 2 == 0, "<msub><mi>a</mi><mrow></mrow></msub>").otherwise("<mo>+</mo>"))
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", markup.alias("m"))
    return found.select("l_orderkey", "l_linenumber", H.semantic_atoms(F.col("m")).alias("atoms"), H.empty_scripts(F.col("m")).alias("empty_scripts"), H.is_single_character(F.col("m")).alias("single"))


def labels_and_slugs(spark, sf_dir):
    text = F.concat(F.lit("("), F.col("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(")"))
    name = F.concat(F.lit("Über  "), F.col("c_name"), F.lit(" — Тест!"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", X.formula_label(text).alias("label"), X.heading_slug(name).alias("slug"), X.shortened(F.repeat("c_name", 3), 30).alias("short"),
        X.xml_escaped(F.concat(F.lit('<a b="&">'), F.col("c_name"))).alias("xml"), X.hexed(F.col("c_custkey"), 4).alias("hexed"),
    )


def metadata_scores(spark, sf_dir):
    """Completeness and bilingual score of derived metadata, per document and as totals would take them."""
    from lectern.operators.quality import bilingual_score, metadata_completeness

    def some(n):
        return F.when(F.col("o_orderkey") % n != 0, F.lit("x")).otherwise(F.lit(" "))

    meta = F.struct(
        F.struct(some(2).alias("ru"), some(3).alias("en")).alias("title"), F.struct(some(5).alias("ru"), some(7).alias("en")).alias("abstracts"),
        F.struct(F.lit("").alias("ru"), some(4).alias("en")).alias("abstract"),
        F.struct(F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("k"))).otherwise(F.array().cast("array<string>")).alias("ru")).alias("keywords"),
        F.struct(some(11).alias("received"), F.lit(None).cast("string").alias("accepted")).alias("dates"),
        F.array(F.struct((F.col("o_custkey") % 3 == 0).alias("is_corresponding"))).alias("contributors"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", metadata_completeness(meta).alias("completeness"), bilingual_score(meta).alias("bilingual"))


QUERIES = {
    f.__name__: f
    for f in (
        section_type, heading_text, imported_as, extract_strings, predicates, artifact_slug, likely_english, email_extract, html_metrics, html_metrics_totals,
        page_blocks, paste_cleaning, formula_scores, labels_and_slugs, metadata_scores,
    )
}

_type_case = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES))
_names = "введение|materials and methods|результаты и обсуждение|results|numerical analysis of models|a model of growth|discussion|выводы|funding|conflict of interest|список литературы|приложение б|аннотация|научная новизна|problem statement|anything else".split("|")
_name_case = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_names))
_n = lambda p: f"len(regexp_extract_all(html, '{p}'))::BIGINT"
_metrics = {
    "figure_blocks": _n('class="figure-block"'), "figure_placeholders": _n("figure-placeholder"), "figures_extracted_total": _n('class="figure-block"') + " + " + _n("figure-placeholder"),
    "figure_caption_ru": _n("figure-caption-ru"), "figure_caption_en": _n("figure-caption-en"), "table_blocks": _n(r"<table\b"), "table_wraps": _n('class="table-wrap"'),
    "table_caption_ru": _n('class="table-caption table-caption-ru"'), "table_caption_en": _n('class="table-caption table-caption-en"'), "math_blocks": _n('class="math-block"'),
    "math_inline": _n('class="math-inline"'), "omml_in_source": _n(r"(?i)<m:oMath\b"), "ole_in_source": _n(r"(?i)<w:object\b"), "math_extraction_rate": "0.0::DOUBLE",
    "headings_h1": _n(r"<h1\b"), "headings_h2": _n(r"<h2\b"), "headings_h3": _n(r"<h3\b"), "lonely_number_paragraphs": _n(r"(?i)<p[^>]*>\s*\([0-9]{1,3}\)\s*</p>"),
}
_has = lambda n: f"(o_orderkey % {n} <> 0)::INT"

ORACLE_SQL = {
    "section_type": f"SELECT l_orderkey AS k, l_linenumber AS n, CASE (l_orderkey + l_linenumber) % 16 {_type_case} END AS section_type FROM lineitem",
    "heading_text": f"SELECT l_orderkey AS k, l_linenumber AS n, CASE (l_orderkey + l_linenumber) % 16 {_name_case} END AS heading FROM lineitem",
    "imported_as": f"""WITH d AS ({duck(STYLES)}) SELECT k, n, CASE style WHEN 'TitleArticle' THEN 'metadata-title' WHEN 'author' THEN 'metadata-author' WHEN 'EMail' THEN 'metadata-affiliation'
  WHEN 'Keywords' THEN 'metadata-abstract' WHEN 'References' THEN 'reference' WHEN 'Heading2' THEN 'heading-h2' WHEN 'EquationMy' THEN 'math-block'
  ELSE CASE WHEN has_ole AND text = '' THEN 'math-block' WHEN has_ole THEN 'math-inline-host' WHEN has_image THEN 'figure-block' WHEN style = 'FigCaption' OR text LIKE 'Fig.%' THEN 'fig-caption'
    WHEN text = '' THEN 'skipped' ELSE 'paragraph' END END AS imported_as FROM d""",
    "extract_strings": """SELECT o_orderkey AS k, concat('10.', (1000 + o_custkey % 9000)::VARCHAR, '/abc.', o_orderkey::VARCHAR) AS doi,
  CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE concat((500 + o_custkey)::VARCHAR, '.', (o_orderkey % 10)::VARCHAR) END AS udc,
  concat('name', o_custkey::VARCHAR, '@site.org.') AS email, 'Dept of X' AS affiliation,
  CASE o_orderkey % 4 WHEN 0 THEN concat('2024-', lpad((1 + o_custkey % 12)::VARCHAR, 2, '0'), '-', lpad((1 + o_orderkey % 28)::VARCHAR, 2, '0')) WHEN 1 THEN concat('2023-', lpad((1 + o_custkey % 12)::VARCHAR, 2, '0'), '-07')
    WHEN 2 THEN '2022-03-04' ELSE 'spring' END AS iso, concat('alpha|beta', o_custkey::VARCHAR, '|gamma') AS keywords FROM orders""",
    "predicates": """SELECT o_orderkey AS k, o_orderkey % 5 IN (0, 1, 4) AS equation, o_orderkey % 5 <> 3 AS equation_loose, o_orderkey % 6 IN (0, 1, 3) AS image,
  o_orderkey % 6 IN (0, 1) AS formula_image, o_orderkey % 6 <> 4 AS usable FROM orders""",
    "artifact_slug": f"WITH d AS ({duck(STRINGS)}) SELECT k, concat('stati_ezh_', k::VARCHAR, '_schuka_', substr(sha1(path), 1, 8), '.jsonl') AS slug FROM d",
    "likely_english": r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(text, repeat('ж', 40)) ELSE text END AS t FROM documents),
  c AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z]')) AS a, len(regexp_extract_all(t, '[\x{0400}-\x{04ff}]')) AS b FROM d)
SELECT doc_id, coalesce(a + b > 0 AND a > 0.5 * (a + b) AND b < 0.1 * (a + b), false) AS english FROM c""",
    "email_extract": r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]'), ' ') AS emails FROM documents",
    "html_metrics": "SELECT page_id, " + ", ".join(f"{v} AS {k}" for k, v in _metrics.items()) + " FROM pages",
    "html_metrics_totals": f"""WITH m AS (SELECT page_id, {_metrics['headings_h1']} AS h, {_metrics['figure_blocks']} AS f FROM pages), g AS (SELECT * FROM m WHERE page_id % 10 <> 0)
SELECT (SELECT count(*) FROM g) AS files_ok, (SELECT count(*) FROM m WHERE page_id % 10 = 0) AS files_error, coalesce(sum(h), 0)::BIGINT AS sum_headings_h1, coalesce(sum(f), 0)::BIGINT AS sum_figure_blocks,
  0.0::DOUBLE AS sum_math_extraction_rate, coalesce(avg(h), 0.0)::DOUBLE AS mean_headings_h1, coalesce(avg(f), 0.0)::DOUBLE AS mean_figure_blocks, 0.0::DOUBLE AS mean_math_extraction_rate FROM g""",
    "page_blocks": r"""
WITH b AS (SELECT page_id, regexp_extract_all(html, '(?is)<(?:h[1-6]|p)\b[^>]*>.*?</(?:h[1-6]|p)>') AS l FROM pages), u AS (SELECT page_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS idx FROM b)
SELECT page_id, idx::BIGINT AS idx, lower(regexp_extract(s, '^<([A-Za-z0-9]+)', 1)) AS tag,
  length(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(s, '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '&#160;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'), '^ | $', '', 'g'))::BIGINT AS n_chars FROM u""",
    "paste_cleaning": """SELECT c_custkey, concat('<p style="x:y;"><b>a</b> <span>', c_name, '</span></p><!-- x -->', repeat('<p>&nbsp;</p>', CASE c_custkey % 4 WHEN 3 THEN 1 ELSE (c_custkey % 4)::INT END),
  CASE WHEN c_custkey % 2 = 0 THEN '<span class="math-inline" data-latex="x&lt;y">x&lt;y</span>' ELSE '<img alt="" class="equation">' END, 'plainkept') AS clean, true AS word_html FROM customer""",
    "formula_scores": """SELECT l_orderkey, l_linenumber, (l_linenumber % 3 + 1)::BIGINT AS atoms, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS empty_scripts,
  CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS single FROM lineitem""",
    "labels_and_slugs": r"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('(', c_custkey::VARCHAR, ')') END AS label,
  substr(regexp_replace(regexp_replace(lower(concat('Über  ', c_name, ' — Тест!')), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug,
  CASE WHEN 3 * length(c_name) <= 30 THEN repeat(c_name, 3) ELSE concat(rtrim(substr(repeat(c_name, 3), 1, 29)), '…') END AS short,
  concat('&lt;a b=&quot;&amp;&quot;&gt;', c_name) AS xml, printf('0x%04X', c_custkey::INT) AS hexed FROM customer""",
    "metadata_scores": f"""SELECT o_orderkey, ({_has(2)} + {_has(3)} + {_has(5)} + (o_orderkey % 7 <> 0 OR o_orderkey % 4 <> 0)::INT + (o_custkey % 2 = 0)::INT + {_has(11)} + (o_custkey % 3 = 0)::INT) * 12.5::DOUBLE AS completeness,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 3 <> 0 THEN 100 ELSE 0 END::INT AS bilingual FROM orders""",
}
