"""Queries over what an import leaves: quality rows, baselines, envelopes, tail labels, markup with formulas held back."""

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import typography as Y
from lectern.operators import corpus, documents, metadata, quality, structure
from lectern.plans.base import derived, duck, spread, table

QUALITY = """SELECT o_orderkey AS file, CAST(o_custkey % 7 AS BIGINT) AS formulas_total, CAST(o_orderkey % 5 AS BIGINT) AS figure_count, CAST(o_custkey % 3 AS BIGINT) AS invalid_latex_count,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 2 * 100 AS DOUBLE) END AS bilingual_extraction_score, CASE WHEN o_orderkey % 13 = 0 THEN concat('bad ', CAST(o_orderkey AS STRING)) ELSE NULL END AS parse_error FROM {orders}"""
FIGURES = """SELECT o_custkey AS doc, o_orderkey AS idx, o_orderkey % 7 + 1 AS n, o_orderkey % 3 = 0 AS short, o_orderkey % 5 = 0 AS empty FROM {orders}"""
FORMULAS = """SELECT l_orderkey AS doc, l_linenumber AS idx, l_partkey % 3 AS atoms, l_suppkey % 2 = 0 AS display, l_linenumber % 4 AS kind FROM {lineitem}"""
STYLED = """SELECT o_custkey AS doc, o_orderkey AS idx, CASE o_orderkey % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'author' WHEN 2 THEN 'abstract' WHEN 3 THEN 'keywords' WHEN 4 THEN 'affiliation' ELSE 'body' END AS style,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('text ', CAST(o_orderkey AS STRING)) END AS text FROM {orders}"""
BACK = """SELECT o_custkey AS doc, o_orderkey AS idx, CASE o_orderkey % 10 WHEN 0 THEN 'funding' WHEN 3 THEN 'conflicts' WHEN 6 THEN 'results' ELSE NULL END AS heading_type, concat('<p>', CAST(o_orderkey AS STRING), '</p>') AS html FROM {orders}"""
METRICS = ("formulas_total", "figure_count", "invalid_latex_count", "bilingual_extraction_score")


def quality_totals(spark, sf_dir):
    return corpus.quality_totals(derived(spark, sf_dir, QUALITY), METRICS)


def quality_regressions(spark, sf_dir):
    """The totals of all files against those of files with an odd key."""
    files = derived(spark, sf_dir, QUALITY)
    return corpus.quality_regressions(corpus.quality_totals(files, METRICS), corpus.quality_totals(files.where("file % 2 = 1"), METRICS), METRICS)


def figure_scores(spark, sf_dir):
    """Figures with Russian captions, some cut short, some placeholders: counts and gaps per document."""
    rows = derived(spark, sf_dir, FIGURES)
    caption = F.when(F.col("empty"), "").otherwise(F.concat(F.lit("Рис. "), F.col("n").cast("string"), F.when(F.col("short"), ".").otherwise(". Схема измерений тока")))
    inside = F.when(F.col("idx") % 2 == 0, '<div class="figure-placeholder"></div>').otherwise('<img src="a">')
    block = F.concat(F.lit('<figure class="figure-block">'), inside, F.lit('<figcaption class="figure-caption-ru">'), caption, F.lit("</figcaption></figure>"))
    pages = rows.withColumn("block", block).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "block"))), lambda r: r["block"]), "\n").alias("html"))
    return quality.figure_scores(pages, "doc", "html").select("doc", *[F.col(c).cast("long").alias(c) for c in ("figure_count", "figure_caption_truncated_count", "figure_placeholder_count", "figure_caption_gap_count")])


def untyped_headings(spark, sf_dir):
    part = lambda tag, kind: F.lit(f'<{tag} id="x" data-section-type="{kind}">t</{tag}>')
    html = F.concat(F.repeat(part("h2", "other"), (F.col("c_custkey") % 4).cast("int")), part("h3", "results"), part("h5", "other"))
    return table(spark, sf_dir, "customer").select("c_custkey", quality.untyped_headings(html).alias("n"))


def document_formula_scores(spark, sf_dir):
    """Per document: formulas, empty scripts, lone characters in display formulas, faulty LaTeX, equations with each kind of warning."""
    mathml = F.concat(F.repeat(F.lit("<mi>x</mi>"), F.col("atoms").cast("int")), F.when(F.col("kind") == 1, "<msub><mi>a</mi><mrow></mrow></msub>").otherwise(""))
    errors = F.when(F.col("kind") == 2, F.array(F.lit("unbalanced braces"))).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("kind") == 3, "embell-orphan").otherwise("embell-decoration-unknown")
    warnings = F.when(F.col("kind") >= 2, F.array(F.struct(kind.alias("type")), F.struct(kind.alias("type")))).otherwise(F.array().cast("array<struct<type:string>>"))
    rows = derived(spark, sf_dir, FORMULAS).select("doc", mathml.alias("mathml"), errors.alias("latex_errors"), "display", warnings.alias("warnings"))
    scores = quality.formula_scores(rows, "doc")
    return scores.select("doc", *[F.col(c).cast("long").alias(c) for c in scores.columns if c != "doc"])


def artifact_totals(spark, sf_dir):
    """What the header of an artifact counts in a page's markup."""
    each = lambda text, n: F.repeat(F.lit(text), (F.col("c_custkey") % n).cast("int"))
    html = F.concat(each('<div class="math-block" data-latex="x">x</div>', 4), each('<span class="a math-inline">y</span>', 3), each('<figure class="figure-block"><img></figure>', 5), each("<table><tr></tr></table>", 2), F.lit('<p class="not-math-block">'))
    return corpus.header_totals(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), html.alias("html")))


def failures_first(spark, sf_dir):
    """The first ten failures in the order of file names."""
    files = derived(spark, sf_dir, QUALITY).withColumn("file", F.concat(F.lit("f"), F.col("file").cast("string")))
    return corpus.first_failures(files)


def regression_report(spark, sf_dir):
    """A line for each metric that changed between two states of a file."""
    from lectern.plans.corpus import CURRENT, FILES

    changes = corpus.regressions(derived(spark, sf_dir, FILES), derived(spark, sf_dir, CURRENT), metrics=("figure_blocks", "figure_placeholders"))
    return corpus.report_lines(changes)


def natural_order(spark, sf_dir):
    """Items by the number in their names; names without one come first."""
    name = F.concat(F.when(F.col("s_suppkey") % 9 == 0, "x").otherwise(F.concat(F.lit("eq"), (F.col("s_suppkey") * 37 % 101).cast("string"))), F.lit("_.bin"))
    return corpus.natural_rank(table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))).select("s_suppkey", "number")


def author_email(spark, sf_dir):
    """Starred authors in markup; the address goes to the only author, or to the only starred one of a starred paragraph."""
    html = F.concat(F.lit("A. Smith"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "<sup>*</sup>").otherwise(""), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(", <b>B. Jones</b>"))
    authors = metadata.parse_authors(X.star_marked_authors(F.col("html")))
    rows = spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", html.alias("html")).select("c_custkey", metadata.with_email(authors, F.lit("a@b.org"), F.col("c_custkey") % 5 != 0).alias("authors"))
    # The outer form, as before the other one Spark puts a filter that parses every line again, and does so ahead of the shuffle.
    each = rows.select("c_custkey", F.posexplode_outer("authors").alias("pos", "a")).where("pos IS NOT NULL")
    return each.select("c_custkey", F.col("pos").cast("long").alias("pos"), "a.surname", "a.starred", "a.email")


def envelope_merge(spark, sf_dir):
    """An envelope whose fields an extraction overrides where it found something."""
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("title"), F.lit("10.1/x").alias("doi"))
    found = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("doc"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("new "), "c_name")).otherwise("").alias("title"), F.when(F.col("c_custkey") % 5 == 0, "10.2/y").alias("doi"))
    return metadata.merged_envelope(current, found, ["title", "doi"])


def styled_preamble(spark, sf_dir):
    return metadata.styled_preamble(derived(spark, sf_dir, STYLED)).select("doc", "title_ru", "title_en", "authors_ru", "authors_en", "abstract_ru", "abstract_en", "keywords_ru", "keywords_en", "affiliation_ru")


def back_sections(spark, sf_dir):
    return metadata.back_sections(derived(spark, sf_dir, BACK)).select("doc", "section", "html")


def first_of_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return documents.first_per_key(rows, ["k"], "seq")


CHARS = "7²=∈≤a\u00dfж,~ (|"


def character_classes(spark, sf_dir):
    """The element of each character of a formula's text; paragraphs of an image only; classes that mean a reference."""
    char = F.substring(F.lit(CHARS), (F.col("c_custkey") % len(CHARS) + 1).cast("int"), 1)
    html = F.when(F.col("c_custkey") % 3 == 0, '<br/> <img src="x"> <br>').when(F.col("c_custkey") % 3 == 1, '<img src="x"> text').otherwise("<br>")
    classes = F.when(F.col("c_custkey") % 2 == 0, "a STYLE-Reference b").otherwise("style-references")
    return table(spark, sf_dir, "customer").select("c_custkey", X.character_class(char).alias("element"), X.is_image_only(html).alias("image_only"), X.is_reference_style(classes).alias("reference"))


def tail_labels(spark, sf_dir):
    """Numbers after one to three equations, shared out over them."""
    tail = F.concat(F.lit(" "), F.repeat(F.lit("(7) "), (F.col("l_suppkey") % 5).cast("int")), F.when(F.col("l_partkey") % 2 == 0, "and text (8)").otherwise(""))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", structure.tail_labels(tail, (F.col("l_linenumber") % 3 + 1)).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(F.transform("t.labels", lambda x: F.coalesce(x, F.lit("-"))), "|").alias("labels"), F.col("t.rest").alias("rest"))


def imported_markup(spark, sf_dir):
    """Blanks at the edges of text nodes and across tags; formulas and images keep theirs."""
    gap = F.when(F.col("c_custkey") % 2 == 0, " ").otherwise("")
    html = F.concat(F.lit("  foo"), gap, F.lit("<b>  x</b> , <i> "), F.col("c_nationkey").cast("string"), F.lit('</i><span class="math-inline" data-latex="p  q">p  q</span> <img alt="a  ,b"> end  '))
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select("c_custkey", Y.imported_markup(html).alias("html"))


QUERIES = {
    f.__name__: f
    for f in (
        quality_totals, quality_regressions, figure_scores, untyped_headings, document_formula_scores, artifact_totals, failures_first, regression_report, natural_order, author_email,
        envelope_merge, styled_preamble, back_sections, first_of_key, character_classes, tail_labels, imported_markup,
    )
}

_quality = f"q AS ({duck(QUALITY)})"
_sums = "sum(formulas_total)::BIGINT AS formulas_total, sum(figure_count)::BIGINT AS figure_count, sum(invalid_latex_count)::BIGINT AS invalid_latex_count, avg(bilingual_extraction_score) AS bilingual_extraction_score"
_pick = lambda style, lang, name: f"arg_min(text, idx) FILTER (style = '{style}' AND lang = '{lang}' AND text <> '') AS {name}_{lang}"

ORACLE_SQL = {
    "quality_totals": f"WITH {_quality} SELECT {_sums} FROM q WHERE parse_error IS NULL",
    "quality_regressions": f"""WITH {_quality}, a AS (SELECT {_sums} FROM q WHERE parse_error IS NULL), b AS (SELECT {_sums} FROM q WHERE parse_error IS NULL AND file % 2 = 1),
  l AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, a.{m}::DOUBLE AS before, b.{m}::DOUBLE AS after, {str(m == 'invalid_latex_count').lower()} AS lower_better FROM a, b" for m in METRICS)})
SELECT metric, before, after, after - before AS delta, CASE WHEN (after > before) = lower_better THEN 'regression' ELSE 'improvement' END AS verdict FROM l WHERE before <> after""",
    "figure_scores": f"""WITH f AS ({duck(FIGURES)}), g AS (SELECT doc, greatest(n - lag(n) OVER (PARTITION BY doc ORDER BY idx) - 1, 0) AS jump FROM f WHERE NOT empty), s AS (SELECT doc, sum(jump)::BIGINT AS gaps FROM g GROUP BY doc)
SELECT f.doc, count(*) AS figure_count, count(*) FILTER (short AND NOT empty) AS figure_caption_truncated_count, count(*) FILTER (idx % 2 = 0) AS figure_placeholder_count, coalesce(any_value(gaps), 0)::BIGINT AS figure_caption_gap_count
FROM f LEFT JOIN s ON f.doc = s.doc GROUP BY f.doc""",
    "untyped_headings": "SELECT c_custkey, (c_custkey % 4)::BIGINT AS n FROM customer",
    "document_formula_scores": f"""WITH f AS ({duck(FORMULAS)}) SELECT doc, count(*) AS formulas_total, count(*) FILTER (kind = 1) AS empty_script_count,
  count(*) FILTER (display AND atoms + (kind = 1)::INT <= 1) AS single_char_formula_count, count(*) FILTER (kind = 2) AS latex_invalid_count, count(*) FILTER (kind = 3) AS orphan_decoration_count, count(*) FILTER (kind = 2) AS unknown_decoration_count FROM f GROUP BY doc""",
    "artifact_totals": "SELECT c_custkey AS doc, (c_custkey % 4)::BIGINT AS formulas_block, (c_custkey % 3)::BIGINT AS formulas_inline, (c_custkey % 5)::BIGINT AS figures, (c_custkey % 2)::BIGINT AS tables FROM customer",
    "failures_first": f"WITH {_quality} SELECT concat('f', file::VARCHAR) AS file, parse_error FROM q WHERE parse_error IS NOT NULL ORDER BY concat('f', file::VARCHAR) LIMIT 10",
    "natural_order": "SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_suppkey * 37 % 101 END AS number FROM supplier",
    "author_email": """WITH a AS (SELECT c_custkey, 0::BIGINT AS pos, concat('Smith', c_custkey::VARCHAR) AS surname, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS starred,
  CASE WHEN c_custkey % 3 = 0 OR (c_custkey % 2 = 0 AND c_custkey % 5 <> 0) THEN 'a@b.org' ELSE '' END AS email FROM customer)
SELECT * FROM a UNION ALL SELECT c_custkey, 1, 'Jones', false, '' FROM customer WHERE c_custkey % 3 <> 0""",
    "envelope_merge": """SELECT c_custkey AS doc, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN concat('new ', c_name) ELSE c_name END AS title, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN '10.2/y' ELSE '10.1/x' END AS doi FROM customer""",
    "styled_preamble": f"""WITH s AS ({duck(STYLED)}), m AS (SELECT *, CASE WHEN count(*) FILTER (style = 'title') OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING) >= 2 THEN 'en' ELSE 'ru' END AS lang FROM s)
SELECT doc, {", ".join(_pick(s, lang, n) for s, n in (("title", "title"), ("author", "authors"), ("abstract", "abstract"), ("keywords", "keywords")) for lang in ("ru", "en"))}, {_pick("affiliation", "ru", "affiliation")} FROM m GROUP BY doc""",
    "back_sections": f"""WITH b AS ({duck(BACK)}), s AS (SELECT *, last_value(heading_type IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING) AS section FROM b)
SELECT doc, section, string_agg(html, chr(10) ORDER BY idx) AS html FROM s WHERE heading_type IS NULL AND section IN ('funding', 'conflicts') GROUP BY doc, section""",
    "first_of_key": "SELECT l_partkey AS k, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1",
    "character_classes": f"""SELECT c_custkey, ['mn', 'mn', 'mo', 'mo', 'mo', 'mi', 'mi', 'mi', 'mo', 'mtext', 'mtext', 'mo', 'mo'][c_custkey % {len(CHARS)} + 1] AS element, c_custkey % 3 = 0 AS image_only, c_custkey % 2 = 0 AS reference FROM customer""",
    "tail_labels": """WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 + 1 AS n, l_suppkey % 5 AS k, CASE WHEN l_partkey % 2 = 0 THEN 'and text (8)' ELSE '' END AS more FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN k >= n THEN rtrim(repeat('(7)|', n::INT), '|') WHEN k = 1 THEN concat(repeat('-|', (n - 1)::INT), '(7)') ELSE rtrim(repeat('-|', n::INT), '|') END AS labels,
  CASE WHEN k >= n OR k = 1 THEN more ELSE trim(concat(repeat('(7) ', k::INT), more)) END AS rest FROM r""",
    "imported_markup": """SELECT c_custkey, concat('foo', CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END, '<b>', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' ' END, 'x</b>, <i>', c_nationkey::VARCHAR,
  '</i><span class="math-inline" data-latex="p  q">p  q</span> <img alt="a  ,b"> end') AS html FROM customer""",
}
