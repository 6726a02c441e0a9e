"""Markup as data: metrics of imported pages, and blocks of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.bound import let
from lectern.functions.jsregex import SPACE
from lectern.functions.typography import collapse_white_space

# What each metric counts in the markup, and whether more is better.
HTML_PATTERNS = {
    "figure_blocks": 'class="figure-block"', "figure_placeholders": "figure-placeholder", "figure_caption_ru": "figure-caption-ru",
    "figure_caption_en": "figure-caption-en", "table_blocks": r"<table(?![A-Za-z0-9_])", "table_wraps": 'class="table-wrap"',
    "table_caption_ru": 'class="table-caption table-caption-ru"', "table_caption_en": 'class="table-caption table-caption-en"',
    "math_blocks": 'class="math-block"', "math_inline": 'class="math-inline"',
    "headings_h1": r"<h1(?![A-Za-z0-9_])", "headings_h2": r"<h2(?![A-Za-z0-9_])", "headings_h3": r"<h3(?![A-Za-z0-9_])",
    "lonely_number_paragraphs": rf"(?i)<p[^>]*>{SPACE}*\([0-9]{{1,3}}\){SPACE}*</p>",
}
XML_PATTERNS = {"omml_in_source": r"(?i)<m:oMath(?![A-Za-z0-9_])", "ole_in_source": r"(?i)<w:object(?![A-Za-z0-9_])"}
LOWER_IS_BETTER = ("figure_placeholders", "lonely_number_paragraphs")
METRICS = (
    "figure_blocks", "figure_placeholders", "figures_extracted_total", "figure_caption_ru", "figure_caption_en", "table_blocks", "table_wraps",
    "table_caption_ru", "table_caption_en", "math_blocks", "math_inline", "omml_in_source", "ole_in_source", "math_extraction_rate",
    "headings_h1", "headings_h2", "headings_h3", "lonely_number_paragraphs",
)
EMPTY_SCRIPTS = (
    rf"(?is)<msub\b[^>]*>.*?<mrow>{SPACE}*</mrow>{SPACE}*</msub>", rf"(?is)<msub\b[^>]*>.*?<mrow{SPACE}*/>{SPACE}*</msub>",
    rf"(?is)<msup\b[^>]*>.*?<mrow>{SPACE}*</mrow>{SPACE}*</msup>", rf"(?is)<msup\b[^>]*>.*?<mrow{SPACE}*/>{SPACE}*</msup>",
    rf"(?is)<msubsup\b[^>]*>.*?<mrow>{SPACE}*</mrow>{SPACE}*<mrow>{SPACE}*</mrow>{SPACE}*</msubsup>", rf"(?is)<msubsup\b[^>]*>.*?<mrow{SPACE}*/>{SPACE}*<mrow{SPACE}*/>{SPACE}*</msubsup>",
)
ANY, QUOTE = r"[^\n\r\x{2028}\x{2029}]", r"(?=['\"])"
#: The reference's rewrites of pasted Office markup, before and after the one of equation images.
WORD_RULES = (
    (r"(?is)<!\[if.*?\]>", ""), (r"(?i)<!\[endif\]>", ""), (r"(?is)<!--\[if.*?endif\]-->", ""), (r"(?i)<o:p></o:p>", ""), (rf"(?i)<o:p>{ANY}*?</o:p>", ""),
    (r"(?i)</?o:[^>]*>", ""), (r"(?i)</?v:[^>]*>", ""), (r"(?i)</?w:[^>]*>", ""), (r"(?i)</?m:[^>]*>", ""),
    (rf'(?i){SPACE}*class="Mso[^"]*"', ""), (rf"(?i)<span{SPACE}*>{SPACE}*</span>", ""),
    (rf"(?i)font-family:[^;\"']*(?:;|{SPACE}*{QUOTE})", ""), (rf"(?i)font-size:{SPACE}*[0-9.]+pt{SPACE}*(?:;|{SPACE}*{QUOTE})", ""), (rf'(?i){SPACE}*style="{SPACE}*"', ""),
)
EQUATION_IMAGE = r'(?i)<img[^>]*?alt="([^"]*)"[^>]*?class="[^"]*equation[^"]*"[^>]*?/?>'
LATER_WORD_RULES = (
    (rf"(?i)<v:shape[^>]*>{ANY}*?</v:shape>", ""), (rf"(?i)(?:<p[^>]*>(?:&nbsp;|{SPACE})*+</p>{SPACE}*+){{3,}}", "<p>&nbsp;</p>"),
    (rf'(?i)<b{SPACE}+style="[^"]*font-weight:{SPACE}*normal[^"]*">({ANY}*?)</b>', "$1"),
)


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def with_metrics(df: DataFrame, html: str, xml: str) -> DataFrame:
    """``df`` with the eighteen metrics of a document's markup and source."""
    counted = df.withColumns({name: count(F.col(html), pattern) for name, pattern in HTML_PATTERNS.items()} | {name: count(F.col(xml), pattern) for name, pattern in XML_PATTERNS.items()})
    sources = F.col("omml_in_source") + F.col("ole_in_source")
    rate = F.when(sources > 0, (F.col("math_blocks") + F.col("math_inline")) / F.nullif(sources, F.lit(0))).otherwise(F.lit(0.0))
    return counted.withColumns({"figures_extracted_total": F.col("figure_blocks") + F.col("figure_placeholders"), "math_extraction_rate": rate})


def semantic_atoms(mathml: Column) -> Column:
    return count(mathml, r"(?i)<(?:mi|mn|mtext|mo)(?=[\s>/])")


def empty_scripts(mathml: Column) -> Column:
    return sum((count(mathml, p) for p in EMPTY_SCRIPTS[1:]), count(mathml, EMPTY_SCRIPTS[0]))


def is_single_character(mathml: Column) -> Column:
    return (semantic_atoms(mathml) <= 1).cast("int")


def blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, idx, tag, level, text``: headings and paragraphs of each page, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:h[1-6]|p)\b[^>]*>.*?</(?:h[1-6]|p)>)"), 1)
    rows = df.select(key, F.posexplode(found).alias("idx", "block"))
    tag = F.lower(F.regexp_extract("block", r"^<([A-Za-z0-9]+)", 1))
    return rows.select(key, "idx", tag.alias("tag"), F.try_to_number(F.nullif(F.regexp_extract(tag, "h([1-6])", 1), F.lit("")), F.lit("9")).cast("int").alias("level"), tag_free("block").alias("text"))


def tag_free(column: str | Column) -> Column:
    bare = F.regexp_replace(column, "(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", "\u00a0"), ("&#160;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return collapse_white_space(bare)


def equation_images(html: Column) -> Column:
    """Images of class ``equation`` as formulas of their alternative text; those without one stay."""

    def formula(image: Column) -> Column:
        alt = F.regexp_replace(F.regexp_extract(image, EQUATION_IMAGE, 1), f"^{SPACE}+|{SPACE}+$", "")
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            alt = F.replace(alt, F.lit(char), F.lit(entity))
        span = lambda alt: F.concat(F.lit('<span class="math-inline" data-latex="'), alt, F.lit('">'), alt, F.lit("</span>"))
        return let(alt, lambda alt: F.when(alt == "", image).otherwise(span(alt)))

    def joined(html: Column) -> Column:
        images, between = F.transform(F.regexp_extract_all(html, F.lit(EQUATION_IMAGE), 0), formula), F.split(html, EQUATION_IMAGE)
        pieces = F.zip_with(F.concat(F.array(F.lit("")), images), between, lambda image, after: F.concat(image, after))
        return F.array_join(pieces, "")

    return let(html, joined)


def word_html(html: Column) -> Column:
    """Office markup after the reference's eighteen rewrites, in its order (tags of shapes go before shapes do, so their content stays)."""
    for pattern, by in WORD_RULES:
        html = F.regexp_replace(html, pattern, by)
    html = equation_images(html)
    for pattern, by in LATER_WORD_RULES:
        html = F.regexp_replace(html, pattern, by)
    return html
