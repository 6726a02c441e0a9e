"""Scores of metadata, figures and formulas of imported documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import html as H
from lectern.functions import text as X
from lectern.functions.typography import collapse_white_space

TRUNCATED = 15


def filled(text: Column) -> Column:
    return F.coalesce(collapse_white_space(text) != "", F.lit(False))


def metadata_completeness(meta: Column) -> Column:
    """Percentage of eight fields that are there."""
    both = lambda lang: filled(meta["abstracts"][lang]) | filled(meta["abstract"][lang])
    checks = (
        filled(meta["title"]["ru"]), filled(meta["title"]["en"]), both("ru"), both("en"), F.coalesce(F.size(meta["keywords"]["ru"]) > 0, F.lit(False)),
        filled(meta["dates"]["received"]), filled(meta["dates"]["accepted"]), F.coalesce(F.exists(meta["contributors"], lambda c: c["is_corresponding"]), F.lit(False)),
    )
    return sum((c.cast("int") for c in checks), F.lit(0)) / len(checks) * 100


def bilingual_score(meta: Column) -> Column:
    """Does an English title go with the Russian one?  Null without a Russian one."""
    return F.when(filled(meta["title"]["ru"]), F.when(filled(meta["title"]["en"]), 100).otherwise(0))


def figures(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, idx, placeholder, caption``: the figures of each document; the Russian caption is preferred."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)(<figure\b[^>]*class="[^"]*figure-block[^"]*"[^>]*>.*?</figure>)'), 1)
    rows = df.select(key, F.posexplode(found).alias("idx", "block"))
    russian = F.regexp_extract("block", r'(?is)<figcaption\b[^>]*class="[^"]*figure-caption-ru[^"]*"[^>]*>(.*?)</figcaption>', 1)
    either = F.regexp_extract("block", r"(?is)<figcaption\b[^>]*>(.*?)</figcaption>", 1)
    caption = H.tag_free(F.when(russian != "", russian).otherwise(either))
    return rows.select(key, "idx", F.contains("block", F.lit("figure-placeholder")).alias("placeholder"), caption.alias("caption"))


def figure_scores(df: DataFrame, key: str, html: str) -> DataFrame:
    """Counts of figures and of numbers left out between their captions; markup is searched once, and one shuffle serves window and counts."""
    from lectern.operators.captions import ordered

    found = figures(df, key, html).withColumns({"n": X.caption_number(F.col("caption"))})
    short = (F.length("caption") > 0) & (F.length("caption") <= TRUNCATED) & X.is_caption_of_block(F.col("caption"))
    before = F.last("n", ignorenulls=True).over(ordered(key, "idx").rowsBetween(W.unboundedPreceding, -1))
    rows = found.select(key, "idx", "placeholder", "n", short.alias("short")).withColumn("jump", F.when(F.col("n").isNotNull(), F.greatest(F.col("n") - before - 1, F.lit(0))))
    counts = rows.groupBy(key).agg(
        F.count("*").alias("figure_count"), F.count_if("short").alias("figure_caption_truncated_count"), F.count_if("placeholder").alias("figure_placeholder_count"),
        F.coalesce(F.sum("jump"), F.lit(0)).alias("figure_caption_gap_count"),
    )
    return df.select(key).join(counts, key, "left").na.fill(0)


def untyped_headings(html: Column) -> Column:
    return H.count(html, r'(?i)<h[1-4]\b[^>]*data-section-type="other"')


def formula_scores(formulas: DataFrame, key: str) -> DataFrame:
    """Per document, over rows of ``mathml, latex_errors, display, warnings``."""
    kinds = lambda *names: F.count_if(F.exists("warnings", lambda w: w["type"].isin(*names)))
    return formulas.groupBy(key).agg(
        F.count("*").alias("formulas_total"),
        F.coalesce(F.sum(H.empty_scripts(F.col("mathml"))), F.lit(0)).alias("empty_script_count"),
        F.coalesce(F.sum(F.when(F.col("display"), H.is_single_character(F.col("mathml")))), F.lit(0)).alias("single_char_formula_count"),
        F.count_if(F.size("latex_errors") > 0).alias("latex_invalid_count"),
        kinds("embell-orphan").alias("orphan_decoration_count"), kinds("embell-decoration-unknown").alias("unknown_decoration_count"),
    )


def warning_histogram(formulas: DataFrame) -> DataFrame:
    return formulas.select(F.explode("warnings.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def coverage(formulas: DataFrame) -> DataFrame:
    """How many equations were decoded: longer than an empty element and with one in it."""
    good = (F.length("mathml") > 70) & F.contains("mathml", F.lit("<math"))
    return formulas.agg(F.count("*").alias("total"), F.count_if(F.coalesce(good, F.lit(False))).alias("decoded"))
