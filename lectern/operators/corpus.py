"""Corpus totals, regressions against a baseline, reconciliation, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.html import LOWER_IS_BETTER, METRICS, count

# Metrics of formula quality for which more is better; less is better for all others.
QUALITY_HIGHER = ("formulas_total", "figure_count", "metadata_completeness_pct", "bilingual_extraction_score")
LEAST_FILES = 5


def totals(files: DataFrame, metrics=METRICS, error: str = "parse_error") -> DataFrame:
    """One row: files read and failed, sums and means over those read (0 if there are none)."""
    ok = F.col(error).isNull()
    sums = [F.coalesce(F.sum(F.when(ok, F.coalesce(m, F.lit(0)))), F.lit(0)).alias(f"sum_{m}") for m in metrics]
    means = [F.coalesce(F.avg(F.when(ok, F.coalesce(m, F.lit(0)))), F.lit(0.0)).alias(f"mean_{m}") for m in metrics]
    return files.agg(F.count_if(ok).alias("files_ok"), F.count_if(~ok).alias("files_error"), *sums, *means)


def quality_totals(files: DataFrame, metrics, error: str = "parse_error") -> DataFrame:
    """Plain sums over files read; the bilingual score is a mean over those that have one."""
    ok = F.col(error).isNull()
    return files.agg(
        *[F.coalesce(F.sum(F.when(ok, F.col(m))), F.lit(0)).alias(m) for m in metrics if m != "bilingual_extraction_score"],
        F.avg(F.when(ok, F.col("bilingual_extraction_score"))).alias("bilingual_extraction_score"),
    )


def long_form(files: DataFrame, key: str, metrics) -> DataFrame:
    return files.select(key, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))


def regressions(baseline: DataFrame, current: DataFrame, key: str = "file", metrics=METRICS, lower=LOWER_IS_BETTER, error: str | None = "parse_error") -> DataFrame:
    """Metrics that changed, of files in both: ``key, metric, before, after, delta, verdict``.

    Values missing on either side and equal values are passed over; a file that
    fails now and did not before is a regression without numbers.
    """
    both = long_form(baseline, key, metrics).withColumnRenamed("value", "before").join(long_form(current, key, metrics).withColumnRenamed("value", "after"), [key, "metric"])
    changed = both.where(F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("before") != F.col("after")))
    worse = F.when(F.col("metric").isin(*lower), F.col("after") > F.col("before")).otherwise(F.col("after") < F.col("before"))
    out = changed.select(key, "metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"), F.when(worse, "regression").otherwise("improvement").alias("verdict"))
    if error:
        none = F.lit(None).cast("double")
        failed = current.select(key, F.col(error).alias("now")).join(baseline.select(key, F.col(error).alias("was")), key).where(F.col("was").isNull() & F.col("now").isNotNull())
        out = out.unionByName(failed.select(key, F.lit("parse_error").alias("metric"), none.alias("before"), none.alias("after"), none.alias("delta"), F.lit("regression").alias("verdict")))
    return out


def quality_regressions(baseline: DataFrame, current: DataFrame, metrics) -> DataFrame:
    """The same over totals, one row each."""
    lower = tuple(m for m in metrics if m not in QUALITY_HIGHER)
    return regressions(baseline.withColumn("file", F.lit("totals")), current.withColumn("file", F.lit("totals")), "file", metrics, lower, None).drop("file")


def short_hash(latex: Column, digits: int = 12) -> Column:
    return F.substring(F.sha1(latex), 1, digits)


def reconcile(equations: DataFrame, emitted: DataFrame) -> DataFrame:
    """Display equations of the source against blocks of the output.

    ``equations``: doc, seq, target, label, latex; ``emitted``: doc, pos, target, label, latex.
    A source with a target meets the first block of that target; one without
    meets the first block of equal LaTeX, by hash.  ``mismatch`` has one row per
    difference; equations without any are left out.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    block = F.min_by(F.struct("label", "latex"), "pos")
    by_target = emitted.where(F.col("target").isNotNull()).groupBy("doc", "target").agg(block.alias("block"))
    by_hash = emitted.groupBy("doc", short_hash(flat(F.col("latex"))).alias("hash")).agg(block.alias("hash_block"))
    found = (
        equations.withColumn("hash", short_hash(flat(F.col("latex"))))
        .join(by_target, ["doc", "target"], "left")
        .join(by_hash, ["doc", "hash"], "left")
        .withColumn("met", F.when(F.col("target").isNotNull(), F.col("block")).otherwise(F.col("hash_block")))
    )
    none = F.col("met").isNull()
    other_label = ~F.coalesce(F.col("label"), F.lit("")).eqNullSafe(F.coalesce(F.col("met.label"), F.lit("")))
    other_latex = flat(F.col("latex")) != flat(F.col("met.latex"))
    kinds = F.array_compact(F.array(F.when(none, "missing-dom-block"), F.when(~none & other_label, "label-mismatch"), F.when(~none & other_latex, "latex-mismatch")))
    return found.select("doc", "seq", F.explode(kinds).alias("mismatch"))


def mismatch_total(reports: DataFrame) -> DataFrame:
    """A report that failed counts as one mismatch."""
    return reports.agg(F.coalesce(F.sum(F.when(F.col("error").isNotNull(), 1).otherwise(F.col("mismatches"))), F.lit(0)).alias("mismatch_total"))


def top_warnings(warnings: DataFrame, most: int = 3) -> DataFrame:
    """The most frequent kinds; ties in order of first appearance."""
    counted = warnings.groupBy("type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen").limit(most)


def checked_baseline(files: DataFrame, least: int = LEAST_FILES, error: str = "parse_error") -> DataFrame:
    """``files``, or an error if a baseline of them would be worthless: too few, or none that could be read."""
    n, ok = files.agg(F.count("*"), F.count_if(F.col(error).isNull())).first()
    if n < least:
        raise ValueError(f"a baseline needs {least} files, not {n}")
    if not ok:
        raise ValueError("no file could be read")
    return files


def checked_quality(files: DataFrame, metrics, least: int = LEAST_FILES, error: str = "parse_error") -> DataFrame:
    """The totals of ``quality_totals``, or an error if they are worthless: too few files, none read, or nothing but zeros."""
    totals = quality_totals(checked_baseline(files, least, error), metrics, error)
    if not any(totals.first()):
        raise ValueError("the totals are all zero")
    return totals


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A baseline: rows of JSON as ``write_baseline`` leaves them, or one document with its rows under ``results``."""
    rows = spark.read.option("multiLine", "true").json(path) if path.endswith(".json") else spark.read.json(path)
    return rows.select(F.inline("results")) if "results" in rows.columns else rows


def in_order(files: DataFrame, key: str = "file") -> DataFrame:
    """Files in the order of their names' code points."""
    return files.orderBy(F.col(key))


def first_failures(files: DataFrame, key: str = "file", error: str = "parse_error", most: int = 10) -> DataFrame:
    """The first files that failed, in order of their names."""
    return files.where(F.col(error).isNotNull()).select(key, error).orderBy(key).limit(most)


def natural_rank(items: DataFrame, name: str = "name") -> DataFrame:
    """``items`` with ``number``, the first number in the name; ordered by it, then by the name."""
    return items.withColumn("number", F.nullif(F.regexp_extract(name, "([0-9]+)", 1), F.lit("")).cast("long")).orderBy("number", name)


def header_totals(documents: DataFrame, key: str = "doc", html: str = "html") -> DataFrame:
    """``key, formulas_block, formulas_inline, figures, tables``: what an artifact's header counts in the markup."""
    counted = {
        "formulas_block": r'<[a-z]+\b[^>]*class="(?:[^"]*\s)?math-block[\s"]', "formulas_inline": r'<[a-z]+\b[^>]*class="(?:[^"]*\s)?math-inline[\s"]',
        "figures": r'<figure\b[^>]*class="(?:[^"]*\s)?figure-block[\s"]', "tables": r"<table(?![A-Za-z0-9_])",
    }
    return documents.select(key, *[count(F.col(html), pattern).alias(name) for name, pattern in counted.items()])


def gate(regressions: DataFrame) -> int:
    """0 if nothing got worse, else 1: the exit code of a comparison."""
    return int(bool(regressions.where(F.col("verdict") == "regression").limit(1).count()))


def report_lines(regressions: DataFrame, key: str = "file") -> DataFrame:
    """A line of text for each change, those for the worse first."""
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    sign = F.when(F.col("delta") >= 0, "+").otherwise("")
    change = F.when(F.col("delta").isNull(), F.col("metric")).otherwise(F.concat("metric", F.lit(": "), number("before"), F.lit(" → "), number("after"), F.lit(" ("), sign, number("delta"), F.lit(")")))
    line = F.concat(F.upper("verdict"), F.lit(": "), F.col(key).cast("string"), F.lit(" — "), change)
    return regressions.orderBy(F.desc("verdict"), key, "metric").select(line.alias("line"))


def write_baseline(files: DataFrame, path: str) -> None:
    checked_baseline(files).write.mode("overwrite").json(path)


def write_artifacts(records: DataFrame, path: str) -> None:
    """Records of each document under a folder of its slug."""
    records.write.mode("overwrite").partitionBy("slug").json(path)
