"""Mixing sources to target weights, with DataFrame functions only.

``plan_mix`` decides how often every document is repeated; ``mix`` emits the
documents that often.

Tokens are runs of non-blank characters.  Sources, ordered by code point with
the null source last, take the weights of ``weights`` in turn.  Together they
get ``budget`` times all tokens; a source's target never exceeds ``max_repeat``
times its own tokens, and what is cut off is shared again by weight among the
others.  A document is emitted ``floor(rate)`` times with ``rate = target /
source tokens``, plus once more if a hash of the seed, its id and its text, read
as a number in [0, 1), is below the fraction.

Defined results: a null text has size 0; a null source is a source of its own;
a source without any token has target 0 and rate 0; repeated rows draw the same
number and are emitted alike; an empty table gives an empty result.  Extra
columns, whatever their names, pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_REPEAT = 2
SEED = 17
#: The table of sources is broadcast up to this many rows and bytes of names; beyond, it is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 2_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the document alone."""
    key = F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size`` -> the same with ``target`` and ``rate``.

    Sorted by cap over weight, the sources that end at their cap are a prefix:
    a source belongs to it while its cap over weight is at most what a unit of
    weight would get from what the earlier caps leave.  What it gets at the
    first source beyond the prefix, the most of all beyond it, is the level.  The
    windows run over one row per source.
    """
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", F.element_at(cycle, (n % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeat)
        .withColumn("total", F.sum("source_size").over(everything).cast("double") * F.lit(float(budget)))
        .withColumn("all_weight", F.sum("weight").over(everything))
    )
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    leveled = (
        ranked.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("unit", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("capped", F.col("cap") / F.col("weight") <= F.col("unit"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("unit"))).over(everything))
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(F.lit(0.0))
    return leveled.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """Columns ``doc`` (struct of the input's columns), ``size``, ``source_size``, ``target``, ``rate``, ``copies``.

    Two passes read the documents: one counts tokens per source (partial sums
    before the shuffle, so a hot source is one row per task), one attaches the
    rates.  Documents themselves are never shuffled while the table of sources
    is small enough to broadcast.
    """
    measured = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), word_count(F.col("text")).alias("size"))
    sizes = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, budget, max_repeat), "mix-targets")
    n, width = targets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    side = targets.withColumnRenamed("source", "of_source")
    side = F.broadcast(side) if n <= BROADCAST_ROWS and width <= BROADCAST_BYTES else side
    joined = measured.join(side, measured["doc.source"].eqNullSafe(F.col("of_source"))).drop("of_source")
    whole = F.floor("rate").cast("long")
    extra = (draw(F.col("doc.doc_id"), F.col("doc.text"), seed) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", whole + extra)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the input's columns; a repeated document is as many rows."""
    planned = plan_mix(docs, **options).where(F.col("copies") > 0)
    return planned.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
