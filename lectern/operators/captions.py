"""Ordered logic over paragraphs: captions, sections, references.

Every window is partitioned by document; frames are those of the bounded scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import text as X


def ordered(key: str = "doc", idx: str = "idx") -> W:
    return W.partitionBy(key).orderBy(idx)


def running(key: str = "doc", idx: str = "idx") -> W:
    return ordered(key, idx).rowsBetween(W.unboundedPreceding, W.currentRow)


def preceding_caption(text: Column, window: W) -> Column:
    """The text of the row before, if it is a caption."""
    return F.lag(F.when(X.is_caption(text), text)).over(window)


def caption_gaps(df: DataFrame, key: str, idx: str, text: str) -> DataFrame:
    """Numbers left out between one figure caption and the next, per document."""
    numbered = df.withColumn("__n", X.caption_number(F.col(text)))
    jumps = numbered.where(F.col("__n").isNotNull()).withColumn("__jump", F.greatest(F.col("__n") - F.lag("__n").over(ordered(key, idx)) - 1, F.lit(0)))
    gaps = jumps.groupBy(key).agg(F.coalesce(F.sum("__jump"), F.lit(0)).alias("caption_gaps"))
    return df.select(key).distinct().join(gaps, key, "left").select(key, F.coalesce("caption_gaps", F.lit(0)).alias("caption_gaps"))


def nearest_following(df: DataFrame, key: str, idx: str, kind: str, text: str, reach: int) -> Column:
    """For an image: the caption after it, at most ``reach`` rows on, with nothing but blank rows between."""
    after = ordered(key, idx).rowsBetween(1, reach)
    solid = F.col(kind).isin("image", "table") | (F.col(text) != "")
    first = F.first(F.when(solid, F.struct(F.col(kind).alias("kind"), F.col(text).alias("text"))), ignorenulls=True).over(after)
    return F.when(F.col(kind) == "image", F.when((first["kind"] == "paragraph") & X.is_caption_of_block(first["text"]), first["text"]))


def nearest_preceding(df: DataFrame, key: str, idx: str, kind: str, text: str, reach: int) -> Column:
    before = ordered(key, idx).rowsBetween(-reach, -1)
    solid = F.col(kind).isin("image", "table") | (F.col(text) != "")
    last = F.last(F.when(solid, F.struct(F.col(kind).alias("kind"), F.col(text).alias("text"))), ignorenulls=True).over(before)
    return F.when(F.col(kind) == "image", F.when((last["kind"] == "paragraph") & X.is_caption_of_block(last["text"]), last["text"]))


def report_caption_before(text: Column, key: str, idx: str, reach: int = 3) -> Column:
    """The last caption of the few rows before, whatever stands between."""
    return F.last(F.when(X.is_caption(text), text), ignorenulls=True).over(ordered(key, idx).rowsBetween(-reach, -1))


def claimed_captions(df: DataFrame, key: str, idx: str, kind: str, text: str, forward: int = 3, backward: int = 4) -> DataFrame:
    """``key, idx, caption_idx``: each image with its caption, or null.

    Images and captions that alternate with little but blank rows between them
    form a chain; whichever comes first takes the next, so a chain falls into
    pairs from its beginning.  An image left over takes the caption a row farther
    back, if that is left over too.
    """
    w, row = ordered(key, idx), F.row_number().over(ordered(key, idx))
    what = F.when(F.col(kind) == "image", "image").when((F.col(kind) == "paragraph") & X.is_caption_of_block(F.col(text)), "caption").when((F.col(kind) != "paragraph") | (F.col(text) != ""), "other")
    solid = df.select(key, idx, what.alias("what"), row.alias("row")).where(F.col("what").isNotNull())
    apart, other = F.col("row") - F.lag("row").over(w), F.lag("what").over(w)
    pair = F.array_contains(F.array(F.lit("image caption"), F.lit("caption image")), F.concat_ws(" ", "what", other))
    linked = solid.withColumn("linked", F.coalesce(pair & (apart <= forward), F.lit(False))).withColumn("far", F.coalesce((other == "caption") & (apart <= backward), F.lit(False)))
    chained = linked.withColumn("chain", F.sum((~F.col("linked")).cast("int")).over(running(key, idx)))
    placed = chained.withColumn("second", F.row_number().over(W.partitionBy(key, "chain").orderBy(idx)) % 2 == 0)
    before, after = F.lag(idx).over(w), F.lead(idx).over(w)
    takes = ~F.col("second") & F.coalesce(F.lead("linked").over(w), F.lit(False))
    spare = F.col("far") & ~F.col("linked") & ~F.lag("second").over(w)
    found = placed.withColumn("caption_idx", F.when(F.col("second"), before).when(takes, after).when(spare, before))
    return found.where(F.col("what") == "image").select(key, idx, "caption_idx")


def sections(df: DataFrame, key: str, idx: str, heading_type: str) -> DataFrame:
    """``df`` with the type of the heading that each row stands under; rows before the first have none."""
    return df.withColumn("section", F.last(heading_type, ignorenulls=True).over(running(key, idx)))


def preamble(df: DataFrame, key: str, idx: str, heading_type: str) -> DataFrame:
    """``df`` with whether a row stands before the first heading of the body."""
    first = F.min(F.when(F.col(heading_type).isin(*X.BODY_SECTIONS), F.col(idx))).over(W.partitionBy(key))
    return df.withColumn("in_preamble", F.coalesce(F.col(idx) < first, F.lit(True)))


def english_part(df: DataFrame, key: str, idx: str, style: str) -> DataFrame:
    """``df`` with whether a second title has been seen, which stays so."""
    titles = F.sum((F.col(style) == "title").cast("int")).over(running(key, idx))
    return df.withColumn("in_english", F.coalesce(titles, F.lit(0)) >= 2)


def reference_rows(df: DataFrame, key: str, idx: str, text: str) -> DataFrame:
    """Paragraphs of the list of references, numbered, up to the first that ends it."""
    stopped = df.withColumn("__stop", F.max(X.is_reference_stop(F.col(text)).cast("int")).over(running(key, idx)))
    kept = stopped.where((F.col("__stop") == 0) & (F.col(text) != ""))
    return kept.drop("__stop").withColumn("n", F.row_number().over(ordered(key, idx)))


def caption_runs(df: DataFrame, key: str, idx: str, text: str, most: int = 4) -> DataFrame:
    """Captions in a row, at most ``most`` of them: the number of the run and the place in it."""
    group = df.withColumn("__caption", X.is_caption(F.col(text))).withColumn("run", F.sum((~F.col("__caption")).cast("int")).over(running(key, idx)))
    place = group.where("__caption").withColumn("place", F.row_number().over(W.partitionBy(key, "run").orderBy(idx)))
    return place.where(F.col("place") <= most).drop("__caption")


def figure_texts(captions: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Short captions and the texts collected at the end, paired by order; fewer texts belong to the last captions."""
    rank = F.row_number().over(ordered(key))
    a = captions.withColumn("ord", rank).withColumn("n_captions", F.count("*").over(W.partitionBy(key)))
    b = texts.withColumn("text_ord", rank).withColumn("n_texts", F.count("*").over(W.partitionBy(key)))
    counts = b.groupBy(key).agg(F.max("n_texts").alias("n_texts"))
    shifted = a.join(counts, key).withColumn("text_ord", F.col("ord") - F.greatest(F.col("n_captions") - F.col("n_texts"), F.lit(0)))
    return shifted.drop("n_texts").join(b.select(key, "text_ord", F.col("text").alias("full_text")), [key, "text_ord"]).select(key, "idx", "text", "full_text")
