"""Streams of edits and of dropped files.

``save_points`` is a trailing debounce: a document is saved when no edit has come
for a while, which is the end of a session window.  ``latest_state`` reduces
edits to the state of each document.  ``import_stream`` reads archives as they
appear and hands each batch of blocks to a writer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.docx import read_blocks

DEBOUNCE = "3 seconds"


def save_points(edits: DataFrame, key: str = "doc", ts: str = "ts", gap: str = DEBOUNCE, late: str | None = "1 minute") -> DataFrame:
    """``key, started, saved_at, edits``: one row per pause of ``gap`` after edits; works on streams and on tables."""
    marked = edits.withWatermark(ts, late) if late and edits.isStreaming else edits
    return marked.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("edits")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("saved_at"), "edits")


def latest_state(edits: DataFrame, key: str = "doc", order: str = "seq", value: str = "text") -> DataFrame:
    """The value of the last edit of each document, and how many there were."""
    return edits.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order), F.count("*").alias("edits"))


def import_stream(spark: SparkSession, folder: str, checkpoint: str, write: Callable[[DataFrame, int], None]):
    """Starts reading archives under ``folder``; every batch of paragraphs goes to ``write`` with its number."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(folder)
    return files.writeStream.foreachBatch(lambda batch, n: write(read_blocks(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
