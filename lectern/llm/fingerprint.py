"""Document fingerprints: a threshold-scaled sketch, with DataFrame functions only.

A fingerprint is every hash, among those of all shingles of five words, that
lies below a fixed fraction of the hash range.  Its size grows with the
document, so sketches of very unequal documents can be compared, and the sketch
of a union is the union of the sketches.  Short documents may have no hash that
low.  Beside the sketch, and no part of it, is the smallest hash of all shingles;
it alone tells documents with empty sketches apart.

Defined results: a null text is an empty one and has no smallest hash; fewer
than five words form one shingle; two empty sketches are alike (1) if their
smallest hashes are equal, and else not (0), as an empty and another are not;
containment of an empty sketch is null, but 1 for a text without words;
repeated rows have equal fingerprints; in ``with_next`` the order is doc_id
(null first), then text, and the next of the last document is the first, so a
lone document is its own next; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WORDS = 5
#: Hashes with so many leading zero bits are kept: one in eight.
ZERO_BITS = 3
#: Documents in a stretch of the order, and stretches at most; beyond 262 million documents stretches grow, and their tasks spill.
STRETCH, STRETCHES = 4_000, 65_536
LOWEST = -(1 << 63)


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_sketch(df: DataFrame, text: str, sketch: str, words: int = WORDS, zero_bits: int = ZERO_BITS) -> DataFrame:
    """``df`` with the sorted kept hashes of ``text``, and in ``<sketch>_least`` the smallest of all.

    The steps are columns of their own, used more than once each, so that
    Catalyst computes them once a row and not once a shingle.
    """
    hashes, shingles = f"__hashes_{sketch}", f"__shingles_{sketch}"
    n = F.size(hashes)
    rolled = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(F.slice(hashes, i, words)))
    low = F.array_distinct(F.filter(shingles, lambda h: F.shiftrightunsigned(h, 64 - zero_bits) == 0))
    return (
        df.withColumn(hashes, word_hashes(F.col(text)))
        .withColumn(shingles, F.when(n >= words, rolled).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>")))
        .withColumn(sketch, F.array_sort(low))
        .withColumn(f"{sketch}_least", F.array_min(shingles))
        .drop(hashes, shingles)
    )


def merged(a: Column, b: Column) -> Column:
    """The sketch of both documents together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column, least_a: Column | None = None, least_b: Column | None = None) -> Column:
    """Estimated share of common shingles among all of both."""
    same = F.lit(True) if least_a is None or least_b is None else least_a.eqNullSafe(least_b)
    empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(empty, same.cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column, least_a: Column | None = None) -> Column:
    """Estimated share of the shingles of ``a`` that are in ``b``; null where the sketch of ``a`` is empty though it has words."""
    wordless = F.lit(True) if least_a is None else least_a.isNull()
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).when(wordless, F.lit(1.0))


def printed(sketch: Column, least: Column) -> Column:
    """The sketch as hexadecimal digits, sixteen for each hash; of an empty one, the smallest hash after a hyphen."""
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.lower(F.when(F.size(sketch) > 0, F.array_join(F.transform(sketch, digits), "")).otherwise(F.coalesce(F.concat(F.lit("-"), digits(least)), F.lit(""))))


def stretch_starts(keys: DataFrame) -> list[int]:
    """Keys at which the stretches of the order begin; each is a key of the table."""
    n, least = keys.agg(F.count("*"), F.min("key")).first()
    parts = min(STRETCHES, n // STRETCH)
    if parts < 2:
        return [least] if n else []
    cuts = keys.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], max(10_000, 10 * parts))).first()[0]
    return sorted({least, *cuts})


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """``docs`` with ``next_<column>``: the values of the next document in ascending order of ``key``.

    The order is cut into stretches, each dealt to a task.  The document that
    begins a stretch also goes, as a guest, to the end of the stretch before
    (the very first to the last), so one shuffle and one window do.
    """
    keyed = docs.withColumn("__key", F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)))
    starts = stretch_starts(keyed.select(F.col("__key").alias("key")))
    if not starts:
        return docs.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in columns])
    table = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    steps = max(1, (len(starts) - 1).bit_length())
    # Binary search: the last start that is not above the key.
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    found = F.aggregate(
        powers, F.lit(0),
        lambda at, by: F.when((at + by < len(starts)) & (F.get(table, at + by) <= F.col("__key")), at + by).otherwise(at),
    )
    before = F.when(F.col("__at") > 0, F.col("__at") - 1).otherwise(F.lit(len(starts) - 1))
    seats = F.array(F.struct(F.col("__at").alias("stretch"), F.lit(False).alias("guest")))
    both = F.concat(seats, F.array(F.struct(before.alias("stretch"), F.lit(True).alias("guest"))))
    seated = keyed.withColumn("__at", found).withColumn("__seat", F.explode(F.when(F.get(table, F.col("__at")) == F.col("__key"), both).otherwise(seats)))
    order = W.partitionBy("__seat.stretch").orderBy("__seat.guest", "__key", *[c for c in columns if c != key])
    led = seated.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where(~F.col("__seat.guest")).drop("__key", "__at", "__seat")


def edited_documents(docs: DataFrame) -> DataFrame:
    """Sketches of every text, of the next one's, and of the text whose second half the next one's beginning replaces."""
    own = with_sketch(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sketch")
    led = with_next(own, ["text", "sketch", "sketch_least"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    out = led.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "sketch_least", "next_sketch", "next_sketch_least", edited.alias("edited"))
    return with_sketch(out, "edited", "edited_sketch")
