"""Find and replace over plain text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CHAR = r"[\p{L}\p{M}\p{N}_]"


def quoted(text: str) -> str:
    """``text`` as a pattern that matches itself."""
    return "".join(c if c.isalnum() or c in " _" or ord(c) > 127 else f"\\{c}" for c in text)


def pattern_of(query: str, case: bool = False, word: bool = False, regex: bool = False) -> str | None:
    """The Java pattern of a search; None if there is nothing to search for or the pattern is no valid one."""
    if not query:
        return None
    if regex:
        try:
            re.compile(query)
        except re.error:
            return None
    body = query if regex else quoted(query)
    flags = "(?u)" if case else "(?iu)"
    return flags + (rf"(?<!{WORD_CHAR}){body}(?!{WORD_CHAR})" if word and not regex else body)


def count(text: Column, query: str, **options) -> Column:
    """Matches of a search.  Literal ones may overlap: each place where the query stands counts."""
    pattern = pattern_of(query, **options)
    if pattern is None:
        return F.lit(0)
    if not options.get("regex"):
        flags, body = pattern[: pattern.index(")") + 1], pattern[pattern.index(")") + 1 :]
        pattern = f"{flags}(?={body})" if not options.get("word") else f"{flags}(?<!{WORD_CHAR})(?={body[body.index(')') + 1:]})"
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def spans(text: Column, query: str, case: bool = False) -> Column:
    """``array<struct<from, to>>`` of a literal search, overlapping matches included.

    The text is cut at the query's first characters only where it matches, so
    the work grows with the matches and not with the length.
    """
    hay = text if case else F.lower(text)
    needle = query if case else query.lower()
    n = len(needle)
    pieces = F.split(hay, f"(?={quoted(needle)})")
    ends = F.aggregate(
        F.transform(pieces, F.length),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, k: F.struct((s["at"] + k).alias("at"), F.array_append(s["starts"], s["at"] + k).alias("starts")),
    )["starts"]
    starts = F.array_distinct(F.concat(F.when(hay.startswith(needle), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), ends))
    return F.filter(F.transform(starts, lambda a: F.struct(a.alias("from"), (a + n).alias("to"))), lambda s: hay.substr(s["from"] + 1, F.lit(n)) == needle)


def replace_all(text: Column, query: str, by: str, **options) -> Column:
    """Every match replaced, from left to right without overlap; the replacement is taken literally."""
    pattern = pattern_of(query, **options)
    return text if pattern is None else F.regexp_replace(text, pattern, by.replace("\\", "\\\\").replace("$", "\\$"))


def replace_first(text: Column, query: str, by: str) -> Column:
    at = F.instr(text, query)
    return F.when(at > 0, F.concat(text.substr(F.lit(1), at - 1), F.lit(by), text.substr(at + len(query), F.length(text)))).otherwise(text)


def cycled(index: Column, step: int, n: Column) -> Column:
    """The index of the next or previous match, around the ends; null without matches."""
    return F.when(n > 0, F.pmod(index + step, F.nullif(n, F.lit(0))))
