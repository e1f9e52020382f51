"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(col: Column | str) -> Column:
    """Lower case; runs of anything but letters and digits become one space; trimmed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def tokens(col: Column | str) -> Column:
    """The words of a normalised text; none for a blank or null one."""
    plain = F.coalesce(normalise(col), F.lit(""))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def bound(value: Column, body) -> Column:
    """body(value) with ``value`` computed once per row: inside a lambda the optimiser would inline it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(parts: Column, width: int, glue: str) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(parts) - (width - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(parts, i, width), glue)))


def word_shingles(words: Column, width: int) -> Column:
    """Distinct runs of ``width`` words; a shorter text is one run."""
    none = F.array().cast("array<string>")
    return bound(words, lambda w: F.when(F.size(w) == 0, none).otherwise(_runs(w, width, " ")))


def char_shingles(text: Column, width: int) -> Column:
    """Distinct runs of ``width`` characters; a shorter text is one run."""
    none = F.array().cast("array<string>")
    # positions of a string are found by a scan, those of an array are not
    chars = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, none).otherwise(F.split(text, ""))
    return bound(chars, lambda c: F.when(F.size(c) == 0, none).otherwise(_runs(c, width, "")))
