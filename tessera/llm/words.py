"""Words and shingles as DataFrame expressions.

A word is a maximal run of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space characters between words.
SPACES = " \t\n\x0b\x0c\r"
GAP = "[\\x20\\x09-\\x0D]+"
SHINGLE_WORDS = 5


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def hashes(words: Column) -> Column:
    """64-bit hashes of the words."""
    return F.transform(words, lambda w: F.xxhash64(w))


def runs(word_hashes: Column, width: int) -> Column:
    """A hash of each run of `width` words, in order; none if there are fewer."""
    starts = F.sequence(F.lit(1), F.size(word_hashes) - (width - 1))
    return F.when(F.size(word_hashes) < width, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.xxhash64(F.slice(word_hashes, i, width))))
