"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Each step looks only at rows that the one before couldn't tell apart:

1. Rows are grouped by the length of their text.
2. Rows of lengths that occur twice are grouped by length and by a hash of the
   text's first characters.
3. Rows whose length and prefix occur twice have their full content hashed
   (SHA-256), and equal hashes are groups of equal texts.

Texts are never shuffled. What survives a step is kept as a bitmap, a Bloom
filter with one hash and a bounded size (`tables.bitmap`), which is broadcast and
looked up while the rows are read again: a row that passes by chance costs a
needless hash and nothing else. Groups of very many rows are joined to their
rows by a broadcast whose number of rows is bounded. Everything is DataFrame
expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bitmap, joined_to_groups, settled, tested
from .words import GAP

#: Characters of a text that its prefix hash covers.
PREFIX = 64


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), GAP, " ")


def _repeated(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop("n")


def _survivors(texts: DataFrame) -> DataFrame:
    """The bitmap of (length, prefix) that two rows or more of texts (text) share."""
    outline = F.octet_length("text").alias("length"), F.xxhash64(F.substring("text", 1, PREFIX)).alias("prefix")
    outlines = settled(texts.select(*outline), "outlines")
    lengths = bitmap(_repeated(outlines, ["length"]), ["length"])
    close = tested(outlines, lengths, ["length"]).filter("passed").select("length", "prefix")
    return bitmap(_repeated(close, ["length", "prefix"]), ["length", "prefix"])


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "keep_id", digest: str | None = None) -> DataFrame:
    """(key, keep, group_size, kept) of every row: the key of the row that
    stays among those of equal text, their number, and whether this row stays.

    Texts are equal when they are identical after each run of white space is
    replaced by one space; null counts as empty, so that null and empty texts
    form one group. The row with the least key stays; a null key comes after
    all others. Of repeated rows with one key and text one stays. An empty
    table gives no rows; other columns aren't read, so their names can't clash,
    but `key`, `keep`, `digest`, group_size and kept have to differ. Long texts
    are hashed whole.

    With `digest`, a further column of that name holds the SHA-256 of each
    normalised text in hexadecimal, for which texts that no other equals are
    hashed, too.
    """
    names = [key, keep, "group_size", "kept", *([digest] if digest else [])]
    if len(set(names)) < len(names):
        raise ValueError(f"columns of one name among {names}")
    rows = docs.select(F.col(key).alias("key"), normalised(F.col(text)).alias("text"))
    outlined = rows.withColumns({"length": F.octet_length("text"), "prefix": F.xxhash64(F.substring("text", 1, PREFIX))})
    marked = tested(outlined, _survivors(rows.select("text")), ["length", "prefix"])
    full = F.unhex(F.sha2("text", 256))
    hashed = marked.select("key", "passed", (full if digest else F.when(F.col("passed"), full)).alias("hash"))
    # A row's number lives in what is written, so that it stays what it was.
    hashed = settled(hashed.withColumn("row", F.monotonically_increasing_id()), "hashed")

    first = F.min(F.struct(F.col("key").isNull().alias("unknown"), "key", "row")).alias("first")
    groups = hashed.filter("passed").groupBy("hash").agg(F.count(F.lit(1)).alias("n"), first).filter(F.col("n") > 1)
    groups = settled(groups.select("hash", "n", F.col("first.key").alias("least"), F.col("first.row").alias("least_row")), "groups")
    grouped = joined_to_groups(hashed.filter("passed"), groups, "hash", "n", spread="row")
    alone = F.col("n").isNull()
    own = grouped.select(
        "key",
        F.when(alone, F.col("key")).otherwise(F.col("least")).alias("keep"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("least_row"))).alias("kept"),
        "hash",
    )
    single = hashed.filter("not passed").select("key", F.col("key").alias("keep"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "hash")
    found = own.unionByName(single)
    shown = [F.lower(F.hex("hash")).alias(digest)] if digest else []
    return found.select(F.col("key").alias(key), F.col("keep").alias(keep), "group_size", "kept", *shown)
