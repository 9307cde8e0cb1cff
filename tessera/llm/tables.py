"""Input tables and shared storage of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers up to which a table is broadcast (some 30 MB).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    A cluster names it in spark.checkpoint.dir. Where that is unset in a local
    session, as in tests, a folder under /tmp is set; elsewhere that is an
    error, as executors wouldn't see each other's files there.
    """
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file:///tmp/tessera-shared"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage, keeps wide rows from being computed twice, and the
    copy outlives any executor.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    """`df`, marked for broadcasting if it has few enough rows; a larger one is
    left to be shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Groups that are broadcast as hot, at most; smaller ones need this many rows.
HOT_GROUPS = 100_000
HOT_ROWS = 1_000


def joined_to_groups(rows: DataFrame, groups: DataFrame, on: str, size: str, spread: str) -> DataFrame:
    """`rows` left-joined with `groups`, one row for each value of `on` (which
    isn't null) with its number of rows in `size`.

    No value gathers its rows in one task: groups that hold at least HOT_ROWS
    rows and one in HOT_GROUPS of all rows, at most HOT_GROUPS of them, are
    broadcast, and their rows are dealt out by `spread` in the shuffle that
    joins the rest.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) >= max(HOT_ROWS, -(-total // HOT_GROUPS))
    carried = [c for c in groups.columns if c != on]
    packed = groups.select(F.col(on).alias("group_on"), F.struct(*carried).alias("group"), is_hot.alias("is_hot"))
    hot = packed.filter("is_hot").select(F.col("group_on").alias("hot_on"), F.col("group").alias("hot"))
    cold = packed.filter("not is_hot").select("group_on", "group", F.lit(0).alias("group_salt"))
    marked = rows.join(F.broadcast(hot), F.col(on) == F.col("hot_on"), "left")
    marked = marked.withColumn("salt", F.when(F.col("hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 16))).cast("int"))
    joined = marked.join(cold, (F.col(on) == F.col("group_on")) & (F.col("salt") == F.col("group_salt")), "left")
    return joined.select(*(F.col(c) for c in rows.columns), *(F.coalesce(F.col("hot")[c], F.col("group")[c]).alias(c) for c in carried))


#: Words of 64 bits in a bitmap, at most: some 30 MB when broadcast.
PLACES = 1 << 20


def _bits(columns: list) -> tuple[Column, Column]:
    """The word and the bit of rows in a bitmap."""
    of = F.xxhash64(*columns)
    return F.shiftrightunsigned(of, 6).bitwiseAND(F.lit(PLACES - 1)).cast("int"), of.bitwiseAND(F.lit(63)).cast("int")


def bitmap(groups: DataFrame, columns: list) -> DataFrame:
    """(bitmap_place, bitmap_word): the bits of all rows of `groups` by their
    `columns`, in PLACES rows at most, however many rows there are."""
    place, bit = _bits(columns)
    marks = groups.select(place.alias("bitmap_place"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    return marks.groupBy("bitmap_place").agg(F.bit_or("bit").alias("bitmap_word"))


def tested(rows: DataFrame, marked: DataFrame, columns: list) -> DataFrame:
    """`rows` with `passed`: true for all rows whose `columns` are in the bitmap,
    and, where that is full, for others. The bitmap is broadcast."""
    place, bit = _bits(columns)
    found = rows.join(F.broadcast(marked), place == F.col("bitmap_place"), "left")
    own = F.call_function("shiftrightunsigned", F.col("bitmap_word"), bit).bitwiseAND(F.lit(1).cast("long"))
    return found.withColumn("passed", F.coalesce(own == 1, F.lit(False))).drop("bitmap_place", "bitmap_word")
