"""Input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks a core for rows that are much work each.
TASKS_PER_CORE = 4


def dealt_evenly(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that are much work each, dealt to all cores, by keys if there are
    any: a join of few bytes that makes many rows isn't left to few tasks."""
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, *keys)


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are much work each, dealt to all cores. A task reads
    megabytes of a file, or a row group at least: of narrow rows that is a
    million, and the work of a whole table would lie in one or two tasks."""
    return dealt_evenly(table(spark, sf_dir, name))


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the cluster names it in
    spark.checkpoint.dir; a local session without one gets a folder in /tmp,
    elsewhere that is an error."""
    key = "spark.checkpoint.dir"
    at = spark.sparkContext.getConf().get(key, "") or spark.conf.get(key, "")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or "file:///tmp/tessera-shared").rstrip("/")


def written(df: DataFrame, at: str) -> DataFrame:
    """`df` written to a folder and read back, which cuts its lineage."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows of a few values up to which a table is broadcast (some 30 MB).
BROADCAST_ROWS = 1_000_000


def sent_if_small(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcasting if it has few enough rows, which are
    counted; a larger one is left to be shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
