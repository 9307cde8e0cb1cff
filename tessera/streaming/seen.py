"""Seen-sets and counts, as batch operators and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder


def fresh(rows: DataFrame, seen: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    """Rows whose keys weren't seen before, the first of each in order."""
    new = rows if seen is None else rows.join(seen.select(*keys).distinct(), keys, "left_anti")
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    return first.select("r.*")


def fresh_stream(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """A stream's rows with keys not seen within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, time: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """Counts by window and keys, with a watermark for late rows."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def counted_stream(spark: SparkSession, path: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """Counts by key of the files at `path`, read as a stream.

    The run takes what there is and stops; its checkpoint and result stand in
    `folder`, so the same call goes on where a run broke off and adds files that
    came since. Without a folder a new one in the session's shared folder is
    taken, and the call starts from nothing.
    """
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rpartition("/")
    at = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{parent}/{name}*")
    out = f"{at}/out"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    run = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    last = spark.read.parquet(out)
    newest = last.agg(F.max("epoch")).first()[0]
    return last.filter(F.col("epoch") == newest).drop("epoch")
