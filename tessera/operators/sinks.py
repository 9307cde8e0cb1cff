"""Changes to tables kept as Parquet, as new versions of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def updated(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with columns set where a condition holds."""
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(rows: DataFrame, where: Column) -> DataFrame:
    return rows.filter(~F.coalesce(where, F.lit(False)))


def upserted(rows: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows with those of the same key replaced, and new keys added."""
    return rows.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def appended(spark: SparkSession, path: str, rows: DataFrame, at: Column) -> None:
    """Audit rows added to a log, stamped, in files of their own."""
    rows.withColumn("logged_at", at).write.mode("append").parquet(path)


def replaced(spark: SparkSession, path: str, rows: DataFrame, columns: list[str]) -> list[str]:
    """Write rows with the columns that the table has; the names of the others
    are returned. Rows may be read from the table itself: they are written
    beside it first."""
    kept = rows.select([c for c in rows.columns if c in columns])
    beside = f"{path}.next"
    kept.write.mode("overwrite").parquet(beside)
    spark.read.schema(kept.schema).parquet(beside).write.mode("overwrite").parquet(path)
    return [c for c in rows.columns if c not in columns]
