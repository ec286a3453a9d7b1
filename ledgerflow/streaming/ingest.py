"""Ledger drops as a stream: typed rows, each row once, monthly totals by label. An addition to the batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ledger_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def once(rows: DataFrame, event_time: str = "loaded_at", delay: str = "1 day") -> DataFrame:
    """Each row id once within the watermark."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["row_id"])


def windowed_totals(rows: DataFrame, event_time: str = "loaded_at", width: str = "1 day", delay: str = "1 day") -> DataFrame:
    w = F.window(event_time, width)
    return rows.withWatermark(event_time, delay).groupBy(w.alias("w"), "pair_id", "type_label").agg(F.sum("net").alias("net"), F.count("*").alias("rows"))
