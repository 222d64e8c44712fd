"""A change log of commits, and streams over it and over event tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

SCHEMA = "at timestamp, tx long, source string, kind string, id string, row string"


class ChangeLog:
    """Appends every change as JSON rows in Parquet files; any number of readers follow it as a stream."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.tx = spark, path, int(time.time() * 1e6)

    def __call__(self, table: str, kind: str, rows: DataFrame) -> None:
        self.tx += 1
        key = next(x for x in ("_id", "_eid", "id") if x in rows.columns)
        log = rows.select(F.current_timestamp().alias("at"), F.lit(self.tx).alias("tx"), F.lit(table).alias("source"), F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.to_json(F.struct(*rows.columns)).alias("row"))
        log.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def stream(self) -> DataFrame:
        reader: DataStreamReader = self.spark.readStream
        return reader.schema(SCHEMA).parquet(self.path)


def _watched(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which needs a timestamp with a zone; a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type; works on batches and, with the watermark, on streams."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    kind = dict(events.dtypes)["ts"]
    kept = _watched(events, late)
    return kept.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast(kind).alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    kept = _watched(events, late)
    return kept.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
