"""Incremental corpus jobs as streams: the same plans over new files, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from glossweave.sources.corpus import tokens


def read_files(spark: SparkSession, path: str, schema: StructType | str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def word_counts(documents: DataFrame) -> DataFrame:
    """word, n so far; for complete or update mode."""
    return tokens(documents).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


def upsert_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch goes to a folder named by its number, written over when the batch is run again."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of tumbling or sliding windows; events later than the watermark are dropped."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of runs of events with no longer pause than ``gap``."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
