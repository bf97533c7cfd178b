"""The shield over files as they arrive, and windowed counts. Streams are an addition: the batch engine doesn't need them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rinsework.sources.shield import Facts, classify


def shield_stream(spark: SparkSession, source: str, facts: Facts, valid_to: str, quarantine_to: str, checkpoint: str, quotes: bool = True) -> StreamingQuery:
    """New text files under source are split line by line into two Parquet sinks. A batch is classified once; its folders carry the
    batch's number, so that a batch that is run again replaces its own output."""
    lines = classify(spark.readStream.text(source), facts, quotes)

    def both(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.filter("reason is null").select("line").write.mode("overwrite").parquet(f"{valid_to}/batch={number}")
            batch.filter("reason is not null").select("line", "reason").write.mode("overwrite").parquet(f"{quarantine_to}/batch={number}")
        finally:
            batch.unpersist()

    return lines.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key; with a stream, windows close once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
