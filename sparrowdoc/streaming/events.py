"""Structured Streaming over events and logs; each has the same plan as its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import LOG


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Event files as a stream; ``ts`` becomes a TIMESTAMP, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG).json(path).withColumn("at", F.to_timestamp("timestamp"))


def tumbling(events: DataFrame, *, window: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; ``late`` sets the watermark."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, *, window: str = "2 hours", step: str = "1 hour", late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", window, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(events: DataFrame, *, gap: str = "30 minutes", by: str = "user_id", late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, then stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_status(batches: DataFrame, apply) -> object:
    """A stream of status events, each micro-batch handed to ``apply(rows, epoch)``."""
    return batches.writeStream.foreachBatch(apply).trigger(availableNow=True).start()


def progress(events: DataFrame, *, by: str = "req_id", late: str = "10 minutes", timeout: str = "60 seconds") -> DataFrame:
    """(by, window, stages, last_stage, n): progress events of requests as sessions that end ``timeout`` after the last one.

    Events (by, at, stage) come late by up to ``late``; older ones are dropped. The stages are in order of time.
    """
    w = F.session_window("at", timeout)
    rows = events.withWatermark("at", late).groupBy(by, w.alias("window")).agg(F.array_sort(F.collect_list(F.struct("at", "stage"))).alias("_e"))
    return rows.select(by, "window", F.transform("_e", lambda e: e["stage"]).alias("stages"), F.element_at("_e", -1)["stage"].alias("last_stage"), F.size("_e").alias("n"))


#: Stages of a request in order; optional ones may be missing, after done or error nothing follows.
STAGES = ("planning", "hyde", "retrieving", "reviewing", "drafting", "verifying", "retrying", "done", "error")


def outcome(sessions_: DataFrame) -> DataFrame:
    """Sessions with ``outcome``: done, error, or timeout for those that ended in another stage."""
    last = F.col("last_stage")
    return sessions_.withColumn("outcome", F.when(last.isin("done", "error"), last).otherwise("timeout"))


def log_windows(log: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, n, passed, mean_confidence) of a log stream (at, passed, confidence, attempts): errors count as failed."""
    rows = log.withWatermark("at", late).groupBy(F.window("at", window).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("passed") & (F.col("attempts") > 0)).alias("passed"), F.round(F.avg("confidence"), 4).alias("mean_confidence")).select(F.col("w.start").alias("start"), "n", "passed", "mean_confidence")
