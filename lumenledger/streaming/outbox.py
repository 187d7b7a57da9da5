"""Projection of events to a bounded hot log, and event-time windows, as Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.sources.shared import shared_folder


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that a stream has now, written by micro-batches to the shared folder and read back."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{'events.parquet'}*")


def project(stream: DataFrame, key: str = "event_id", clock: str = "ts", late: str = "40 days") -> DataFrame:
    """Each event once, however often it is delivered within the time that late data has."""
    return stream.withColumn(clock, F.col(clock).cast("timestamp")).withWatermark(clock, late).dropDuplicatesWithinWatermark([key])


def hot(log: DataFrame, most: int, key: str = "event_id") -> DataFrame:
    """The newest `most` records of the log."""
    return log.orderBy(F.desc(key)).limit(most)


def latest_pointer(log: DataFrame, subject: str, key: str = "event_id") -> DataFrame:
    """subject and the last projected event of it."""
    return log.groupBy(subject).agg(F.max(key).alias("last_event"))


def tumbling(stream: DataFrame, width: str, late: str, clock: str = "ts") -> DataFrame:
    """start, event_type, events, total of every window of event time; closed ones only."""
    timed = stream.withColumn(clock, F.col(clock).cast("timestamp")).withWatermark(clock, late)
    return timed.groupBy(F.window(clock, width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select("window.start", "event_type", "events", "total")


def consume(batch: DataFrame, events: DataFrame, wanted: Column, most: int, key: str = "event_id") -> DataFrame:
    """The newest `most` wanted records of a bounded batch, or none of it where any record is repeated or differs from the ledger.

    The whole batch is judged before it is filtered. batch and events share the columns compared.
    """
    shown = [c for c in ("event_type", "user_id", "value") if c in batch.columns]
    true = events.select(key, F.struct(*shown).alias("true"))
    # The hot log's length bounds the batch.
    judged = batch.join(true.join(F.broadcast(batch.select(key).distinct()), key, "left_semi"), key, "left")
    same = F.struct(*shown).eqNullSafe(F.col("true"))
    fault = judged.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("twice"), F.max(~same).alias("other")).where("twice OR other").limit(1).select(F.lit(True).alias("fault"))
    return batch.where(wanted).join(F.broadcast(fault), how="left_anti").orderBy(F.desc(key)).limit(most)
