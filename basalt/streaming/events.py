"""Windows over an event stream: tumbling, sliding, session and deduplication, with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators.recursive import shared_folder

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, watermark: str = "10 minutes") -> DataFrame:
    """The events table as a stream of its file, in event time."""
    if spark.read.parquet(f"{sf_dir}/events.parquet").schema["ts"].dataType.typeName() == "timestamp":
        schema = SCHEMA.replace("timestamp_ntz", "timestamp")
    else:
        schema = SCHEMA
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    return sliding(events, width, width)


def sliding(events: DataFrame, width: str = "1 day", slide: str = "6 hours") -> DataFrame:
    """window_start, event_type, n, total of every window that an event falls into."""
    grouped = events.groupBy(F.window("ts", width, slide).alias("w"), "event_type")
    made = grouped.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return made.select(F.col("w.start").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, session_start, session_end (last event plus the gap), n."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicate(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key that comes, among those within the watermark's reach."""
    return events.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def run_to_table(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run over all that is there and stop; the result is a table.

    Append mode gives out a window when the watermark has passed it, so a run over finished input holds
    back the last windows; complete mode gives out all.
    """
    spark = stream.sparkSession
    base = folder or shared_folder(spark)
    path = f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/data")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
