"""The event log as a stream: running state and windowed counts, with the results of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of events, as they arrive in a folder. Times are UTC."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def running_state(events: DataFrame) -> DataFrame:
    """The latest event of each user so far, for update or complete mode; state is one row a user."""
    last = F.max_by(F.struct("event_type", "props"), "event_id")
    return events.groupBy("user_id").agg(last.alias("last"), F.count(F.lit(1)).alias("events")).select("user_id", "last.event_type", "last.props", "events")


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window; a window is final, and leaves the state, when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("start"), "event_type", "events")


def first_arrivals(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without those delivered again; ids older than the watermark leave the state."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def write_view(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over what there is and appends it to Parquet; checkpoint has to be a shared folder."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
