"""Progress events: one set of column expressions for batch and for Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def scaled(done: Column, total: Column, status: Column) -> Column:
    """1 when done, 0 when failed, else up to 0.95 of the way."""
    return F.when(status == "done", 1.0).when(status == "failed", 0.0).otherwise(F.when(total > 0, done / total * 0.95).otherwise(0.0))


def of_job(events: DataFrame, job_id: int) -> DataFrame:
    return events.filter(F.col("job_id") == job_id)


def framed(events: DataFrame) -> DataFrame:
    """Server-sent event frames."""
    return events.withColumn("frame", F.concat(F.lit("data: "), F.to_json(F.struct(*events.columns)), F.lit("\n\n")))


def as_progress(events: DataFrame) -> DataFrame:
    """Raw events as progress events; the type says the state, the value how far it is."""
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("running")
    done = F.floor(F.abs(F.col("value"))) % 100
    return events.select("event_id", "ts", F.col("user_id").alias("job_id"), status.alias("status"), scaled(done, F.lit(100), status).alias("progress"))


def by_minute(progress: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events and mean progress per state and minute; rows later than the watermark are dropped on streams."""
    return progress.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "status").agg(F.count("*").alias("n"), F.avg("progress").alias("progress"))


def read_stream(spark: SparkSession, path: str, schema: StructType | str = SCHEMA, files_per_trigger: int = 4) -> DataFrame:
    """A file stream; the number of files taken at once limits how much runs together."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start(events: DataFrame, sink: str, checkpoint: str, path: str) -> StreamingQuery:
    """Writes what is there and stops; the checkpoint makes it go on where it was."""
    return events.writeStream.format(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
