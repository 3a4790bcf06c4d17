"""Online forms for Structured Streaming: blocks in event time. Recurrences in event time: see `ordered`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.places import scratch


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A stream of a Parquet table by the file source, ts as an instant."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    """Count and sum of each block of event time; rows later than `late` behind the newest are dropped by the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size)).agg(F.count("*").alias("n"), F.sum("value").alias("x"))


def hopping(stream: DataFrame, size: str, slide: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n"), F.sum("value").alias("x"))


def sessions(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Stretches of a user's events with no gap of `gap`."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count("*").alias("n"))


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append"):
    """What a stream gives for all that is there now, through a file sink in the shared folder."""
    path = scratch(spark, "stream")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
