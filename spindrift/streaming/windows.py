"""Structured Streaming over event tables: tumbling windows and sessions, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources.shared import scratch_path


def read_stream(spark: SparkSession, folder: str, table: str = "events") -> DataFrame:
    """Files of a table as a stream; its schema is that of what is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
    reader = spark.readStream.schema(spark.read.parquet(path.toString()).schema)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        found = reader.parquet(path.toString())
    else:  # a stream's source is a folder
        found = reader.option("pathGlobFilter", path.getName()).parquet(folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def window_totals(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Events, their value and time window by type; works on a stream and on a table alike."""
    dated = events.withWatermark("ts", lateness) if events.isStreaming else events
    return dated.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value") + 0.0000037, 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """Sessions of a user: events no farther apart than the gap."""
    dated = events.withWatermark("ts", lateness) if events.isStreaming else events
    return dated.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def run_available(result: DataFrame, name: str) -> DataFrame:
    """Runs an aggregating stream over all that is available and returns its complete result. Each micro-batch writes the
    whole state to a folder of its own, so a batch that is run again replaces its own output."""
    spark = result.sparkSession
    path = scratch_path(spark, name)

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = result.writeStream.outputMode("complete").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    batches = spark.read.parquet(path)
    last = batches.agg(F.max("batch").alias("batch"))
    return batches.join(F.broadcast(last), "batch").drop("batch")
