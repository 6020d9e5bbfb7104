"""Event-time windows, in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_folder


def tumbling(events: DataFrame, time: str, width: str, *by: str, slide: str | None = None) -> DataFrame:
    """window_start, the keys and n for each window."""
    w = F.window(F.col(time).cast("timestamp"), width, slide) if slide else F.window(F.col(time).cast("timestamp"), width)
    return events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: str) -> DataFrame:
    """The key, session_start and n for events less than *gap* apart."""
    w = F.session_window(F.col(time).cast("timestamp"), gap).alias("s")
    return events.groupBy(by, w).agg(F.count("*").alias("n")).select(by, F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


def stream_tumbling(spark: SparkSession, path: str, time: str, width: str, delay: str, by: str, checkpoint: str | None = None) -> DataFrame:
    """The closed windows of a stream over Parquet files, run until all that is there has been read.

    The stream's checkpoint and its output table are in the shared checkpoint folder.
    """
    root = f"{checkpoint or shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder_of_files = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    source, glob = (path, "*.parquet") if folder_of_files else (path.rpartition("/")[0], path.rpartition("/")[2])
    events = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source)
    counted = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay).groupBy(F.window("_t", width).alias("w"), by).agg(F.count("*").alias("n"))
    out = counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), by, "n")
    query = out.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")
