"""Streams over the library's queues and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, pattern: str, schema_of: DataFrame, files_per_trigger: int = 10) -> DataFrame:
    """New Parquet files of a folder as a stream: the files that match, and all files of the folders that match."""
    # the braces make any pattern a glob; Spark takes a plain path as the base of partitions, which a file can't be
    return spark.readStream.schema(schema_of.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{{{pattern}}}")


def as_event_time(df: DataFrame, column: str) -> DataFrame:
    """The column as a timestamp that a watermark accepts (times without zone are read as UTC)."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows per time window and key; rows later than ``late`` are dropped from a stream's windows."""
    timed = as_event_time(events, time).withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all that is there in micro-batches, then stop; the checkpoint makes a restart go on where it ended."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def append_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own folder, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current_state(log: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row of each key of an append-only log."""
    order = Window.partitionBy(key).orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc())
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
