"""Column monitors over an event stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.numbers import round_n
from ..functions.times import as_instant, as_wall_clock
from ..session import scratch_path


def stream_monitors(
    events: DataFrame, time: str, column: str, by: Sequence[str] = (), width: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Volume, null, zero and negative counts, min and max per tumbling window.

    Every metric is an algebraic aggregate, so the state kept per window and key
    is a handful of numbers. Distinct values are left to the batch monitors: they
    would make the state grow with the data.
    """
    v = F.col(column)
    return (
        events.withColumn(time, as_instant(time))
        .withWatermark(time, delay)
        .groupBy(F.window(time, width), *by)
        .agg(
            F.count("*").alias("row_volume"),
            F.count_if(v.isNull()).alias("null_count"),
            F.count_if(v == 0).alias("zero_count"),
            F.count_if(v < 0).alias("negative_count"),
            F.min(v).alias("min_value"),
            F.max(v).alias("max_value"),
            round_n(F.avg(v), 4).alias("avg_value"),
        )
        .select(
            as_wall_clock("window.start").alias("window_start"), as_wall_clock("window.end").alias("window_end"), *by,
            "row_volume", "null_count", "zero_count", "negative_count", "min_value", "max_value", "avg_value",
        )
    )


def run_available(spark: SparkSession, monitored: DataFrame, name: str = "stream") -> DataFrame:
    """Drain what is available into a Parquet sink and return what was emitted.

    Append mode with files and a checkpoint in shared storage: a restarted query
    goes on where it stopped. The window the watermark has not passed stays open.
    """
    path = scratch_path(spark, name)
    query = (
        monitored.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(monitored.schema).parquet(f"{path}/out")


def stream_parquet(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
