"""Reading periodic feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

# Published column name -> (name here, type).
FEED_COLUMNS = {
    "VendorID": ("vendor_id", "int"),
    "tpep_pickup_datetime": ("pickup_at", "timestamp_ntz"),
    "tpep_dropoff_datetime": ("dropoff_at", "timestamp_ntz"),
    "passenger_count": ("passenger_count", "double"),
    "trip_distance": ("trip_distance", "double"),
    "RatecodeID": ("ratecode_id", "double"),
    "store_and_fwd_flag": ("store_and_fwd_flag", "string"),
    "PULocationID": ("pu_location_id", "int"),
    "DOLocationID": ("do_location_id", "int"),
    "payment_type": ("payment_type", "int"),
    "fare_amount": ("fare_amount", "double"),
    "tip_amount": ("tip_amount", "double"),
    "total_amount": ("total_amount", "double"),
}


def scan_feed(published: DataFrame, keep: Sequence[str] = ("feed_month",)) -> DataFrame:
    """Rename and cast the published columns."""
    return published.select(
        *keep, *[F.col(src).cast(dtype).alias(name) for src, (name, dtype) in FEED_COLUMNS.items()]
    )


def tag_period(spark: SparkSession, path: str, pattern: str, period: str = "feed_month") -> DataFrame:
    """One scan over many period files; the period is read from each file's path.

    For folders named ``period=value`` plain partition discovery is better still,
    because it also prunes. This is for feeds whose period is only in a file name.
    """
    return (
        spark.read.option("recursiveFileLookup", "true")
        .parquet(path)
        .withColumn(period, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
    )


def union_periods(
    spark: SparkSession, paths: Mapping[str, str], keep: Sequence[str] = (), period: str = "feed_month"
) -> DataFrame:
    """UNION ALL of one scan per period, each tagged with its literal period."""
    parts = [
        scan_feed(spark.read.parquet(path).withColumn(period, F.lit(p)), keep=(*keep, period))
        for p, path in paths.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def scan_tolerant(
    spark: SparkSession, paths: Mapping[str, str], columns: Sequence[str], period: str = "feed_month"
) -> DataFrame:
    """Union of period files that need not all hold every column.

    A missing column is filled with NULL by the union, so ``present_columns``
    records which ones each period's own schema has. Missing is not NULL.
    """
    parts = []
    for p, path in paths.items():
        df = spark.read.parquet(path)
        present = [c for c in columns if c in df.columns]
        parts.append(
            df.select(
                F.lit(p).alias(period),
                F.array(*[F.lit(c) for c in present]).cast("array<string>").alias("present_columns"),
                *present,
            )
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
