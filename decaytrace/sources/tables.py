"""Writing tables, views and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, period: str = "feed_month") -> DataFrame:
    """Create or replace a Parquet table partitioned by period, and read it back.

    The rebalance hint gathers each period into well-sized files and splits a
    period that holds a large share of the rows over several tasks.
    """
    df.hint("rebalance", period).write.mode("overwrite").partitionBy(period).parquet(path)
    return read_table(df, path)


def read_table(like: DataFrame, path: str) -> DataFrame:
    """Read a table with the schema it was written with: the period stays text."""
    return like.sparkSession.read.schema(like.schema).parquet(path)


def write_raw(feed: DataFrame, path: str, period: str = "feed_month") -> DataFrame:
    return write_table(feed, path, period)


def write_mart(mart: DataFrame, path: str, period: str = "feed_month") -> DataFrame:
    return write_table(mart, path, period)


def write_predictions(scored: DataFrame, path: str, period: str = "feed_month") -> DataFrame:
    """Replace only the scored periods and leave the others in place."""
    scored.hint("rebalance", period).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(period).parquet(path)
    return read_table(scored, path)


def staging_view(staged: DataFrame, name: str) -> DataFrame:
    """Register the staging projection as a view; nothing is computed."""
    staged.createOrReplaceTempView(name)
    return staged.sparkSession.table(name)


def to_documents(df: DataFrame) -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_json(df: DataFrame, path: str) -> DataFrame:
    to_documents(df).write.mode("overwrite").text(path)
    return df.sparkSession.read.schema(df.schema).json(path)
