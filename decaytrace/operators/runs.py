"""Recorded runs: one row per step, summaries per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import preview_text

# Steps kept in one stored document. A longer run is stored as several documents
# of the same run, so no document grows with the length of a run.
STEPS_PER_DOCUMENT = 500


def as_steps(turns: DataFrame) -> DataFrame:
    """Conversation turns as run steps."""
    tool = F.when(F.col("role") == "user", "profile_column").when(
        F.col("role") == "assistant", "catalog_search"
    ).otherwise("model_context")
    return turns.select(
        F.concat(F.lit("run-"), F.col("conv_id")).alias("run_id"),
        F.col("turn").alias("index"),
        tool.alias("tool"),
        F.create_map(F.lit("role"), F.col("role")).alias("arguments"),
        F.length("text").cast("bigint").alias("elapsed_ms"),
        preview_text("text").alias("result_preview"),
        F.col("text").alias("result"),  # whole, beside its preview
    )


def as_run_records(turns: DataFrame) -> DataFrame:
    """Run documents with a nested trace of bounded length."""
    step = F.struct("index", "tool", "arguments", "elapsed_ms", "result_preview", "result")
    return (
        as_steps(turns)
        .withColumn("part", F.floor(F.col("index") / STEPS_PER_DOCUMENT))
        .groupBy("run_id", "part")
        .agg(F.collect_list(step).alias("trace"))
        .select("run_id", F.array_sort("trace", lambda a, b: a["index"].cast("int") - b["index"].cast("int")).alias("trace"))
    )


def run_summary(steps: DataFrame, prefix: str) -> DataFrame:
    """Calls, calls to tools of one prefix, turns and elapsed time per run."""
    return steps.groupBy("run_id").agg(
        F.count("*").alias("tool_calls"),
        F.count_if(F.col("tool").startswith(prefix)).alias("prefixed_calls"),
        F.count_distinct("index").alias("turns"),
        F.sum("elapsed_ms").alias("elapsed_ms"),
    )


def tool_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id", "tool").agg(F.count("*").alias("calls"))
