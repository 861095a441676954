"""Recorded runs, SQL texts and column catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numbers import col

RUN_SCHEMA = """
run_id string, model_urn string, symptom string, elapsed_seconds double, turns bigint, llm_model string,
input_tokens bigint, output_tokens bigint, lineage_urns array<string>,
trace array<struct<index:bigint, tool:string, arguments:map<string,string>, elapsed_ms:bigint, result_preview:string>>
"""
CATALOG_SCHEMA = "nodes map<string, struct<columns:map<string, struct<type:string, index:bigint>>>>"


def read_run_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Recorded runs: one document per file, or one per line when not ``multi_line``."""
    return spark.read.schema(RUN_SCHEMA).json(path, multiLine=multi_line)


def trace_steps(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", F.explode("trace").alias("s")).select("run_id", "s.*")


def read_sql_texts(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.sql`` file below a folder as one (path, text) row."""
    return (
        spark.read.option("pathGlobFilter", "*.sql")
        .option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def catalog_columns(documents: DataFrame, json: Column | str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Column catalog documents to (node, column, type, index) rows."""
    return (
        documents.select(*keep, F.explode(F.from_json(col(json), CATALOG_SCHEMA)["nodes"]).alias("node", "n"))
        .select(*keep, "node", F.explode("n.columns").alias("column", "c"))
        .select(*keep, "node", "column", "c.type", "c.index")
    )
