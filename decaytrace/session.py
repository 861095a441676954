"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "decaytrace", **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster the submitter's session is used."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor, so that is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    fallback = tempfile.mkdtemp(prefix="decaytrace-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, one per call."""
    return f"{shared_dir(spark).rstrip('/')}/decaytrace/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a reduced result to the shared folder and go on from the written table.

    Used where a big table has been reduced and the small result is read several
    times: the reduction then runs once, the rows outlive any executor, the plan
    stays short, and file sizes tell Spark what is small enough to broadcast.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def findable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, for sessions that were
    started elsewhere and without it on their path; where it is installed this changes nothing."""
    root = str(Path(__file__).resolve().parents[1])
    given = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in given.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (given, root) if x)


def release(spark: SparkSession) -> None:
    """Let go of what finished steps left on the driver: Python's handles on their plans first, then
    the plans themselves, upon which Spark's cleaner also drops their shuffle files and broadcasts."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
