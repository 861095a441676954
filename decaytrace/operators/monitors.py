"""The checks an ordinary data-quality stack would run, reported honestly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.numbers import pct, round_n, safe_double
from ..functions.times import epoch_seconds
from ..session import materialize
from .profile import per_value

# Thresholds above which a monitor fires.
VOLUME_SWING = 0.5
NULL_PCT = 1.0


def monitor_metrics(df: DataFrame, column: str, period: str = "feed_month") -> DataFrame:
    """Volume, null share, distinct, zero, negative, empty, min and max per period.

    Every metric is a weighted aggregate of the per-value counts, so the rows are
    reduced before the shuffle and no distinct aggregate is needed.
    """
    dtype = df.schema[column].dataType
    number = safe_double(column, dtype)
    empty = F.trim(F.col(column)) == "" if isinstance(dtype, T.StringType) else F.lit(False)

    def rows_where(condition):
        return F.sum(F.when(condition, F.col("_n")).otherwise(0))

    return per_value(df, column, period).groupBy(period).agg(
        F.sum("_n").alias("row_volume"),
        pct(rows_where(F.col(column).isNull()), F.sum("_n")).alias("null_pct"),
        F.count(column).alias("unique_count"),
        rows_where(number == 0).alias("zero_count"),
        rows_where(number < 0).alias("negative_count"),
        rows_where(empty).alias("empty_count"),
        F.min(column).cast("string").alias("min_value"),
        F.max(column).cast("string").alias("max_value"),
    )


def monitor_dtype(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Declared type of each column with its non-null rows."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    return counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                        F.col(c).alias("non_null_rows"),
                    )
                    for c in columns
                ]
            )
        ).alias("r")
    ).select("r.*")


def first_exceedance(
    metrics: DataFrame, metric: str, period: str = "feed_month", volume: str = "row_volume", by: Sequence[str] = ()
) -> DataFrame:
    """First period whose metric is above every earlier one.

    Strictly above the running maximum, not merely different from the opening
    value. The window sees one row per period (and per ``by`` key).
    """
    w = Window.partitionBy(*by).orderBy(period)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    share = (
        pct(F.col(metric), F.col(volume))
        if metric.endswith("_count") and metric != "unique_count"
        else F.lit(None).cast("double")
    )
    steps = metrics.select(
        *by,
        F.col(period).alias("period"),
        F.first(metric).over(w).alias("from_value"),
        F.max(metric).over(earlier).alias("prior_max"),
        F.col(metric).alias("to_value"),
        share.alias("share_of_rows_pct"),
    ).filter(F.col("to_value") > F.col("prior_max"))
    first = F.min_by(F.struct("period", "from_value", "prior_max", "to_value", "share_of_rows_pct"), "period")
    return (
        steps.groupBy(*by)
        .agg(first.alias("s"))
        .filter(F.col("s").isNotNull())
        .select(*by, F.lit(metric).alias("metric"), "s.*")
    )


def volume_swing(df: DataFrame, period: str = "feed_month") -> DataFrame:
    """(max - min) / max of the period volumes, as a percentage."""
    volumes = df.groupBy(period).agg(F.count("*").alias("row_volume"))
    return volumes.agg(_swing_pct("row_volume").alias("row_volume_swing_pct"))


def _swing(volume: str):
    return (F.max(volume) - F.min(volume)) / F.nullif(F.max(volume), F.lit(0))


def _swing_pct(volume: str):
    return round_n(_swing(volume) * F.lit(100.0), 2)


def monitor_verdicts(
    df: DataFrame, column: str, period: str = "feed_month", time: str | None = None,
    max_gap_seconds: float | None = None, schemas: DataFrame | None = None,
) -> DataFrame:
    """One row of verdicts, each measured; null where there is nothing to measure it on.

    Freshness is judged where a time column is given, type and schema where ``schemas`` are:
    (period, column, dtype) as declared by each period's files (``schema_rows``), since the
    rows here are all read through one schema.
    """
    metrics = materialize(monitor_metrics(df, column, period), "metrics")
    unknown = F.lit(None).cast("boolean")
    stale = stable = reshaped = unknown
    if time:
        stale = monitor_freshness(df, time, period, max_gap_seconds).agg(F.coalesce(F.max("fires"), F.lit(False))).scalar()
    if schemas is not None:
        stable = schemas.filter(F.col("column") == column).agg(F.when(F.count("dtype") > 0, F.count_distinct("dtype") == 1)).scalar()
        reshaped = monitor_schema(schemas, period).exists()

    def changed(metric):
        return first_exceedance(metrics, metric, period).exists()

    return metrics.agg(
        F.lit(column).alias("column"),
        F.lit(df.schema[column].dataType.simpleString()).alias("dtype"),
        F.max("null_pct").alias("max_null_pct"),
        _swing_pct("row_volume").alias("row_volume_swing_pct"),
        (_swing("row_volume") > VOLUME_SWING).alias("volume_fires"),
        (F.max("null_pct") > NULL_PCT).alias("null_count_fires"),
        (F.max("empty_count") > 0).alias("empty_count_fires"),
        (F.max("negative_count") > 0).alias("negative_count_fires"),
    ).select(
        "*",
        stable.alias("dtype_stable"),
        reshaped.alias("schema_fires"),
        stale.alias("freshness_fires"),
        changed("unique_count").alias("unique_count_fires"),
        changed("zero_count").alias("zero_count_fires"),
    )


MONITORS = ("freshness", "volume", "null_count", "schema", "empty_count", "negative_count", "unique_count", "zero_count")


def monitor_sweep(layers: Mapping[str, tuple], period: str = "feed_month") -> DataFrame:
    """Verdicts of several layers, one row per monitor; ``fires`` is null where nothing was measured.

    A layer is (rows, column) or (rows, column, options), the options being those of
    ``monitor_verdicts``: time, max_gap_seconds, schemas.
    """
    parts = []
    for layer, (df, column, *options) in layers.items():
        verdicts = monitor_verdicts(df, column, period, **(options[0] if options else {}))
        parts.append(
            verdicts.select(
                F.lit(layer).alias("layer"),
                "column",
                F.explode(
                    F.array(*[F.struct(F.lit(m).alias("monitor"), F.col(f"{m}_fires").alias("fires")) for m in MONITORS])
                ).alias("v"),
            ).select("layer", "column", "v.*")
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def monitors_fired(sweep: DataFrame) -> DataFrame:
    return sweep.groupBy("layer", "column").agg(F.count_if("fires").alias("fired"), F.count("*").alias("monitors"))


def in_set(df: DataFrame, column: str, allowed: Sequence, period: str = "feed_month") -> DataFrame:
    """Rows outside the allowed set, per period."""
    return df.groupBy(period).agg(
        F.count("*").alias("rows"),
        F.count_if(~F.col(column).isin(list(allowed))).alias("outside"),
    ).withColumn("fires", F.col("outside") > 0)


def monitor_report(df: DataFrame, column: str) -> DataFrame:
    """A (monitor, value) table of one column."""
    values = df.groupBy(column).agg(F.count("*").alias("_n"))
    nulls = F.sum(F.when(F.col(column).isNull(), F.col("_n")).otherwise(0))
    one = values.agg(
        F.sum("_n").cast("string").alias("row volume"),
        F.concat(pct(nulls, F.sum("_n")).cast("string"), F.lit("%")).alias("null rate"),
        F.lit(df.schema[column].dataType.simpleString()).alias("dtype"),
        F.count(column).cast("string").alias("distinct count"),
    )
    return one.unpivot([], ["row volume", "null rate", "dtype", "distinct count"], "monitor", "value")


def monitor_freshness(
    df: DataFrame, time: str, period: str = "feed_month", max_gap_seconds: float | None = None
) -> DataFrame:
    """Latest time of each period and the seconds since the period before it."""
    w = Window.orderBy(period)
    gap = epoch_seconds("last_seen") - epoch_seconds(F.lag("last_seen").over(w))
    latest = df.groupBy(period).agg(F.max(time).alias("last_seen"))
    limit = float("inf") if max_gap_seconds is None else float(max_gap_seconds)
    return latest.select(period, "last_seen", gap.alias("gap_seconds")).withColumn(
        "fires", F.coalesce(F.col("gap_seconds") > F.lit(limit), F.lit(False))
    )


def monitor_empty(df: DataFrame, columns: Sequence[str], period: str = "feed_month") -> DataFrame:
    """Blank strings per period and column, in one pass."""
    counted = df.groupBy(period).agg(*[F.count_if(F.trim(F.col(c)) == "").alias(c) for c in columns])
    return counted.unpivot([period], list(columns), "column", "empty_count")


def schema_rows(spark: SparkSession, paths: Mapping[str, str], period: str = "feed_month") -> DataFrame:
    """(period, column, dtype) read from the footers of each period's files."""
    rows = [
        (p, f.name, f.dataType.simpleString())
        for p, path in paths.items()
        for f in spark.read.parquet(path).schema.fields
    ]
    return spark.createDataFrame(rows, f"{period} string, column string, dtype string")


def monitor_schema(schemas: DataFrame, period: str = "feed_month") -> DataFrame:
    """Columns added, removed or retyped from one period to the next.

    Works on metadata: one row per period and column.
    """
    periods = Window.orderBy(period)
    order = schemas.select(period).distinct().select(period, F.row_number().over(periods).alias("i"))
    placed = schemas.join(order, period)
    earlier = placed.select("column", (F.col("i") + 1).alias("i"), F.col("dtype").alias("before"))
    last = order.agg(F.max("i")).scalar()
    pairs = placed.select("column", "i", F.col("dtype").alias("after")).join(earlier, ["column", "i"], "full_outer")
    return (
        pairs.filter((F.col("i") > 1) & (F.col("i") <= last) & ~F.col("before").eqNullSafe(F.col("after")))
        .join(order, "i")
        .select(
            period,
            "column",
            F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("retyped").alias("change"),
            "before",
            "after",
        )
    )
