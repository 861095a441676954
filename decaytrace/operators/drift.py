"""Behaviour of every model input inside each segment."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numbers import NUMERIC_TYPES, round_n, safe_double
from ..session import materialize

# Columns that are no model input.
EXCLUDED = (
    "pickup_at", "feed_month", "total_amount", "predicted_total", "abs_error",
    "control_predicted_total", "control_abs_error",
)


def discover_inputs(df: DataFrame, segment: str, exclude: Sequence[str] = EXCLUDED) -> list[str]:
    """Numeric and boolean columns of the table, from its schema."""
    kinds = NUMERIC_TYPES + (T.BooleanType,)
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, kinds) and f.name not in exclude and f.name != segment
    ]


def quoted(name: str) -> str:
    return f"`{name}`"


def segment_stats(
    df: DataFrame, segment: str, inputs: Sequence[str], errors: Sequence[str] = ()
) -> DataFrame:
    """One aggregate over the table that everything in this module reads.

    Per input: mean, deviation, and what the indicator tests need (non-null and
    non-binary counts, min, max, sum). One scan, one shuffle, whatever the number
    of inputs.
    """
    typed = df.select(
        F.col(segment).alias("segment"), *errors,
        *[safe_double(c, df.schema[c].dataType).alias(f"v__{c}") for c in inputs],
    )
    aggs = ["count(*) AS rows"] + [f"avg({quoted(e)}) AS `mean__{e}`" for e in errors]
    for c in inputs:
        v = quoted(f"v__{c}")
        aggs += [
            f"avg({v}) AS `mean__{c}`",
            f"stddev_pop({v}) AS `sd__{c}`",
            f"count_if({v} IS NOT NULL AND NOT isnan({v})) AS `n__{c}`",
            f"count_if(NOT isnan({v}) AND {v} NOT IN (0D, 1D)) AS `other__{c}`",
            f"min({v}) AS `min__{c}`",
            f"max({v}) AS `max__{c}`",
            f"sum({v}) AS `sum__{c}`",
        ]
    return typed.groupBy("segment").agg(*[F.expr(a) for a in aggs])


def names_where(conditions: Sequence[tuple[str, str]]) -> Column:
    """Names whose SQL condition holds, in the given order."""
    cases = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in conditions)
    return F.expr(f"array_compact(CAST(array({cases}) AS array<string>))")


def is_binary(c: str) -> str:
    """Aggregate over segments: some value, and none but 0 and 1."""
    return f"sum(`n__{c}`) > 0 AND sum(`other__{c}`) = 0"


def indicators(stats: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Inputs that hold only 0 and 1 across the whole table."""
    return stats.agg(names_where([(c, is_binary(c)) for c in inputs]).alias("indicators"))


def encoding_family(stats: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Binary inputs that are constant within every segment: they encode it."""
    family = [(c, f"{is_binary(c)} AND every(coalesce(`min__{c}` = `max__{c}`, true))") for c in inputs]
    return stats.agg(names_where(family).alias("indicators"))


def degenerate(inputs: Sequence[str]) -> Column:
    """Inputs without variance (to 8 digits) in the segment."""
    return names_where([(c, f"coalesce(round(`sd__{c}` * 1e8D), 0D) = 0") for c in inputs])


def largest_first() -> Column:
    """Ordering key of the reference segment: most rows, then the smallest name."""
    return F.struct(-F.col("rows"), F.col("segment").cast("string"))


def reference_segment(stats: DataFrame) -> DataFrame:
    return stats.agg(F.min_by("segment", largest_first()).alias("reference_segment"))


def all_zero(names: str, inputs: Sequence[str], exact: bool = False) -> Column:
    """Every indicator in the array column has mean zero; false for none, and for NULL means."""
    mean = "`mean__{c}`" if exact else "round(`mean__{c}` * 1e4D)"
    tests = [f"(NOT array_contains({names}, '{c}') OR coalesce({mean.format(c=c)} = 0, false))" for c in inputs]
    return F.expr(" AND ".join([f"size({names}) > 0", *tests]))


def drift_stats(
    df: DataFrame, segment: str, inputs: Sequence[str] | None = None,
    errors: Sequence[str] = ("abs_error", "control_abs_error"),
) -> DataFrame:
    """Rounded mean and deviation of every input per segment."""
    inputs = list(inputs or discover_inputs(df, segment))
    stats = segment_stats(df, segment, inputs, errors)
    return stats.select(
        "segment", "rows",
        *[round_n(f"mean__{e}", 4).alias(f"avg__{e}") for e in errors],
        *[round_n(f"mean__{c}", 4).alias(f"avg__{c}") for c in inputs],
        *[F.coalesce(round_n(f"sd__{c}", 8), F.lit(0.0)).alias(f"sd__{c}") for c in inputs],
    )


def drift_report(
    df: DataFrame, segment: str, inputs: Sequence[str] | None = None,
    errors: Sequence[str] = ("abs_error", "control_abs_error"), exact: bool = False,
) -> DataFrame:
    """Drift signals of every segment, one row each.

    Two indicator tests are reported: all binary inputs, and only those in the
    segment column's own encoding family. The second is the one that can still
    fire when unrelated flags vary freely.
    """
    inputs = list(inputs or discover_inputs(df, segment))
    stats = materialize(segment_stats(df, segment, inputs, errors), "segments")
    flat = degenerate(inputs)
    report = stats.select(
        "*",
        flat.alias("degenerate_in_segment"),
        stats.agg(F.min_by(flat, largest_first())).scalar().alias("_reference_flat"),
        reference_segment(stats).scalar().alias("reference_segment"),
        indicators(stats, inputs).scalar().alias("indicator_inputs"),
        encoding_family(stats, inputs).scalar().alias("family_inputs"),
    )
    return report.select(
        "segment", "rows",
        *[round_n(f"mean__{e}", 4).alias(f"avg__{e}") for e in errors],
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in inputs]), F.array(*[round_n(f"mean__{c}", 4) for c in inputs])
        ).alias("feature_means"),
        "degenerate_in_segment",
        F.array_sort(F.array_except("degenerate_in_segment", "_reference_flat")).alias("degenerate_only"),
        "reference_segment",
        "indicator_inputs",
        all_zero("indicator_inputs", inputs, exact).alias("all_indicators_zero"),
        "family_inputs",
        all_zero("family_inputs", inputs, exact).alias("all_family_zero"),
    )
