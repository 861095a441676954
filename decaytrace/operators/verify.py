"""Gates a proposed transformation fix must pass.

Before and after are two DataFrames of the same source. Each is reduced to one
row per segment, and every gate reads those two small results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import round_n
from ..session import materialize
from . import drift

Transform = Callable[[DataFrame], DataFrame]


def family_stats(df: DataFrame, segment: str, inputs: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    names = list(inputs or drift.discover_inputs(df, segment, exclude=()))
    return materialize(drift.segment_stats(df, segment, names), "segments"), names


def _active(stats: DataFrame, inputs: Sequence[str], value) -> DataFrame:
    family = drift.encoding_family(stats, inputs).scalar()
    with_family = stats.filter(F.col("segment") == F.lit(value)).withColumn("indicators", family)
    active = F.expr(
        " + ".join(["0D", *[f"IF(array_contains(indicators, '{c}'), coalesce(`sum__{c}`, 0D), 0D)" for c in inputs]])
    )
    rows = F.coalesce(F.sum("rows"), F.lit(0))
    total = F.coalesce(F.sum(active), F.lit(0.0))
    mean = F.coalesce(total / F.nullif(rows.cast("double"), F.lit(0.0)), F.lit(0.0))
    # a segment that vanished still has a family: take it from the table, not from the segment
    return with_family.agg(mean.alias("mean"), rows.alias("rows")).select(
        family.alias("indicators"),
        round_n("mean", 4).alias("mean_active_indicators"),
        "rows",
        ((F.size(family) > 0) & (F.col("mean") == 0)).alias("all_zero"),
    )


def encoding_family(df: DataFrame, segment: str, inputs: Sequence[str] | None = None) -> DataFrame:
    stats, names = family_stats(df, segment, inputs)
    return drift.encoding_family(stats, names)


def active_indicators(df: DataFrame, segment: str, value, inputs: Sequence[str] | None = None) -> DataFrame:
    """Do the rows of one segment still match no category of its encoding?"""
    stats, names = family_stats(df, segment, inputs)
    return _active(stats, names, value)


def compare_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer compare of two (segment, rows) tables; NULL is a segment too."""
    b = before.select("segment", F.col("rows").alias("before_rows"))
    a = after.select(F.col("segment").alias("_after"), F.col("rows").alias("after_rows"))
    joined = b.join(a, F.col("segment").eqNullSafe(F.col("_after")), "full_outer")
    return joined.select(
        F.coalesce("segment", "_after").alias("segment"),
        F.coalesce("before_rows", F.lit(0)).alias("before_rows"),
        F.coalesce("after_rows", F.lit(0)).alias("after_rows"),
    ).withColumn("difference", F.col("after_rows") - F.col("before_rows"))


def _counts(df: DataFrame, segment: str) -> DataFrame:
    return df.groupBy(F.col(segment).alias("segment")).agg(F.count("*").alias("rows"))


def segment_count_compare(before: DataFrame, after: DataFrame, segment: str) -> DataFrame:
    return compare_counts(_counts(before, segment), _counts(after, segment))


def map_equal(before: DataFrame, after: DataFrame, segment: str) -> DataFrame:
    """One row: are the counts of every segment the same?"""
    return segment_count_compare(before, after, segment).agg(
        F.coalesce(F.every(F.col("difference") == 0), F.lit(True)).alias("row_counts_unchanged")
    )


def rows_destroyed(before: DataFrame, after: DataFrame, segment: str) -> DataFrame:
    """Segments whose count changed, with the rows lost (negative where gained)."""
    return (
        segment_count_compare(before, after, segment)
        .filter(F.col("difference") != 0)
        .select("segment", (-F.col("difference")).alias("rows_destroyed"))
    )


def verify_fix(
    before: DataFrame, after: DataFrame, segment: str, value,
    before_inputs: Sequence[str] | None = None, after_inputs: Sequence[str] | None = None,
) -> DataFrame:
    """Gates of a fix: defect gone, and no row lost or gained in any segment.

    A fix that leaves no encoding family at all, or no rows of the damaged
    segment, has not resolved anything.
    """
    b_stats, b_names = family_stats(before, segment, before_inputs)
    a_stats, a_names = family_stats(after, segment, after_inputs)
    b = _active(b_stats, b_names, value)
    a = _active(a_stats, a_names, value)
    same = compare_counts(b_stats, a_stats).agg(F.coalesce(F.every(F.col("difference") == 0), F.lit(True))).scalar()
    after_row = a.select(F.struct("indicators", "mean_active_indicators", "rows", "all_zero")).scalar()
    gates = b.select(
        F.lit(True).alias("build_ok"),
        F.struct("indicators", "mean_active_indicators", "rows", "all_zero").alias("before"),
        after_row.alias("after"),
        same.alias("row_counts_unchanged"),
    )
    resolved = (
        F.col("before.all_zero") & ~F.col("after.all_zero")
        & (F.size("after.indicators") > 0) & (F.col("after.rows") > 0)
    )
    return gates.withColumn("defect_resolved", resolved).withColumn(
        "passed", F.col("build_ok") & F.col("defect_resolved") & F.col("row_counts_unchanged")
    )


def verify_transform(source: DataFrame, current: Transform, candidate: Transform, segment: str, value) -> DataFrame:
    """Gate a candidate transformation; one that does not analyse fails the build gate."""
    before = current(source)
    try:
        after = candidate(source)
        after.schema  # noqa: B018 - analysis happens here
    except AnalysisException:
        stats, names = family_stats(before, segment)
        failed = _active(stats, names, value)
        return failed.select(
            F.lit(False).alias("build_ok"),
            F.struct("indicators", "mean_active_indicators", "rows", "all_zero").alias("before"),
            F.lit(None).cast("struct<indicators:array<string>,mean_active_indicators:double,rows:bigint,all_zero:boolean>").alias("after"),
            F.lit(None).cast("boolean").alias("row_counts_unchanged"),
            F.lit(False).alias("defect_resolved"),
            F.lit(False).alias("passed"),
        )
    return verify_fix(before, after, segment, value)
