"""Error that a defect adds, net of a control model's general advantage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import round_n
from ..session import materialize

ERROR, CONTROL, TARGET = "abs_error", "control_abs_error", "total_amount"


def segment_summary(df: DataFrame, segment: str, flags: Sequence[str], speed: str = "avg_speed_mph") -> DataFrame:
    flag_sum = sum((F.col(f) for f in flags[1:]), F.col(flags[0]))
    return df.groupBy(segment).agg(
        F.count("*").alias("trips"),
        round_n(F.avg(ERROR), 4).alias("production_mae"),
        round_n(F.avg(CONTROL), 4).alias("control_mae"),
        round_n(F.avg(ERROR) - F.avg(CONTROL), 4).alias("attributable_mae"),
        round_n(F.avg(speed), 3).alias("avg_speed_feature"),
        round_n(F.avg(flag_sum), 4).alias("flag_sum"),
    )


def impact_naive(df: DataFrame, segment: str, value) -> DataFrame:
    """Gap between the arms on one segment."""
    return df.filter(F.col(segment) == F.lit(value)).agg(
        F.count("*").alias("affected_rows"),
        round_n(F.avg(ERROR), 4).alias("production_mae"),
        round_n(F.avg(CONTROL), 4).alias("control_mae"),
        round_n(F.avg(ERROR) - F.avg(CONTROL), 4).alias("attributable_mae_per_row"),
        round_n(F.sum(F.col(ERROR) - F.col(CONTROL)), 2).alias("attributable_amount"),
        round_n(F.sum(TARGET), 2).alias("gross_amount_exposed"),
    )


def attribution_naive(df: DataFrame, segment: str, value, time: str = "pickup_at") -> DataFrame:
    hit = F.col(segment) == F.lit(value)
    e, c = F.when(hit, F.col(ERROR)), F.when(hit, F.col(CONTROL))
    return df.agg(
        F.count_if(hit).alias("affected_rows"),
        round_n(F.avg(e), 4).alias("production_mae"),
        round_n(F.avg(c), 4).alias("control_mae"),
        round_n(F.avg(e) - F.avg(c), 4).alias("attributable_mae_per_row"),
        round_n(F.sum(e - c), 2).alias("attributable_amount"),
        round_n(F.sum(F.when(hit, F.col(TARGET))), 2).alias("gross_amount_exposed"),
        F.min(F.when(hit, F.col(time))).alias("first_affected_at"),
        F.max(F.when(hit, F.col(time))).alias("last_affected_at"),
    )


def baseline_lift(df: DataFrame, segment: str, value) -> DataFrame:
    """The control's advantage where no defect exists. NULL segments are in neither arm."""
    rest = F.col(segment) != F.lit(value)
    return df.agg(
        F.count_if(rest).alias("baseline_rows"),
        round_n(F.avg(F.when(rest, F.col(ERROR))) - F.avg(F.when(rest, F.col(CONTROL))), 6).alias("baseline_control_lift"),
    )


def did_columns(naive: Column, lift: Column, rows: Column) -> list[Column]:
    """The estimate in its rounding order: 4 digits less 6, to 4, times rows, to 2."""
    per_row = round_n(naive - lift, 4)
    return [per_row.alias("did_mae_per_row"), round_n(per_row * rows, 2).alias("did_amount")]


def attribution_did(df: DataFrame, segment: str, value, time: str = "pickup_at") -> DataFrame:
    """Both arms of one segment in a single pass over the table."""
    hit = F.col(segment) == F.lit(value)
    rest = F.col(segment) != F.lit(value)

    def gap(side):
        return F.avg(F.when(side, F.col(ERROR))) - F.avg(F.when(side, F.col(CONTROL)))

    both = df.agg(
        F.count_if(hit).alias("affected_rows"),
        round_n(gap(hit), 4).alias("naive_mae_per_row"),
        round_n(F.sum(F.when(hit, F.col(ERROR) - F.col(CONTROL))), 2).alias("naive_amount"),
        F.count_if(rest).alias("baseline_rows"),
        F.coalesce(round_n(gap(rest), 6), F.lit(0.0)).alias("lift"),
        F.count_if(F.col(segment).isNull()).alias("null_segment_rows"),
        F.min(F.when(hit, F.col(time))).alias("first_affected_at"),
        F.max(F.when(hit, F.col(time))).alias("last_affected_at"),
    )
    return both.select(
        "affected_rows", "naive_mae_per_row", "naive_amount", "baseline_rows",
        round_n("lift", 4).alias("baseline_lift_per_row"),
        *did_columns(F.col("naive_mae_per_row"), F.col("lift"), F.col("affected_rows")),
        "null_segment_rows", "first_affected_at", "last_affected_at",
    )


def attribution_all(df: DataFrame, segment: str, time: str = "pickup_at") -> DataFrame:
    """The estimate for every segment from one shuffle.

    Each baseline is the table total less the segment's own sums. The total is a
    one-row subquery over the grouped result, not another scan.
    """
    per_segment = materialize(
        df.groupBy(F.col(segment).alias("segment"))
        .agg(
            F.count("*").alias("n"), F.count(ERROR).alias("ne"), F.count(CONTROL).alias("nc"), F.sum(ERROR).alias("e"), F.sum(CONTROL).alias("c"),
            F.sum(F.col(ERROR) - F.col(CONTROL)).alias("d"), F.sum(TARGET).alias("t"),
            F.min(time).alias("first_affected_at"), F.max(time).alias("last_affected_at"),
        ),
        "segments",
    )
    named = per_segment.filter(F.col("segment").isNotNull())
    parts = ("n", "ne", "nc", "e", "c")
    total = named.agg(F.struct(*[F.sum(x).alias(x) for x in parts])).scalar()
    unnamed = per_segment.filter(F.col("segment").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    with_total = named.withColumn("all", total).withColumn("null_segment_rows", unnamed)

    def mean(of: str, count: str) -> Column:
        """Of the rows that have the error: a row without one takes no part in its mean."""
        return F.col(of) / F.nullif(F.col(count), F.lit(0))

    def rest(of: str, count: str) -> Column:
        return (F.coalesce(F.col(f"all.{of}"), F.lit(0.0)) - F.coalesce(F.col(of), F.lit(0.0))) / F.nullif(F.col(f"all.{count}") - F.col(count), F.lit(0))

    lift = round_n(rest("e", "ne") - rest("c", "nc"), 6)
    sized = with_total.select(
        "segment",
        F.col("n").alias("affected_rows"),
        round_n(mean("e", "ne"), 4).alias("production_mae"),
        round_n(mean("c", "nc"), 4).alias("control_mae"),
        round_n(mean("e", "ne") - mean("c", "nc"), 4).alias("naive_mae_per_row"),
        round_n("d", 2).alias("naive_amount"),
        round_n("t", 2).alias("gross_amount_exposed"),
        (F.col("all.n") - F.col("n")).alias("baseline_rows"),
        F.coalesce(lift, F.lit(0.0)).alias("lift"),
        "null_segment_rows", "first_affected_at", "last_affected_at",
    )
    return sized.select(
        *[c for c in sized.columns if c != "lift"],
        round_n("lift", 4).alias("baseline_lift_per_row"),
        *did_columns(F.col("naive_mae_per_row"), F.col("lift"), F.col("affected_rows")),
    )


def signed_net(df: DataFrame, segment: str) -> DataFrame:
    """Signed error sums: shows whether over- and under-predictions cancel."""
    return df.groupBy(segment).agg(
        F.count("*").alias("rows"),
        round_n(F.sum(F.col("predicted_total") - F.col(TARGET)), 2).alias("production_net"),
        round_n(F.sum(F.col("control_predicted_total") - F.col(TARGET)), 2).alias("control_net"),
    )


def three_arm_attribution(df: DataFrame, segment: str, errors: Mapping[str, str]) -> DataFrame:
    """Split the gap into a training-window part and an encoder part.

    ``errors`` names the error columns of the ``production``, ``window`` and
    ``control`` arms; the window arm has the old encoder on the new window.
    """
    p, w, c = (F.avg(errors[k]) for k in ("production", "window", "control"))
    return df.groupBy(segment).agg(
        F.count("*").alias("rows"),
        round_n(p, 4).alias("production_mae"),
        round_n(w, 4).alias("window_mae"),
        round_n(c, 4).alias("control_mae"),
        round_n(p - w, 4).alias("window_effect"),
        round_n(w - c, 4).alias("encoder_effect"),
    )
