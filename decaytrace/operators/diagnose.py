"""From changed codes to damaged inputs to cost: findings, ranked.

A finding is a code that appears part-way through history in a column whose own
segments carry the damage. Two independent routes are reported for each: inputs
that collapse only in that segment, and an encoding in which the segment matches
no category.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import attribution, drift, monitors, profile
from .ranks import ranked


def segment_damage(scored: DataFrame, column: str, inputs: Sequence[str]) -> DataFrame:
    """Drift signals and attributable error of each value of one column."""
    names = [c for c in inputs if c != column]
    signals = drift.drift_report(scored, column, names).select(
        F.col("segment").cast("string").alias("code"), "degenerate_only", "all_family_zero", "family_inputs"
    )
    cost = attribution.attribution_all(scored, column).select(
        F.col("segment").cast("string").alias("code"), "affected_rows", "naive_mae_per_row", "naive_amount", "did_mae_per_row", "did_amount"
    )
    return signals.join(cost, "code").select(F.lit(column).alias("column"), "*")


def diagnose(
    feed: DataFrame, scored: DataFrame, columns: Sequence[str], inputs: Sequence[str],
    root_columns: DataFrame | None = None, period: str = "feed_month",
) -> DataFrame:
    """Ranked findings, one per (column, new code).

    Ranking follows causal precedence: a column that defines a damaged segment
    comes before one that merely looks odd, more explained signals before fewer,
    then the larger cost. ``root_columns`` (feature, root_column) marks inputs
    whose lineage really reaches the column.
    """
    fresh = profile.scan_codes(feed, columns, period, null_as_code=False)
    present = [c for c in columns if c in scored.columns]
    damage = reduce(lambda a, b: a.unionByName(b), [segment_damage(scored, c, inputs) for c in present])
    findings = fresh.join(damage, ["column", "code"], "left")
    unmapped = F.coalesce("all_family_zero", F.lit(False))
    empty = F.array().cast("array<string>")
    collapsed = F.coalesce("degenerate_only", empty)
    by_encoding = F.when(unmapped, F.col("family_inputs")).otherwise(empty)
    routed = findings.select(
        "column", "code", "first_seen", "rows_in_first_period",
        unmapped.alias("unmapped_category"),
        # an input of the encoding family is the other route, so it is not counted as collapsed
        F.array_except(collapsed, F.coalesce("family_inputs", empty)).alias("collapsed_inputs"),
        F.array_sort(F.array_union(collapsed, by_encoding)).alias("affected_features"),
        F.coalesce("affected_rows", F.lit(0)).alias("affected_rows"), "naive_mae_per_row", "naive_amount",
        F.coalesce("did_mae_per_row", F.lit(0.0)).alias("did_mae_per_row"),
        F.coalesce("did_amount", F.lit(0.0)).alias("did_amount"),
    )
    scoredf = routed.withColumn(
        "signals", F.col("unmapped_category").cast("int") + (F.size("collapsed_inputs") > 0).cast("int")
    ).withColumn("defines_damage", (F.col("did_amount") > 0) & (F.col("signals") > 0))
    order = [F.col(c).desc_nulls_last() for c in ("defines_damage", "signals", "did_amount")] + [F.col(c).asc() for c in ("first_seen", "column", "code")]
    placed = ranked(scoredf, order).withColumn("rank", (F.col("rank") + 1).cast("int"))
    if root_columns is None:
        return placed
    reach = (
        placed.select("column", "code", F.explode("affected_features").alias("feature"))
        .join(root_columns.select("feature", F.col("root_column").alias("column")).distinct(), ["feature", "column"])
        .groupBy("column", "code")
        .agg(F.count("*").alias("confirmed_by_lineage"))
    )
    return placed.join(reach, ["column", "code"], "left").withColumn(
        "confirmed_by_lineage", F.coalesce("confirmed_by_lineage", F.lit(0))
    )


def as_findings(diagnosis: DataFrame, model: str, dataset: str, verdicts: DataFrame | None = None) -> DataFrame:
    """Diagnosis rows as ledger findings.

    ``verdicts`` (column, monitor, fires) are the monitors that were read on each column; what
    a finding says about them is counted there, and nothing is said without them.
    """
    if verdicts is None:
        diagnosis = diagnosis.withColumn("why_missed", F.lit(None).cast("string"))
    else:
        read = verdicts.groupBy("column").agg(
            F.count("*").alias("_read"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("fires"), F.col("monitor")))), ", ").alias("_fired")
        )
        said = F.when(F.col("_fired") == "", F.concat(F.lit("None of "), F.col("_read").cast("string"), F.lit(" monitors fired."))).otherwise(
            F.concat(F.lit("Of "), F.col("_read").cast("string"), F.lit(" monitors these fired: "), F.col("_fired"), F.lit("."))
        )
        diagnosis = diagnosis.join(read, "column", "left").withColumn("why_missed", said)
    unmapped, collapsed = F.col("unmapped_category"), F.size("collapsed_inputs") > 0
    routes = F.array_compact(
        F.array(
            F.when(unmapped, F.lit("the encoding has no slot for it")),
            F.when(collapsed, F.concat(F.lit("these inputs collapse: "), F.array_join("collapsed_inputs", ", "))),
        )
    )
    name = F.concat_ws(" ", "column", "code")
    return diagnosis.select(
        F.lit(model).alias("model"), F.lit(dataset).alias("dataset"), "column",
        F.concat(name, F.lit(" appeared in "), F.col("first_seen")).alias("headline"),
        F.concat(name, F.lit(" first seen in "), F.col("first_seen"), F.lit(" with "),
                 F.col("rows_in_first_period").cast("string"), F.lit(" rows.")).alias("change"),
        F.array_join(routes, "; ").alias("mechanism"),
        "why_missed",
        F.lit("Encode the new category and retrain.").alias("fix"),
        F.col("affected_features").alias("features"),
        F.array(F.concat(name, F.lit(" is absent before "), F.col("first_seen"))).alias("proven"),
        routes.alias("inferred"),
        F.struct(
            "affected_rows", "naive_mae_per_row", "naive_amount", "did_mae_per_row", "did_amount",
        ).alias("impact"),
    )


def text(c: Column | str, digits: int | None = None) -> Column:
    """Number as grouped text."""
    x = F.col(c) if isinstance(c, str) else c
    return x.cast("string") if digits is None else F.format_number(x, digits)


def results_tables(
    feed: DataFrame, mart: DataFrame, scored: DataFrame, segment: str, value, derived: str,
    inputs: Sequence[str], period: str = "feed_month", source_options: dict | None = None, derived_options: dict | None = None,
) -> DataFrame:
    """The report as rows (section, key, a, b, c, d), every figure computed here.

    The options are those of ``monitor_verdicts`` for either layer; a monitor that could not
    be measured has no cell.
    """
    none = F.lit(None).cast("string")

    def rows(df, section, key, *cells):
        padded = [*cells, *[none] * (4 - len(cells))]
        return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"),
                         *[c.alias(n) for c, n in zip(padded, "abcd")])

    def listed(by):
        # every value by name, however many: the cell is as long as the list that it reports
        return F.array_join(F.array_sort(F.collect_list("value")), ", ").alias(by)

    new = profile.new_values(feed, segment, period).groupBy(F.col("first_seen").alias(period)).agg(
        listed("new"), F.sum("rows_in_first_period").alias("n")
    )
    values = profile.value_sets(feed, segment, period).groupBy(period).agg(listed("values")).join(new, period, "left")
    verdicts = monitors.monitor_sweep({"source": (feed, segment, source_options or {}), "derived": (mart, derived, derived_options or {})}, period)
    fires = lambda layer: F.max(F.when(F.col("layer") == layer, F.when(F.col("fires"), "FIRES").when(~F.col("fires"), "silent")))
    by_monitor = verdicts.groupBy("monitor").agg(fires("source").alias("s"), fires("derived").alias("d"))
    zeros = monitors.monitor_metrics(mart, derived, period)
    segments = drift.drift_report(scored, segment, inputs)
    impact = attribution.attribution_all(scored, segment).filter(F.col("segment") == F.lit(value))
    parts = [
        rows(values, "values", F.col(period), F.col("values"), F.col("new"), text("n")),
        rows(by_monitor, "monitors", F.col("monitor"), F.col("s"), F.col("d")),
        rows(zeros, "zero_share", F.col(period), text("zero_count"),
             text(F.lit(100.0) * F.col("zero_count") / F.nullif(F.col("row_volume").cast("double"), F.lit(0.0)), 4)),
        rows(segments, "segments", F.col("segment"), text("rows"), text("avg__abs_error", 4),
             text("avg__control_abs_error", 4), F.array_join("degenerate_in_segment", ", ")),
        rows(impact, "impact", F.col("segment"), text("affected_rows"), text("naive_amount", 2),
             text("did_mae_per_row", 4), text("did_amount", 2)),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
