"""How the set of values in a column changes from period to period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.encoding import price_per_unit
from ..functions.numbers import pct, round_n
from ..functions.times import minute_boundaries
from ..session import materialize

# Fixed value: a column is categorical when no period has more distinct values.
MAX_CATEGORIES = 50


def per_value(df: DataFrame, column: str, period: str = "feed_month") -> DataFrame:
    """Rows per period and value: the reduction that every profile below starts from."""
    return df.groupBy(period, column).agg(F.count("*").alias("_n"))


def cardinality_of(counts: DataFrame, column: str, period: str) -> DataFrame:
    return counts.groupBy(period).agg(
        F.count(column).alias("distinct_values"),
        F.sum("_n").alias("rows"),
        pct(F.sum(F.when(F.col(column).isNull(), F.col("_n")).otherwise(0)), F.sum("_n")).alias("null_pct"),
    )


def profile_cardinality(df: DataFrame, column: str, period: str = "feed_month") -> DataFrame:
    """Distinct values, rows and null share per period."""
    return cardinality_of(per_value(df, column, period), column, period)


def low_card_gate(df: DataFrame, column: str, period: str = "feed_month", limit: int = MAX_CATEGORIES) -> DataFrame:
    return profile_cardinality(df, column, period).agg(
        F.lit(column).alias("column"),
        F.max("distinct_values").alias("max_distinct"),
        (F.max("distinct_values") <= limit).alias("is_categorical"),
    )


def value_counts(df: DataFrame, column: str, period: str = "feed_month", limit: int = MAX_CATEGORIES) -> DataFrame:
    """Rows per period and value, NULL as its own group, and whether the column is categorical.

    Every value is there whatever the gate says; the caller decides by ``is_categorical``.
    The counts are written once; the gate is a one-row subquery over them.
    """
    counts = materialize(per_value(df, column, period), "values")
    gate = cardinality_of(counts, column, period).agg(F.max("distinct_values") <= limit).scalar()
    return counts.select(period, F.col(column).cast("string").alias("value"), F.col("_n").alias("rows"), gate.alias("is_categorical"))


def value_sets(df: DataFrame, column: str, period: str = "feed_month", limit: int = MAX_CATEGORIES) -> DataFrame:
    """The values of each period, one row per (period, value)."""
    return value_counts(df, column, period, limit).filter(F.col("value").isNotNull()).select(period, "value", "is_categorical")


def first_seen(counts: DataFrame, period: str) -> DataFrame:
    """First period of each value and its rows there, from the counts alone."""
    return (
        counts.filter(F.col("value").isNotNull())
        .groupBy("value")
        .agg(
            F.min(period).alias("first_seen"), F.min_by("rows", period).alias("rows_in_first_period"),
            F.first("is_categorical").alias("is_categorical"),
        )
    )


def first_period_count(df: DataFrame, column: str, period: str = "feed_month", limit: int = MAX_CATEGORIES) -> DataFrame:
    return first_seen(value_counts(df, column, period, limit), period)


def new_values(df: DataFrame, column: str, period: str = "feed_month", limit: int = MAX_CATEGORIES) -> DataFrame:
    """Values that appear after the first period. A value that returns is not new."""
    counts = value_counts(df, column, period, limit)
    baseline = counts.filter(F.col("value").isNotNull()).agg(F.min(period)).scalar()
    return first_seen(counts, period).filter(F.col("first_seen") > baseline)


def known_so_far(df: DataFrame, column: str, period: str = "feed_month", limit: int = MAX_CATEGORIES) -> DataFrame:
    """Per period: how many values entered, and how many are known up to and including it.

    Which they are is one row per value in ``first_period_count``: a value is known from its
    ``first_seen`` on. No list is gathered, and the window sees one row per period.
    """
    counts = value_counts(df, column, period, limit)
    entered = counts.join(first_seen(counts, period).select("value", "first_seen"), "value", "left").groupBy(period).agg(
        F.count_if(F.col(period) == F.col("first_seen")).alias("entered"), F.first("is_categorical").alias("is_categorical")
    )
    w = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return entered.select(period, "entered", F.sum("entered").over(w).alias("known"), "is_categorical")


def as_code(c: str, null_as_code: bool) -> Column:
    text = F.col(c).cast("string")
    return F.coalesce(text, F.lit("None")) if null_as_code else text


def code_counts_all(
    df: DataFrame, columns: Sequence[str], period: str = "feed_month",
    null_as_code: bool = True, present: str | None = None,
) -> DataFrame:
    """Rows per (period, column, code) over many columns: one scan and one shuffle.

    ``present`` names an array column that lists the columns a period really has;
    a column missing from a period gives no code, not a NULL code.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), as_code(c, null_as_code).alias("code")) for c in columns])
    if present:
        pairs = F.filter(pairs, lambda p: F.array_contains(F.col(present), p["column"]))
    return (
        df.select(period, F.explode(pairs).alias("p"))
        .groupBy(period, F.col("p.column").alias("column"), F.col("p.code").alias("code"))
        .agg(F.count("*").alias("rows"))
        .filter(F.col("code").isNotNull())
    )


def scan_codes(
    df: DataFrame, columns: Sequence[str], period: str = "feed_month",
    null_as_code: bool = True, present: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Codes that appear after the first period in which their column is present.

    ``limit`` drops columns that are not categorical in every period.
    """
    counts = materialize(code_counts_all(df, columns, period, null_as_code, present), "codes")
    firsts = counts.groupBy("column", "code").agg(
        F.min(period).alias("first_seen"), F.min_by("rows", period).alias("rows_in_first_period")
    )
    per_period = counts.groupBy("column", period).agg(F.count("*").alias("codes"))
    baseline = per_period.groupBy("column").agg(F.min(period).alias("baseline"), F.max("codes").alias("codes"))
    if limit is not None:
        baseline = baseline.filter(F.col("codes") <= limit)
    # one row per scanned column: bounded by the argument list, not by the data
    return (
        firsts.join(F.broadcast(baseline), "column")
        .filter(F.col("first_seen") > F.col("baseline"))
        .drop("baseline", "codes")
    )


def unseen_categories(
    serving: DataFrame, training: DataFrame, column: str, period: str = "feed_month"
) -> DataFrame:
    """Serving values absent from the training rows, with rows and first period.

    Both sides are reduced to one row per value before they meet.
    """
    seen = training.select(column).distinct()
    values = (
        serving.groupBy(column)
        .agg(F.count("*").alias("rows"), F.min(period).alias("first_seen"))
        .filter(F.col(column).isNotNull())
    )
    return values.join(seen, column, "left_anti")


def load_summary(df: DataFrame, column: str, value, period: str = "feed_month") -> DataFrame:
    return df.groupBy(period).agg(
        F.count("*").alias("rows"), F.count_if(F.col(column) == F.lit(value)).alias("code_rows")
    )


def share_of_feed(df: DataFrame, column: str, value, amount: str) -> DataFrame:
    hit = F.col(column) == F.lit(value)
    return df.agg(
        F.count_if(hit).alias("code_rows"),
        F.count("*").alias("all_rows"),
        pct(F.count_if(hit), F.count("*"), 3).alias("pct_of_feed"),
        round_n(F.sum(F.when(hit, F.col(amount)).otherwise(0.0)), 2).alias("code_gross"),
    )


def code_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column))


def profile_all_columns(df: DataFrame, columns: Sequence[str], period: str = "feed_month") -> DataFrame:
    """Cardinality, rows and null share of every column and period.

    Several COUNT(DISTINCT) in one aggregate multiply the rows through an Expand.
    Here each value is counted once in a partial aggregate, then counted again.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    counts = (
        df.select(period, F.explode(pairs).alias("p"))
        .groupBy(period, F.col("p.column").alias("column"), F.col("p.value").alias("value"))
        .agg(F.count("*").alias("_n"))
    )
    return counts.groupBy(period, "column").agg(
        F.count("value").alias("distinct_values"),
        F.sum("_n").alias("rows"),
        pct(F.sum(F.when(F.col("value").isNull(), F.col("_n")).otherwise(0)), F.sum("_n")).alias("null_pct"),
    )


def cardinality_vs_volume(df: DataFrame, column: str, period: str = "feed_month") -> DataFrame:
    """Growth of distinct values against growth of rows, period over period.

    Distinct counts on a continuous column grow with volume, so a rise is only
    anomalous where it outpaces the rows. The window sees one row per period.
    """
    w = Window.orderBy(period)
    grown = profile_cardinality(df, column, period).select(
        period,
        "distinct_values",
        "rows",
        (F.col("distinct_values") / F.nullif(F.lag("distinct_values").over(w), F.lit(0))).alias("distinct_growth"),
        (F.col("rows") / F.nullif(F.lag("rows").over(w), F.lit(0))).alias("row_growth"),
    )
    return grown.select(
        period, "distinct_values", "rows",
        round_n("distinct_growth", 6).alias("distinct_growth"),
        round_n("row_growth", 6).alias("row_growth"),
        ((F.col("distinct_growth") > 1) & (F.col("distinct_growth") > F.col("row_growth"))).alias("outpaces_rows"),
    )


def segment_contrast(df: DataFrame, segment: str) -> DataFrame:
    """Averages per segment on plausible rows."""
    return df.groupBy(segment).agg(
        F.count("*").alias("trips"),
        round_n(F.avg("trip_distance"), 3).alias("avg_miles"),
        round_n(F.avg("total_amount"), 3).alias("avg_total"),
        round_n(F.avg("fare_amount"), 3).alias("avg_fare"),
        round_n(F.avg("tip_amount"), 3).alias("avg_tip"),
        round_n(F.avg(price_per_unit("total_amount", "trip_distance")), 3).alias("avg_price_per_mile"),
        round_n(F.avg(minute_boundaries("pickup_at", "dropoff_at").cast("double")), 2).alias("avg_minutes"),
    )
