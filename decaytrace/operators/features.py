"""Staging filter and model features for a fare-shaped feed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import encoding as enc, times

# Plausibility bounds, inclusive.
DISTANCE_BOUNDS = (0.1, 100.0)
TOTAL_BOUNDS = (1.0, 500.0)

# The categories known when the encoder was written.
KNOWN_VENDORS = {"is_vendor_cmt": 1, "is_vendor_curb": 2, "is_vendor_myle": 6}
AIRPORT_RATES = (2.0, 3.0)
CARD_PAYMENT = 1

STAGED_COLUMNS = [
    "vendor_id", "pickup_at", "dropoff_at", "passenger_count", "trip_distance", "ratecode_id",
    "store_and_fwd_flag", "pu_location_id", "do_location_id", "payment_type", "fare_amount",
    "tip_amount", "total_amount", "feed_month",
]

FEATURES = [
    "trip_distance", "trip_minutes", "avg_speed_mph", "passenger_count", "pickup_hour", "pickup_dow",
    "pu_location_id", "do_location_id", *KNOWN_VENDORS, "is_airport_rate", "is_card_payment",
]
TARGET = "total_amount"


@dataclass(frozen=True)
class Encoder:
    """What the feature job knows about the category column."""

    column: str = "vendor_id"
    known: Mapping[str, object] = field(default_factory=lambda: dict(KNOWN_VENDORS))
    catchall: str | None = None
    nulls_as_unknown: bool = False

    def columns(self) -> list:
        cols = enc.one_hot_fixed(self.column, self.known)
        if self.catchall:
            cols.append(
                enc.one_hot_catchall(self.column, list(self.known.values()), self.nulls_as_unknown).alias(self.catchall)
            )
        return cols


def stage_filter(feed: DataFrame) -> DataFrame:
    """Drop impossible rows. Unknown categories pass; NULL amounts do not."""
    return feed.filter(
        F.col("trip_distance").between(*DISTANCE_BOUNDS)
        & F.col("total_amount").between(*TOTAL_BOUNDS)
        & (F.col("fare_amount") > 0)
        & F.col("pickup_at").isNotNull()
        & F.col("dropoff_at").isNotNull()
    )


def stage_project(feed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return feed.select(
        *keep, *STAGED_COLUMNS, times.minutes_between("pickup_at", "dropoff_at").alias("trip_minutes")
    )


def stage(feed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return stage_project(stage_filter(feed), keep)


def mart_features(staged: DataFrame, encoder: Encoder = Encoder(), keep: Sequence[str] = ()) -> DataFrame:
    """One narrow projection: no shuffle, one pass of generated code."""
    return staged.select(
        *keep,
        "pickup_at",
        "feed_month",
        "trip_distance",
        "trip_minutes",
        enc.avg_speed("trip_distance", "trip_minutes").alias("avg_speed_mph"),
        enc.default_count("passenger_count").alias("passenger_count"),
        times.hour_part("pickup_at").alias("pickup_hour"),
        times.dow_part("pickup_at").alias("pickup_dow"),
        "pu_location_id",
        "do_location_id",
        *encoder.columns(),
        enc.flag_in("ratecode_id", AIRPORT_RATES).alias("is_airport_rate"),
        enc.flag_eq("payment_type", CARD_PAYMENT).alias("is_card_payment"),
        "vendor_id",
        "total_amount",
    )


def period_in(df: DataFrame, periods: Sequence[str], period: str = "feed_month") -> DataFrame:
    """Rows of the given periods; prunes folders when ``period`` partitions the table."""
    return df.filter(F.col(period).isin(list(periods)))


def period_eq(df: DataFrame, value: str, period: str = "feed_month") -> DataFrame:
    return df.filter(F.col(period) == value)
