"""Category encodings and the null guards that go with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .numbers import col


def one_hot_fixed(c: Column | str, known: Mapping[str, object]) -> list[Column]:
    """One 0/1 column per known category. Unknown and NULL give all zeros."""
    return [F.when(col(c) == F.lit(v), 1).otherwise(0).alias(name) for name, v in known.items()]


def one_hot_catchall(c: Column | str, known: Sequence, nulls_as_unknown: bool = False) -> Column:
    """1 for any value outside ``known``. NULL stays 0 unless asked otherwise."""
    unknown = ~col(c).isin(list(known))
    if nulls_as_unknown:
        unknown = unknown | col(c).isNull()
    return F.when(unknown, 1).otherwise(0)


def flag_in(c: Column | str, values: Sequence) -> Column:
    return F.when(col(c).isin(list(values)), 1).otherwise(0)


def flag_eq(c: Column | str, value) -> Column:
    return F.when(col(c) == F.lit(value), 1).otherwise(0)


def extra_flag(c: Column | str, value) -> Column:
    """Flag that is 0, never NULL, for a NULL category."""
    return F.coalesce((col(c) == F.lit(value)).cast("int"), F.lit(0))


def default_count(c: Column | str, default: float = 1.0) -> Column:
    return F.coalesce(col(c), F.lit(default))


def avg_speed(distance: Column | str, minutes: Column | str) -> Column:
    """Distance per hour. A zero duration becomes 0.0: the guard that hides a collapse."""
    hours = F.nullif(col(minutes) / F.lit(60.0), F.lit(0.0))
    return F.coalesce(col(distance) / hours, F.lit(0.0))


def price_per_unit(amount: Column | str, units: Column | str) -> Column:
    return col(amount) / F.nullif(col(units), F.lit(0.0))
