"""Rounding and number parsing with SQL-stable results."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_n(x: Column | str, digits: int) -> Column:
    """Round half away from zero on the scaled double.

    ``F.round`` on a double rounds its decimal text, so 1.005 becomes 1.01 where
    most SQL engines give 1.0. Scaling first gives the latter.
    """
    scale = float(10 ** digits)
    return F.round(col(x) * F.lit(scale)) / F.lit(scale)


def pct(part: Column, whole: Column, digits: int = 4) -> Column:
    """``100 * part / whole``, NULL for an empty whole."""
    return round_n(F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def is_castable(dtype: T.DataType) -> bool:
    """Types whose text or value can stand for a number. Times and nested types cannot."""
    return isinstance(dtype, NUMERIC_TYPES + (T.BooleanType, T.StringType))


def safe_double(c: Column | str, dtype: T.DataType) -> Column:
    """Double value or NULL; decided by type first, since times would cast to epochs."""
    if not is_castable(dtype):
        return F.lit(None).cast("double")
    if isinstance(dtype, T.StringType):
        return col(c).try_cast("double")
    return col(c).cast("double")


def parse_literal(c: Column | str) -> Column:
    """Integer when the text is one, else NULL; keep the text column beside it."""
    trimmed = F.trim(col(c))
    return F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), trimmed.try_cast("bigint"))
