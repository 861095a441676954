"""Names of datasets and their columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import col
from ..operators.monitors import monitor_dtype


def resolve_dataset(c: Column | str, registry: Sequence[tuple[str, str]], strict: bool = False) -> Column:
    """Table behind an entity name.

    Tried in turn: the exact entity name, the exact table, the first registry
    entry that contains the text. The registry is configuration, a short list, so
    it is carried as a literal and no join is needed.
    """
    name = col(c)
    entries = F.array(*[F.struct(F.lit(u).alias("urn"), F.lit(t).alias("table")) for u, t in registry])
    by_urn = F.get(F.filter(entries, lambda r: r["urn"] == name), F.lit(0))["table"]
    by_table = F.get(F.filter(entries, lambda r: r["table"] == name), F.lit(0))["table"]
    by_part = F.get(
        F.filter(entries, lambda r: r["urn"].contains(name) | r["table"].contains(name)), F.lit(0)
    )["table"]
    found = F.coalesce(by_urn, by_table, by_part)
    if strict:
        return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown dataset: "), name)).cast("string"))
    return found


def list_columns(df: DataFrame) -> DataFrame:
    """Column names and types, with the non-null rows of each."""
    return monitor_dtype(df, df.columns)
