"""Global ranks without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize


def _placed(df: DataFrame, order: Sequence[Column], within: Sequence[str]) -> DataFrame:
    """The rows by range over (within, order), sorted and written, with their place ``_at`` and partition ``_part``."""
    keys = [F.col(c).asc_nulls_first() for c in within] + list(order)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return materialize(placed, "ranked").withColumn("_part", F.shiftright("_at", 33))


def _carried(placed: DataFrame, within: Sequence[str], total: Column) -> DataFrame:
    """``placed`` with ``_before``, the sum of ``total`` over a key's earlier partitions, and ``_first``,
    where the key begins in this one: a window over one row per partition and key."""
    runs = placed.groupBy("_part", *within).agg(total.alias("_total"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_w{k}") for k, c in enumerate(within)],
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"), "_first",
    )
    runs = materialize(runs, "runs")
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(within):
        same &= placed[c].eqNullSafe(F.col(f"_w{k}"))
    return placed.join(runs, same).drop("_p", *[f"_w{k}" for k in range(len(within))])


def ranked(df: DataFrame, order: Sequence[Column], within: Sequence[str] = (), column: str = "rank") -> DataFrame:
    """``df`` with the place of each row, from 0, by ``order`` among the rows with equal ``within``.

    Rows are partitioned by range over (within, order), so a key with many rows spans several
    partitions, and sorted and written with their place in the partition. What lies before a
    partition is a sum over one row per partition and key. Null keys are a key of their own.
    Rows that are equal in ``within`` and ``order`` are placed in any order.
    """
    rows = _carried(_placed(df, order, within), within, F.count(F.lit(1)))
    return rows.withColumn(column, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_before", "_first")


def summed_before(df: DataFrame, weight: str, order: Sequence[Column], within: Sequence[str] = (), column: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` over the rows that come before each row by ``order``, 0 for the
    first, among those with equal ``within``. Partitions as ``ranked``: a window sees one partition's
    rows of a key, never a whole key."""
    rows = _carried(_placed(df, order, within), within, F.sum(weight))
    here = Window.partitionBy("_part", *within).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_before") + F.coalesce(F.sum(weight).over(here), F.lit(0))
    return rows.withColumn(column, total).drop("_at", "_part", "_before", "_first")
