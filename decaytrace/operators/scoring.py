"""Train and score model arms on the feature table.

``GroupMeanArm`` is a predictor that SQL can reproduce exactly. ``GbtArm`` is the
boosted-tree arm, an MLlib model. Both are trained on a window of periods and score
another period without rows leaving the executors.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import round_n
from ..session import materialize
from . import boosting
from .features import period_in

# Boosted-tree settings shared by both arms.
GBT_SETTINGS = {"maxIter": 250, "stepSize": 0.1, "maxDepth": 8, "seed": 42}


@dataclass(frozen=True)
class GroupMeanArm:
    """Mean target per combination of flags, the training mean where unseen."""

    flags: Sequence[str]
    periods: Sequence[str]


def training_cells(
    rows: DataFrame, arms: Mapping[str, GroupMeanArm], target: str, period: str = "feed_month"
) -> DataFrame:
    """Sum and count of the target per flag combination, for every arm in one pass.

    The result has one row per combination of 0/1 flags, so everything trained
    from it is tiny and is planned from this one exchange.
    """
    flags = list(dict.fromkeys(f for arm in arms.values() for f in arm.flags))
    sums = []
    for output, arm in arms.items():
        inside = F.col(period).isin(list(arm.periods))
        sums += [
            F.sum(F.when(inside, F.col(target))).alias(f"sum__{output}"),
            F.count(F.when(inside, F.col(target))).alias(f"n__{output}"),
        ]
    return rows.groupBy(*flags).agg(*sums)


def score_arms(
    rows: DataFrame, arms: Mapping[str, GroupMeanArm], score_period: str, target: str, period: str = "feed_month"
) -> DataFrame:
    """Predictions of every arm over one period, with absolute errors."""
    cells = materialize(training_cells(rows, arms, target, period), "cells")
    out = rows.filter(F.col(period) == score_period)
    for output, arm in arms.items():
        mean = F.sum(f"sum__{output}") / F.nullif(F.sum(f"n__{output}"), F.lit(0))
        means = cells.groupBy(*arm.flags).agg(mean.alias("_mean"))
        out = (
            out.join(means, list(arm.flags), "left")
            .withColumn(output, F.coalesce("_mean", cells.agg(mean).scalar()))
            .drop("_mean")
        )
    return out.select(*rows.columns, *arms, *[abs_error(o, target).alias(error_name(o)) for o in arms])


def error_name(output: str) -> str:
    """predicted_total -> abs_error, control_predicted_total -> control_abs_error."""
    prefix = output.removesuffix("predicted_total")
    return f"{prefix}abs_error"


def abs_error(prediction: str, target: str) -> Column:
    return F.abs(F.col(prediction) - F.col(target))


@dataclass(frozen=True)
class GbtArm:
    """Gradient-boosted trees over assembled numeric features."""

    features: Sequence[str]
    periods: Sequence[str]
    settings: Mapping[str, object] = field(default_factory=lambda: dict(GBT_SETTINGS))
    period: str = "feed_month"

    def fit(self, rows: DataFrame, target: str) -> PipelineModel:
        assembler = VectorAssembler(inputCols=list(self.features), outputCol="features", handleInvalid="keep")
        return PipelineModel([assembler, boosting.fit(period_in(rows, self.periods, self.period), self.features, target, **self.settings)])


ROWS_A_TASK = 500_000  # trained in some tenths of a second a level


def fit_arms(rows: DataFrame, arms: Mapping[str, GbtArm], target: str) -> dict[str, PipelineModel]:
    """Train all arms at once, each in as many even partitions as its share of the cores has or, of
    a larger table, that many times so many that none has more than ``ROWS_A_TASK`` rows.

    A tree of depth 8 is about ten short jobs, one after the other, whose fixed cost outweighs
    the work on a small table; arms do not depend on each other, so their jobs overlap.
    """
    spark = rows.sparkSession
    cores = max(1, spark.sparkContext.defaultParallelism // max(1, len(arms)))

    def fit(arm: GbtArm) -> PipelineModel:
        own = period_in(rows, arm.periods, arm.period)
        return arm.fit(own.repartition(cores * max(1, math.ceil(own.count() / (cores * ROWS_A_TASK)))), target)

    with ThreadPoolExecutor(max(1, len(arms))) as pool:
        fits = {name: pool.submit(inheritable_thread_target(spark)(fit), arm) for name, arm in arms.items()}
        return {name: fit.result() for name, fit in fits.items()}


def score_models(rows: DataFrame, models: Mapping[str, PipelineModel], target: str) -> DataFrame:
    """Add each fitted pipeline's prediction and absolute error to the rows."""
    out = rows
    for output, model in models.items():
        out = model.transform(out).drop("features").withColumnRenamed("prediction", output)
    for output in models:
        out = out.withColumn(error_name(output), abs_error(output, target))
    return out


def train_stats(rows: DataFrame, periods: Sequence[str], category: str, period: str = "feed_month") -> DataFrame:
    """Rows and the sorted distinct categories of a training window.

    The categories are first reduced to one row each, so the list is as long as
    the number of categories and no longer.
    """
    per_value = period_in(rows, periods, period).groupBy(category).agg(F.count("*").alias("_n"))
    return per_value.agg(
        F.sum("_n").alias("training_rows"),
        F.array_sort(F.collect_list(category)).alias("categories"),
    )


def mae(rows: DataFrame, prediction: str, target: str) -> DataFrame:
    return rows.agg(round_n(F.avg(F.abs(F.col(prediction) - F.col(target))), 6).alias("in_sample_mae"))


def model_card(
    rows: DataFrame, variant: str, features: Sequence[str], periods: Sequence[str], category: str,
    prediction: str, target: str, algorithm: str, settings: Mapping[str, object], period: str = "feed_month",
) -> DataFrame:
    """One row that describes a trained arm. ``rows`` hold its in-sample predictions."""
    per_value = (
        period_in(rows, periods, period)
        .groupBy(category)
        .agg(F.count("*").alias("_n"), F.sum(F.abs(F.col(prediction) - F.col(target))).alias("_err"))
    )
    return per_value.agg(
        F.lit(variant).alias("variant"),
        F.array(*[F.lit(f) for f in features]).alias("features"),
        F.array(*[F.lit(p) for p in periods]).alias("training_periods"),
        F.sum("_n").alias("training_rows"),
        F.array_sort(F.collect_list(category)).alias("categories_in_training_data"),
        F.create_map(*[F.lit(str(x)) for kv in settings.items() for x in kv]).alias("hyperparameters"),
        round_n(F.sum("_err") / F.sum("_n"), 6).alias("in_sample_mae"),
        F.lit(algorithm).alias("algorithm"),
        F.lit(target).alias("target"),
    )
