"""Actual and predicted values as one long-form series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tidemark.functions.columns import key_list
from tidemark.functions.grains import Grain, grain_of
from tidemark.operators.forecast import forecast_until

# The names of the two chart series.
ACTUAL = "Actual Count"
PREDICTED = "Predicted"


def actual_series(stats: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Running totals by calendar day: ``(by..., day, tagCount, valueType)``."""
    return stats.select(
        *key_list(by),
        F.col("date").alias("day"),
        F.col("running_cumulative_sum").cast("double").alias("tagCount"),
        F.lit(ACTUAL).alias("valueType"),
    )


def predicted_series(
    model: DataFrame,
    target: Column | float,
    by: str | Sequence[str] | None = None,
    max_horizon: int | None = None,
    grain: str | Grain = "day",
) -> DataFrame:
    """Forecast by calendar day, in the same columns. Needs ``min_date`` in the model.

    With an explicit ``max_horizon``, which may cut a series, ``status`` is kept.
    """
    rows = forecast_until(model, target, by, max_horizon, keep=["min_date"], grain=grain)
    status = [] if max_horizon is None else ["status"]
    return rows.select(
        *key_list(by),
        grain_of(grain).add("min_date", "days_elapsed").alias("day"),
        "tagCount",
        F.lit(PREDICTED).alias("valueType"),
        *status,
    )


def combined_series(
    stats: DataFrame,
    model: DataFrame,
    target: Column | float,
    by: str | Sequence[str] | None = None,
    max_horizon: int | None = None,
    grain: str | Grain = "day",
) -> DataFrame:
    """Actual rows followed by predicted rows (sort at the sink).

    ``status`` is as in ``predicted_series``, null for actual rows.
    """
    predicted = predicted_series(model, target, by, max_horizon, grain)
    return actual_series(stats, by).unionByName(predicted, allowMissingColumns=True)
