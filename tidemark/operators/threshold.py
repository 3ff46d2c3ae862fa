"""First day a series reaches a value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tidemark.functions.columns import as_column, key_list


def first_reaching(
    series: DataFrame,
    target: Column | float,
    by: str | Sequence[str] | None = None,
    value: str = "running_cumulative_sum",
    day: str = "date",
) -> DataFrame:
    """``(by..., day)``: earliest day on which ``value >= target``, else null."""
    reached = F.when(F.col(value) >= as_column(target), F.col(day))
    return series.groupBy(*key_list(by)).agg(F.min(reached).alias("day"))
