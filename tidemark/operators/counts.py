"""Counts per day and date bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tidemark.functions.columns import key_list
from tidemark.functions.dates import day_of
from tidemark.functions.grains import Grain, grain_of


def daily_counts(
    df: DataFrame, time_col: str, by: str | Sequence[str] | None = None, grain: str | Grain = "day"
) -> DataFrame:
    """Rows per key and day, or another calendar period: ``(by..., date, daily_count)``.

    Time stamps are cut to the start of their period, the ``date``. Whatever the
    ``grain``, the columns keep the names of the daily series, so that all that reads
    a series reads this one. Rows without one form a null group. The
    shuffle key is (key, day) and counting starts before the shuffle, so a hot
    key arrives as at most one row per map task and day.
    """
    return df.groupBy(*key_list(by), grain_of(grain).start(time_col).alias("date")).agg(
        F.count(F.lit(1)).alias("daily_count")
    )


def date_bounds(
    counts: DataFrame, by: str | Sequence[str] | None = None, used: Sequence[str] = ("daily_count",)
) -> DataFrame:
    """First and last dated row, of any count: ``(by..., first_day, last_day)``.

    Takes the counts rather than the events. The extremes are those of the date;
    naming the other columns the series uses, ``used``, keeps the plan below the
    one of the series, so both share one aggregation exchange and one scan.
    """
    dated = counts.where(F.col("date").isNotNull())
    row = F.struct("date", *used)
    return dated.groupBy(*key_list(by)).agg(
        F.min(row)["date"].alias("first_day"), F.max(row)["date"].alias("last_day")
    )


def min_date(df: DataFrame, time_col: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Earliest day of the events: ``(by..., min_date)``."""
    return df.groupBy(*key_list(by)).agg(day_of(F.min(time_col)).alias("min_date"))
