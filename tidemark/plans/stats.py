"""Events to dense daily series with totals, and series to fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec
from tidemark.functions.columns import key_list
from tidemark.functions.grains import Grain, grain_of
from tidemark.operators.counts import daily_counts
from tidemark.operators.gaps import expand_gaps, global_bounds
from tidemark.operators.poisson import fit_poisson


# Column names of the statistics that readers of the results rely on are
# ``filled_daily_count``, ``running_cumulative_sum``, ``days_elapsed`` and ``csum``;
# of the forecast and the chart series, ``tagCount`` and ``valueType``.


def series_stats(
    events: DataFrame,
    time_col: str,
    by: str | Sequence[str] | None = None,
    bounds: str = "per_key",
    max_gap_days: int | None = None,
    grain: str | Grain = "day",
) -> DataFrame:
    """Dense daily statistics of raw events, or those of another ``grain``.

    ``(by..., date, filled_daily_count, running_cumulative_sum, days_elapsed)``.
    One scan; one shuffle of partial counts by key and day, one of counts by
    key. See ``stats_from_counts``.
    """
    return stats_from_counts(daily_counts(events, time_col, by, grain), by, bounds, max_gap_days, grain)


def stats_from_counts(
    counts: DataFrame,
    by: str | Sequence[str] | None = None,
    bounds: str = "per_key",
    max_gap_days: int | None = None,
    grain: str | Grain = "day",
) -> DataFrame:
    """The same from ``(by..., date, daily_count)``, one row per key and day.

    The running total is taken on the sparse rows and repeated over the gap that
    follows, so no dense row is sorted or joined. Undated rows are left out.
    ``bounds`` and ``grain`` are as in ``densify``; ``days_elapsed`` counts periods.
    """
    keys = key_list(by)
    row = global_bounds(counts, bounds, keys)
    so_far = _so_far(keys)
    carry = {
        "_total": F.sum("daily_count").over(so_far),
        "_first_date": F.first("date").over(so_far),
    }
    rows = expand_gaps(counts, keys, row, carry, max_gap_days, grain)
    start = "_first_date" if row is None else "_first_day"
    return rows.select(
        *keys,
        F.col("_day").alias("date"),
        F.expr("CASE WHEN _day = date THEN daily_count ELSE 0 END").alias("filled_daily_count"),
        F.expr("CASE WHEN _day >= date THEN _total ELSE 0 END").alias("running_cumulative_sum"),
        grain_of(grain).between(start, "_day").alias("days_elapsed"),
    )


def _so_far(keys: Sequence[str]) -> WindowSpec:
    ordered = Window.partitionBy(*keys).orderBy("date")
    return ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def stats_vectors(stats: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """The model's view of the statistics: ``(by..., days_elapsed, csum)``."""
    return stats.select(*key_list(by), "days_elapsed", F.col("running_cumulative_sum").alias("csum"))


def fit_stats(stats: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Trend of the running total per key, with the first date of the series."""
    return fit_poisson(
        stats, "days_elapsed", "running_cumulative_sum", by, origin="date", one_row_per_x=True
    )


def fit_counts(
    counts: DataFrame, by: str | Sequence[str] | None = None, grain: str | Grain = "day"
) -> DataFrame:
    """The model of ``fit_stats`` on ``stats_from_counts``, without its dense rows.

    The running total stands still in a gap, so a day and the gap after it go to
    the fit as one run. For sparse keys that is a fraction of the rows. Keys run
    over their own days; for common bounds use ``fit_stats``. With a ``grain`` the
    predictor counts its periods.
    """
    keys, period = key_list(by), grain_of(grain)
    so_far = _so_far(keys)
    following = F.lead("date").over(Window.partitionBy(*keys).orderBy("date"))
    runs = counts.where(F.col("date").isNotNull()).select(
        *keys,
        "date",
        period.between(F.first("date").over(so_far), "date").alias("_x"),
        F.coalesce(period.between("date", following), F.lit(1)).alias("_run"),
        F.sum("daily_count").over(so_far).alias("_total"),
    )
    return fit_poisson(runs, "_x", "_total", by, origin="date", run="_run")
