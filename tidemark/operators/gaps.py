"""Filling the days a sparse series lacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tidemark.functions.columns import key_list, same_keys
from tidemark.functions.grains import Grain, grain_of
from tidemark.functions.missing import zero_if_null
from tidemark.operators.counts import date_bounds

ZERO_COUNT: Mapping[str, object] = {"daily_count": 0}


def date_spine(
    bounds: DataFrame, by: str | Sequence[str] | None = None, grain: str | Grain = "day"
) -> DataFrame:
    """Every period from ``first_day`` to ``last_day`` of each bounds row."""
    days = grain_of(grain).series("first_day", "last_day")
    return bounds.select(*key_list(by), F.explode(days).alias("date"))


def join_spine(
    spine: DataFrame,
    counts: DataFrame,
    by: str | Sequence[str] | None = None,
    fill: Mapping[str, object] = ZERO_COUNT,
) -> DataFrame:
    """Left join of spine and counts on key and day, with defaults in the gaps.

    No broadcast hint: counts grow with keys and days, and Spark picks a
    broadcast by measured size. Undated counts match nothing; dropping them up
    front gives the counts the same plan as in ``date_bounds``.
    """
    keys = key_list(by)
    counts = counts.where(F.col("date").isNotNull())
    on = F.col("spine.date") == F.col("counts.date")
    if keys:
        on = on & same_keys("spine", "counts", keys)
    return (
        spine.alias("spine")
        .join(counts.alias("counts"), on, "left")
        .select(
            *[F.col(f"spine.{key}") for key in keys],
            F.col("spine.date"),
            *[zero_if_null(f"counts.{c}", value).alias(c) for c, value in fill.items()],
        )
    )


def expand_gaps(
    rows: DataFrame,
    keys: Sequence[str],
    bounds: DataFrame | None,
    carry: Mapping[str, Column],
    max_gap_days: int | None = None,
    grain: str | Grain = "day",
) -> DataFrame:
    """Repeat each dated row over the periods up to the next row of its key.

    Adds ``_day`` and the window columns of ``carry`` (evaluated on the sparse
    rows, in date order) to the input columns. With ``bounds`` (one row) a key
    also covers the days before its first and after its last row, and keeps
    ``_first_day``. One shuffle of the sparse rows and no join of the dense ones.
    """
    period = grain_of(grain)
    rows = rows.where(F.col("date").isNotNull())
    before_next = period.add("_next", -1)
    in_key = Window.partitionBy(*keys).orderBy("date")
    windows = {"_next": F.lead("date").over(in_key), **carry}
    if bounds is None:
        rows = rows.withColumns(windows)
        starts = F.col("date")
        ends = F.coalesce(before_next, "date")
    else:
        # bounds is a single aggregate row, so this broadcast cannot grow
        ends_of_all = F.broadcast(bounds.toDF("_first_day", "_last_day"))
        windows["_previous"] = F.lag("date").over(in_key)
        rows = rows.withColumns(windows).crossJoin(ends_of_all)
        starts = F.expr("CASE WHEN _previous IS NULL THEN least(_first_day, date) ELSE date END")
        ends = F.coalesce(before_next, "_last_day")
    # rows that share a period keep their own each; the last one fills the gap
    ends = F.greatest(ends, F.col("date"))
    if max_gap_days is not None:
        gap = period.between(starts, ends)
        message = F.format_string(f"gap of %d {period.name}s exceeds max_gap_days={max_gap_days}", gap)
        ends = F.when(gap > max_gap_days, F.raise_error(message).cast(rows.schema["date"].dataType)).otherwise(ends)
    return rows.withColumn("_day", F.explode(period.series(starts, ends)))


def global_bounds(
    counts: DataFrame, bounds: str, keys: Sequence[str], used: Sequence[str] = ("daily_count",)
) -> DataFrame | None:
    """The one row that ``expand_gaps`` wants for ``bounds``, or none."""
    if bounds not in ("per_key", "global"):
        raise ValueError(f"bounds must be per_key or global, not {bounds}")
    return date_bounds(counts, used=used) if bounds == "global" and keys else None


def densify(
    counts: DataFrame,
    by: str | Sequence[str] | None = None,
    fill: Mapping[str, object] = ZERO_COUNT,
    bounds: str = "per_key",
    max_gap_days: int | None = None,
    grain: str | Grain = "day",
) -> DataFrame:
    """Add the missing days, or periods of another ``grain``, of each key with default values.

    ``bounds`` is ``per_key`` (each key from its own first to its own last day)
    or ``global`` (every key over the days of all). Without keys both mean the
    same. ``counts`` has few rows per key and day; aggregate events with
    ``daily_counts`` first, so that a key never exceeds one row per day.
    ``max_gap_days`` makes a longer gap, in periods, fail the job instead of exploding.
    Dates are starts of periods, as ``daily_counts`` of that grain gives them.
    """
    keys = key_list(by)
    dated = counts.select(*keys, "date", *fill).where(F.col("date").isNotNull())
    row = global_bounds(dated, bounds, keys, list(fill))
    rows = expand_gaps(dated, keys, row, {}, max_gap_days, grain)
    return rows.select(
        *keys,
        F.col("_day").alias("date"),
        *[
            F.when(F.col("_day") == F.col("date"), zero_if_null(c, value))
            .otherwise(F.lit(value))
            .alias(c)
            for c, value in fill.items()
        ],
    )
