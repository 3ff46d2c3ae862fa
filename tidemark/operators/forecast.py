"""Forecast rows and crossing dates from fitted coefficients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tidemark.functions.columns import as_column, bind, key_list
from tidemark.functions.dates import long_date
from tidemark.functions.grains import Grain, grain_of
from tidemark.operators.poisson import CALENDAR_DAYS, LAST_DATE

BLOCK_DAYS = 4096


def predict_response(intercept: Column | str, slope: Column | str, x: Column | str) -> Column:
    """Expected value at ``x``."""
    return F.exp(as_column(intercept) + as_column(slope) * as_column(x))


def forecast_range(
    model: DataFrame,
    target: Column | float,
    max_horizon: int | None = None,
    grain: str | Grain = "day",
) -> DataFrame:
    """Add ``_first_x``, ``_last_x`` and ``status`` to each model row.

    The first offset with a prediction of at least ``target`` is solved from the
    coefficients, not searched for. ``status`` is

    * ``already_past``: the offset after the last observed one is there already,
    * ``reached``: the target is met, within ``max_horizon`` offsets if given,
    * ``horizon``: it is met later, the forecast stops at the given horizon,
    * ``beyond_calendar``: it is met after the year 9999, there are no forecast rows,
    * ``no_crossing``: it is never met, there are no forecast rows.

    The calendar is counted from ``min_date``, in periods of ``grain``, where the model has it.
    """
    calendar = F.lit(CALENDAR_DAYS)
    if "min_date" in model.columns:
        end = grain_of(grain).start(F.lit(LAST_DATE).cast("date"))
        calendar = F.coalesce(grain_of(grain).between("min_date", end), calendar)
    last_day = F.floor("last_x").cast("bigint")  # forecasts are by whole days, whatever the predictor
    given = F.struct(
        as_column(target).cast("double").alias("goal"),
        last_day.alias("last_x"),
        (last_day + 1).alias("first_x"),
        *["intercept", "slope"],
        calendar.cast("bigint").alias("end"),
    )
    solved = bind(given, lambda m: bind(_crossing(m), lambda c: _limited(m, c, max_horizon)))
    model = model.withColumn("_solved", solved)
    rest = [c for c in model.columns if c != "_solved"]
    return model.select(*rest, (last_day + 1).alias("_first_x"), F.col("_solved.status").alias("status"), F.col("_solved.last").alias("_last_x"))


def _crossing(m: Column) -> Column:
    """The first offset that reaches the goal, null if none does, and if it is the first of all."""
    at = lambda x: F.exp(m["intercept"] + m["slope"] * x)
    past = (m["goal"] <= 0) | (at(m["first_x"]) >= m["goal"])
    # clamp before the cast to bigint, which fails on overflow
    exact_root = F.try_divide(F.ln(m["goal"]) - m["intercept"], m["slope"])
    limit = (F.greatest(m["end"], m["first_x"]) + 2).cast("double")
    root = F.greatest(F.ceil(F.least(exact_root, limit)).cast("bigint"), m["first_x"])

    def exact(r: Column) -> Column:
        # rounding can put the solved offset one day off either way
        before = (r > m["first_x"]) & (at(r - 1) >= m["goal"])
        return F.when(before, r - 1).when(at(r) < m["goal"], r + 1).otherwise(r)

    found = F.when(past, m["first_x"]).when(m["slope"] > 0, bind(root, exact))
    return F.struct(past.alias("past"), found.alias("x"))


def _limited(m: Column, c: Column, max_horizon: int | None) -> Column:
    """Status and last offset of the forecast to the crossing ``c``."""
    horizon = max_horizon or 0
    within = F.lit(True) if max_horizon is None else c["x"] - m["last_x"] <= max_horizon
    status = (
        F.when(c["x"].isNull(), "no_crossing")
        .when(within & (c["x"] > m["end"]), "beyond_calendar")
        .when(c["past"], "already_past")
        .when(within, "reached")
        .when(m["last_x"] + horizon > m["end"], "beyond_calendar")
        .otherwise("horizon")
    )
    cut = F.greatest(m["last_x"] + horizon, m["first_x"])

    def ended(s: Column) -> Column:
        last = F.when(s.isin("already_past", "reached"), c["x"]).when(s == "horizon", cut)
        return F.struct(s.alias("status"), last.alias("last"))

    return bind(status, ended)


def forecast_until(
    model: DataFrame,
    target: Column | float,
    by: str | Sequence[str] | None = None,
    max_horizon: int | None = None,
    keep: Sequence[str] = (),
    grain: str | Grain = "day",
) -> DataFrame:
    """Predictions after the last observed day, through the first to reach ``target``.

    ``(by..., days_elapsed, tagCount, status)`` plus the model columns in
    ``keep``. At least one row per key whose target is met; none for a key whose
    target is met never or after the calendar, as ``crossing_date`` tells. Only an
    explicit ``max_horizon`` cuts a series. ``target`` may be an expression on the
    model columns.
    """
    # a null last offset makes no rows
    rows = forecast_range(model, target, max_horizon, grain)
    # blocks of days first, so that no array is long
    block = F.explode(F.expr(f"sequence(_first_x, _last_x, {BLOCK_DAYS}L)"))
    rows = rows.withColumn("_block", block)
    steps = F.expr(f"sequence(_block, least(_block + {BLOCK_DAYS - 1}, _last_x))")
    rows = rows.withColumn("days_elapsed", F.explode(steps))
    predicted = predict_response("intercept", "slope", "days_elapsed")
    return rows.select(*key_list(by), *keep, "days_elapsed", predicted.alias("tagCount"), "status")


def crossing_date(
    model: DataFrame,
    target: Column | float,
    by: str | Sequence[str] | None = None,
    max_horizon: int | None = None,
    grain: str | Grain = "day",
) -> DataFrame:
    """``(by..., status, last_day, crossing_date, crossing_text)``, one row per key.

    Needs ``min_date`` in the model. Nothing is expanded: the day comes straight
    from the coefficients. Null unless the target is met.
    """
    met = "CASE WHEN status IN ('reached', 'already_past') THEN _last_x END"
    rows = forecast_range(model, target, max_horizon, grain).withColumn("last_day", F.expr(met))
    rows = rows.withColumn("crossing_date", grain_of(grain).add("min_date", "last_day"))
    text = long_date("crossing_date").alias("crossing_text")
    return rows.select(*key_list(by), "status", "last_day", "crossing_date", text)
