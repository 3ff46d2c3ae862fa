"""Poisson regression with log link on one predictor, for one series or many."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tidemark.functions.columns import key_list, same_keys
from tidemark.staging import written

# Python workers get the functions of this module by value, so that executors need
# no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Days in the years 1 to 9999, the range of a date.
CALENDAR_DAYS = 3_652_059
LAST_DATE = "9999-12-31"
MAX_STEPS = 25
MAX_HALVINGS = 30
MAX_ROUNDS = 60  # of the keyed distributed fit, tried steps and halvings together
STEP_TOLERANCE = 1e-8  # convergence is quadratic, so the error left is far smaller
CHUNK_POINTS = 1 << 18
SALTS = 16  # parts that the points of a key are joined in

COEFFICIENTS = T.StructType(
    [T.StructField("intercept", T.DoubleType()), T.StructField("slope", T.DoubleType())]
)


def newton_fit(
    x: np.ndarray, weight: np.ndarray, total: np.ndarray, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Fit many series laid end to end; ``starts`` holds the first index of each.

    ``weight`` rows at ``x`` have values summing to ``total``, which is all the
    likelihood needs. Scoring steps run on all series at once and are halved
    wherever the likelihood would fall. No series may be empty.
    """
    if (total < 0).any():
        raise ValueError("Poisson regression needs values >= 0")
    sizes = np.diff(np.append(starts, len(x)))
    per_series = lambda values: np.add.reduceat(values, starts)
    spread = lambda values: np.repeat(values, sizes)

    # centre and scale the predictor so the normal equations stay well conditioned
    centre = per_series(weight * x) / per_series(weight)
    z = x - spread(centre)
    scale = np.maximum.reduceat(np.abs(z), starts)
    z = z / spread(np.where(scale == 0, 1.0, scale))
    # one offset or one value: the slope is zero, not a rounding error near it
    mean = total / weight
    flat = (scale == 0) | (np.maximum.reduceat(mean, starts) == np.minimum.reduceat(mean, starts))

    def evaluate(c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eta = spread(c0) + spread(c1) * z
        with np.errstate(over="ignore", invalid="ignore"):
            mu = weight * np.exp(eta)
            return mu, per_series(total * eta - mu)

    # first guess: least squares on the log values, weighted by the values
    raised = mean + 0.1
    b0, b1 = _solve(per_series, weight * raised, z, weight * raised * np.log(raised))
    mu, current = evaluate(b0, b1)
    for _ in range(MAX_STEPS):
        d0, d1 = _solve(per_series, mu, z, total - mu)
        size = np.ones_like(d0)
        for _ in range(MAX_HALVINGS):
            mu, trial = evaluate(b0 + size * d0, b1 + size * d1)
            worse = ~(trial >= current - 1e-9 * np.abs(current))
            if not worse.any():
                break
            size = np.where(worse, size / 2, size)
        b0, b1, current = b0 + size * d0, b1 + size * d1, trial
        if max(np.abs(d0).max(), np.abs(d1).max()) < STEP_TOLERANCE:
            break

    with np.errstate(divide="ignore"):
        level = np.log(per_series(total) / per_series(weight))
    slope = np.where(flat, 0.0, b1 / np.where(flat, 1.0, scale))
    intercept = np.where(flat, level, b0 - slope * centre)
    empty = per_series(total) == 0  # the optimum is at minus infinity
    return np.where(empty, np.nan, intercept), np.where(empty, np.nan, slope)


def _solve(per_series, weight, z, score):
    """Solve the 2x2 weighted normal equations of every series."""
    s0, s1, s2 = per_series(weight), per_series(weight * z), per_series(weight * z * z)
    g0, g1 = per_series(score), per_series(score * z)
    det = s0 * s2 - s1 * s1
    singular = det <= 1e-12 * s0 * s2
    safe = np.where(singular, 1.0, det)
    with np.errstate(divide="ignore", invalid="ignore"):
        level = np.where(s0 > 0, g0 / s0, 0.0)
    first = np.where(singular, level, (s2 * g0 - s1 * g1) / safe)
    return first, np.where(singular, 0.0, (s0 * g1 - s1 * g0) / safe)


@F.arrow_udf(COEFFICIENTS)
def _fit_batch(points: pa.Array) -> pa.Array:
    """Fit each list of points of the batch.

    A point has ``x`` and ``total``; with ``weight`` it stands for that many rows
    at ``x``, with ``run`` for one row at each of that many offsets from ``x`` on.
    """
    flat = points.flatten()
    names = {flat.type.field(i).name for i in range(flat.type.num_fields)}
    column = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
    x, total = column("x").astype(float), column("total").astype(float)
    weight = column("weight").astype(float) if "weight" in names else np.ones_like(x)
    run = column("run") if "run" in names else np.ones(len(x), dtype=np.int64)

    lengths = np.diff(points.offsets.to_numpy())
    starts = (np.cumsum(lengths) - lengths).astype(np.int64)
    rows_to = np.cumsum(run)
    ends = rows_to[starts + lengths - 1]  # points laid out up to each series' end
    # whole series by the chunk, which bounds memory and keeps arrays in cache
    edges = np.flatnonzero(np.diff(ends // CHUNK_POINTS)) + 1
    fits = []
    for part in np.split(np.arange(len(lengths)), edges):
        rows = slice(starts[part[0]], starts[part[-1]] + lengths[part[-1]])
        repeat = run[rows]
        first = np.cumsum(repeat) - repeat
        step = np.arange(repeat.sum()) - np.repeat(first, repeat)
        begin = first[starts[part] - rows.start]
        columns = [np.repeat(values[rows], repeat) for values in (x, weight, total)]
        fits.append(newton_fit(columns[0] + step, *columns[1:], begin))
    intercept, slope = (np.concatenate(values) for values in zip(*fits, strict=True))
    missing = np.isnan(intercept)
    return pa.StructArray.from_arrays(
        [pa.array(intercept, mask=missing), pa.array(slope, mask=missing)], ["intercept", "slope"]
    )


# Filters on the coefficients would else be pushed below the fit with a second fit of their own.
_fit_once = _fit_batch.asNondeterministic()


def fit_poisson(
    series: DataFrame,
    x: str = "days_elapsed",
    y: str = "running_cumulative_sum",
    by: str | Sequence[str] | None = None,
    origin: str | None = None,
    one_row_per_x: bool = False,
    run: str | None = None,
) -> DataFrame:
    """Fit ``y ~ x`` per key: ``(by..., intercept, slope, n_points, last_x, last_y)``.

    With ``origin``, a date column, also its minimum as ``min_date``.

    ``x`` is a day offset. Unless ``one_row_per_x`` says that a key has each
    offset once, rows are first reduced to a count and a sum per key and offset,
    which leaves the estimate unchanged and bounds a key by the days of the
    calendar, however many rows it has. ``run`` names a column of how many
    offsets, from ``x`` on, a row stands for; it implies ``one_row_per_x``. Many
    keys share one Arrow batch and are fitted together. Keys without a usable
    row are absent; a key whose values are all zero has null coefficients.
    """
    keys = key_list(by)
    if not isinstance(series.schema[x].dataType, T.IntegralType):
        raise TypeError(f"{x} must hold whole days; use fit_poisson_distributed for other predictors")
    limit = F.raise_error(f"{x} is not a day offset: scale it to one per key first").cast("bigint")
    offset = F.when(F.abs(x) <= CALENDAR_DAYS, F.col(x)).otherwise(limit).cast("bigint")
    points = series.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys,
        offset.alias("_x"),
        F.col(y).alias("_total"),
        (F.col(run) if run else F.lit(1)).cast("bigint").alias("_run"),
        F.lit(1).cast("bigint").alias("_weight"),
        (F.col(origin) if origin else F.lit(None).cast("date")).alias("_date"),
    )
    if not run and not one_row_per_x:
        points = points.groupBy(*keys, "_x", "_run").agg(
            F.sum("_total").alias("_total"), F.sum("_weight").alias("_weight"), F.min("_date").alias("_date")
        )
    # only what varies goes to Python; a list is sorted by offset, so that rounding
    # does not depend on the order rows arrive in
    names = ["x", "run", "total"] if run else ["x", "total"] if one_row_per_x else ["x", "weight", "total"]
    point = F.struct(*[F.col(f"_{n}").cast("double" if n == "total" else "bigint").alias(n) for n in names])
    vectors = points.groupBy(*keys).agg(
        F.sort_array(F.collect_list(point)).alias("_points"),
        F.expr("sum(_weight * _run)").alias("n_points"),
        F.expr("max(_x + _run - 1)").alias("last_x"),
        F.expr("max_by(_total / CAST(_weight AS DOUBLE), _x)").alias("last_y"),
        F.min("_date").alias("min_date"),
    )
    fitted = vectors.where(F.size("_points") > 0).withColumn("_fit", _fit_once("_points"))
    kept = ["n_points", "last_x", "last_y", *(["min_date"] if origin else [])]
    return fitted.select(*keys, "_fit.intercept", "_fit.slope", *kept)


def fit_poisson_distributed(
    series: DataFrame,
    x: str = "days_elapsed",
    y: str = "running_cumulative_sum",
    origin: str | None = None,
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """The model rows of ``fit_poisson`` for series that no task could hold, eagerly.

    For predictors with more distinct values than a calendar has days, of any type.
    Rows that share a predictor value are first reduced to their count and mean.
    Without keys, Spark ML fits the one series, a job per iteration; two numbers
    return to the driver, and the rest of the row is a lazy aggregate. With ``by``,
    all keys are fitted together, see ``fit_keys_distributed``. ``last_x`` is a whole
    number if ``x`` is, and else a double.
    """
    whole = isinstance(series.schema[x].dataType, T.IntegralType)
    rows = series.select(
        *key_list(by),
        F.col(x).cast("double").alias("_x"),
        F.col(y).cast("double").alias("_y"),
        (F.col(origin) if origin else F.lit(None).cast("date")).alias("_date"),
    ).dropna(subset=["_x", "_y"])
    last_x = F.max("_x").cast("bigint" if whole else "double").alias("last_x")
    first_date = [F.min("_date").alias("min_date")] if origin else []
    if by is not None and key_list(by):
        return fit_keys_distributed(rows, key_list(by), last_x, first_date)
    points = rows.groupBy("_x").agg(
        F.avg("_y").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"), F.min("_date").alias("_date")
    )
    features = VectorAssembler(inputCols=["_x"], outputCol="features").transform(points)
    regression = GeneralizedLinearRegression(
        family="poisson", link="log", maxIter=MAX_STEPS, tol=1e-10, weightCol="weight"
    )
    model = regression.fit(features)
    return points.agg(
        F.lit(float(model.intercept)).alias("intercept"),
        F.lit(float(model.coefficients[0])).alias("slope"),
        F.sum("weight").cast("bigint").alias("n_points"),
        last_x,
        F.max_by("label", "_x").alias("last_y"),
        *first_date,
    )


def fit_keys_distributed(
    rows: DataFrame, keys: Sequence[str], last_x: Column, first_date: Sequence[Column]
) -> DataFrame:
    """Newton scoring for all keys at once, as rounds of grouped sums.

    A round joins the points of unfinished keys with their trial coefficients and adds
    up the likelihood and its derivatives, all that a step needs: six numbers per key.
    A step is halved where the likelihood would fall, and a key leaves once its step is
    negligible. Keys converge apart from each other, so later rounds read fewer points
    and keys. Sums start before the shuffle, and the points of a key are joined in
    ``SALTS`` parts, so a hot key is not one task's. Points and each round's
    coefficients are written to the shared folder, which cuts the lineage; only the
    number of unfinished keys comes to the driver.
    """
    negative = F.raise_error("Poisson regression needs values >= 0").cast("double")
    value = F.when(F.col("_y") >= 0, F.col("_y")).otherwise(negative)
    points = rows.groupBy(*keys, "_x").agg(
        F.sum(value).alias("_total"), F.count(F.lit(1)).cast("double").alias("_weight"), F.min("_date").alias("_date")
    )
    points = written(points.withColumn("_salt", F.pmod(F.xxhash64("_x"), F.lit(SALTS))), "points")

    # centre and scale the predictor, as newton_fit does; a flat series needs no rounds
    mean = F.col("_total") / F.col("_weight")
    state = points.groupBy(*keys).agg(
        F.sum("_weight").cast("bigint").alias("n_points"),
        last_x,
        F.max_by(mean, "_x").alias("last_y"),
        *first_date,
        F.expr("sum(_weight * _x) / sum(_weight)").alias("_centre"),
        F.expr("ln(nullif(sum(_total), 0D) / sum(_weight))").alias("_level"),
        F.min("_x").alias("_low"),
        F.max("_x").alias("_high"),
        (F.min(mean) == F.max(mean)).alias("_level_only"),
    )
    state = state.withColumn("_scale", F.expr("greatest(_high - _centre, _centre - _low)"))
    state = state.withColumn("_done", F.expr("_level_only OR _scale = 0")).drop("_low", "_high", "_level_only")
    # coefficients, the step being tried and its size, and the likelihood to beat
    start = {
        "_b0": F.expr("CASE WHEN _done THEN _level ELSE 0D END"),
        "_b1": F.expr("CASE WHEN NOT _done OR _level IS NOT NULL THEN 0D END"),
        **{"_d0": F.lit(0.0), "_d1": F.lit(0.0), "_size": F.lit(1.0), "_best": F.lit(float("-inf"))},
    }
    state = written(state.withColumns(start), "state")
    for attempt in range(MAX_ROUNDS):
        active = state.where("NOT _done")
        if not active.count():
            break
        moved = _guess(points, active, keys) if attempt == 0 else _newton_round(points, active, keys)
        state = written(state.where("_done").unionByName(moved), "state")
    slope = F.expr("CASE WHEN _scale = 0 THEN _b1 ELSE _b1 / _scale END")
    kept = ["n_points", "last_x", "last_y", *(["min_date"] if first_date else [])]
    return state.withColumn("slope", slope).select(
        *keys, F.expr("_b0 - slope * _centre").alias("intercept"), "slope", *kept
    )


def _at_points(points: DataFrame, active: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The points of active keys with ``_z``, the scaled predictor, and ``columns`` of the key."""
    salts = F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("_salt")
    salted = active.select(*keys, "_centre", "_scale", *columns, salts)
    rows = points.alias("points").join(salted.alias("active"), same_keys("points", "active", [*keys, "_salt"]))
    return rows.select(
        *[F.col(f"points.{key}") for key in keys],
        *["_total", "_weight"],
        F.expr("(_x - _centre) / _scale").alias("_z"),
        *columns,
    )


# Solution of the weighted normal equations of the sums _s0, _s1, _s2 and _g0, _g1, as in ``_solve``.
_SINGULAR = "(_s0 * _s2 - _s1 * _s1 <= 1e-12 * _s0 * _s2)"
_STEP_0 = f"CASE WHEN {_SINGULAR} THEN coalesce(try_divide(_g0, _s0), 0D) ELSE (_s2 * _g0 - _s1 * _g1) / (_s0 * _s2 - _s1 * _s1) END"
_STEP_1 = f"CASE WHEN {_SINGULAR} THEN 0D ELSE (_s0 * _g1 - _s1 * _g0) / (_s0 * _s2 - _s1 * _s1) END"


def _summed(rows: DataFrame, keys: Sequence[str], **sums: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.expr(f"sum({e})").alias(name) for name, e in sums.items()])


def _with_sums(active: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = active.alias("key").join(sums.alias("sums"), same_keys("key", "sums", keys))
    rest = [c for c in sums.columns if c not in keys]
    return joined.select(*[F.col(f"key.{c}") for c in active.columns], *rest)


def _guess(points: DataFrame, active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First step, from zero: least squares on the log values, weighted by the values."""
    rows = _at_points(points, active, keys, [])
    rows = rows.withColumn("_w", F.expr("_total + 0.1D * _weight")).withColumn("_log", F.expr("ln(_w / _weight)"))
    sums = _summed(rows, keys, _s0="_w", _s1="_w * _z", _s2="_w * _z * _z", _g0="_w * _log", _g1="_w * _log * _z")
    return _with_sums(active, sums, keys).withColumns({"_d0": F.expr(_STEP_0), "_d1": F.expr(_STEP_1)}).select(active.columns)


def _newton_round(points: DataFrame, active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Try every key's step: take it and find the next one, or halve it."""
    tried = active.withColumns({"_t0": F.expr("_b0 + _size * _d0"), "_t1": F.expr("_b1 + _size * _d1")})
    rows = _at_points(points, tried, keys, ["_t0", "_t1"])
    rows = rows.withColumn("_eta", F.expr("_t0 + _t1 * _z")).withColumn("_mu", F.expr("_weight * exp(_eta)"))
    sums = _summed(
        rows,
        keys,
        _like="_total * _eta - _mu",
        _s0="_mu",
        _s1="_mu * _z",
        _s2="_mu * _z * _z",
        _g0="_total - _mu",
        _g1="(_total - _mu) * _z",
    )
    out = _with_sums(tried, sums, keys)
    better = "NOT isnan(_like) AND _like > double('-infinity') AND _like >= _best - 1e-9 * coalesce(nullif(abs(_best), double('infinity')), 0D)"
    out = out.withColumn("_better", F.expr(better))
    out = out.withColumns({"_n0": F.expr(f"CASE WHEN _better THEN {_STEP_0} END"), "_n1": F.expr(f"CASE WHEN _better THEN {_STEP_1} END")})
    # convergence is quadratic: once the next step is negligible it is taken unseen
    out = out.withColumn("_last", F.expr(f"_better AND greatest(abs(_n0), abs(_n1)) < {STEP_TOLERANCE}"))
    lost = f"NOT _better AND _size < pow(2, -{MAX_HALVINGS})"
    moved = {
        "_b0": F.expr("CASE WHEN _last THEN _t0 + _n0 WHEN _better THEN _t0 ELSE _b0 END"),
        "_b1": F.expr("CASE WHEN _last THEN _t1 + _n1 WHEN _better THEN _t1 ELSE _b1 END"),
        "_d0": F.coalesce("_n0", "_d0"),
        "_d1": F.coalesce("_n1", "_d1"),
        "_size": F.expr("CASE WHEN _better THEN 1D ELSE _size / 2 END"),
        "_best": F.expr("CASE WHEN _better THEN _like ELSE _best END"),
        "_done": F.expr(f"_last OR ({lost})"),
    }
    return out.withColumns(moved).select(active.columns)


def predict_vectors(
    csum: np.ndarray, days_elapsed: np.ndarray, target_csum: float, last_day: int = CALENDAR_DAYS
) -> dict:
    """Vector function for ``apply_series``: fit, then predict day by day.

    Returns the days after the last one up to and including the first whose
    prediction reaches the target; none if the fit gets there never, or after
    ``last_day``. With the days from the first date to the calendar's last one there,
    these are the days of ``forecast_until``.
    """
    x, y = days_elapsed.astype(float), csum.astype(float)
    b0, b1 = (float(c[0]) for c in newton_fit(x, np.ones_like(x), y, np.array([0])))
    first = x.max() + 1
    if target_csum <= 0 or np.exp(b0 + b1 * first) >= target_csum:
        last = first
    elif b1 > 0:
        last = max(first, np.ceil((np.log(target_csum) - b0) / b1))
        # rounding can put the solved day one off either way
        if last > first and np.exp(b0 + b1 * (last - 1)) >= target_csum:
            last -= 1
        elif np.exp(b0 + b1 * last) < target_csum:
            last += 1
    else:
        last = first - 1
    if last > last_day:
        last = first - 1
    days = np.arange(first, last + 1)
    predicted = np.exp(b0 + b1 * days)
    return {"days_elapsed": days.astype("int64"), "tagCount": predicted}
