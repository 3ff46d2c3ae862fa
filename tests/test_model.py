import datetime as dt
import math
import subprocess
import sys

import numpy as np
import pytest
from conftest import tuples
from pyspark import cloudpickle
from pyspark.sql import functions as F

import tidemark as tm
from tidemark.operators.poisson import newton_fit

D = dt.date


def brute_fit(x, y):
    """Plain Newton from a flat start with halved steps, one series."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    beta = np.array([math.log(y.mean()), 0.0])
    design = np.column_stack([np.ones_like(x), x])
    value = lambda b: float((y * (design @ b) - np.exp(np.minimum(design @ b, 700))).sum())
    for _ in range(200):
        mu = np.exp(design @ beta)
        step = np.linalg.lstsq(design.T @ (design * mu[:, None]), design.T @ (y - mu), rcond=None)[0]
        while value(beta + step) < value(beta) - 1e-9 and np.abs(step).max() > 1e-15:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-13:
            break
    return beta


def points(spark, xs, ys):
    return spark.createDataFrame(list(zip(xs, ys, strict=True)), "x bigint, y double")


def coefficients(model):
    row = model.first()
    return row.intercept, row.slope


def model_row(spark, intercept, slope, last_x=5):
    return spark.createDataFrame(
        [(intercept, slope, last_x, D(2023, 1, 1))], "intercept double, slope double, last_x bigint, min_date date"
    )


def test_toy_fit_by_every_route(toy):
    counts = tm.daily_counts(toy, "created_at")
    stats = tm.stats_from_counts(counts)
    routes = [
        tm.fit_counts(counts),
        tm.fit_stats(stats),
        tm.fit_poisson(stats),
        tm.fit_poisson_distributed(stats),
    ]
    for model in routes:
        assert coefficients(model) == pytest.approx((0.617979, 0.174629), abs=1e-6)
    assert tuple(routes[0].select("n_points", "last_x", "last_y", "min_date").first()) == (6, 5, 5.0, D(2023, 1, 1))
    assert routes[0].select("n_points", "last_x", "last_y", "min_date").first() == routes[1].select(
        "n_points", "last_x", "last_y", "min_date"
    ).first()


def test_toy_forecast(toy):
    model = tm.fit_counts(tm.daily_counts(toy, "created_at"))
    rows = tm.predicted_series(model, 10).orderBy("day").collect()
    assert [r.day for r in rows] == [D(2023, 1, d) for d in range(7, 12)]
    assert [r.tagCount for r in rows] == pytest.approx(
        [5.289651, 6.298939, 7.500804, 8.931989, 10.636251], abs=1e-6
    )
    assert {r.valueType for r in rows} == {"Predicted"}
    assert tuple(tm.crossing_date(model, 10).first()) == ("reached", 10, D(2023, 1, 11), "Wed Jan 11 2023")
    assert tuples(tm.forecast_until(model, 4).select("days_elapsed", "status")) == [(6, "already_past")]


@pytest.mark.parametrize("seed", range(4))
def test_fit_matches_brute_force(seed):
    rng = np.random.default_rng(seed)
    xs, ys, starts = [], [], []
    for length in rng.integers(2, 80, size=30):
        starts.append(sum(len(x) for x in xs))
        xs.append(np.sort(rng.choice(500, size=length, replace=False)).astype(float))
        ys.append(np.cumsum(rng.poisson(2, size=length)).astype(float) + 1)
    ones = np.ones(sum(len(x) for x in xs))
    b0, b1 = newton_fit(np.concatenate(xs), ones, np.concatenate(ys), np.array(starts))
    for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
        assert (b0[i], b1[i]) == pytest.approx(brute_fit(x, y), rel=1e-7, abs=1e-7)


def test_steep_and_shifted_series():
    x = np.arange(30.0)
    for shift, slope in ((0, 0.9), (0, -0.7), (3_000_000, 0.02)):
        y = np.round(np.exp(1 + slope * x)) if slope > 0 else np.round(np.exp(20 + slope * x))
        b0, b1 = newton_fit(x + shift, np.ones_like(x), y, np.array([0]))
        mu = np.exp(b0[0] + b1[0] * (x + shift))
        assert abs((y - mu).sum()) < 1e-5 * y.sum()
        assert abs(((y - mu) * x).sum()) < 1e-5 * (y * x).sum()


def test_degenerate_series(spark):
    one_day = points(spark, [0], [5.0])
    assert coefficients(tm.fit_poisson(one_day, "x", "y")) == pytest.approx((math.log(5), 0))
    constant = points(spark, [0, 1, 2], [3.0, 3.0, 3.0])
    model = tm.fit_poisson(constant, "x", "y")
    assert coefficients(model) == (pytest.approx(math.log(3)), 0)
    assert tuples(tm.forecast_until(model, 10)) == []
    zeros = points(spark, [0, 1], [0.0, 0.0])
    assert coefficients(tm.fit_poisson(zeros, "x", "y")) == (None, None)
    with pytest.raises(Exception, match=">= 0"):
        tm.fit_poisson(points(spark, [0, 1], [1.0, -1.0]), "x", "y").collect()


def test_repeated_rows_are_weights(spark):
    xs, ys = [0, 0, 0, 1, 2, 2], [1.0, 2.0, 3.0, 2.0, 5.0, 9.0]
    df = points(spark, xs, ys)
    model = tm.fit_poisson(df.repartition(3), "x", "y")
    assert coefficients(model) == pytest.approx(tuple(brute_fit(xs, ys)), abs=1e-9)
    assert coefficients(model) == pytest.approx(coefficients(tm.fit_poisson_distributed(df, "x", "y")), abs=1e-7)
    assert model.first().n_points == 6


def test_predictor_must_be_a_day_offset(spark):
    with pytest.raises(TypeError, match="whole days"):
        tm.fit_poisson(points(spark, [1], [1.0]).withColumn("x", F.lit(0.5)), "x", "y")
    with pytest.raises(Exception, match="not a day offset"):
        tm.fit_poisson(points(spark, [10**9], [1.0]), "x", "y").collect()


def test_keyed_fit_is_the_fit_of_each_key(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key in range(40):
        days = rng.integers(0, 90, size=rng.integers(1, 60))
        rows += [(key, D(2023, 1, 1) + dt.timedelta(int(day))) for day in days]
    df = spark.createDataFrame(rows, "key int, at date").repartition(6)
    counts = tm.daily_counts(df, "at", "key")
    stats = tm.stats_from_counts(counts, "key")
    series = {}
    for row in stats.orderBy("key", "date").collect():
        series.setdefault(row.key, []).append((row.days_elapsed, row.running_cumulative_sum))
    for model in (tm.fit_counts(counts, "key"), tm.fit_stats(stats, "key"), tm.fit_poisson(stats, by="key")):
        fitted = {row.key: row for row in model.collect()}
        assert set(fitted) == set(series)
        for key, values in series.items():
            x, y = zip(*values, strict=True)
            assert fitted[key].n_points == len(values)
            assert (fitted[key].intercept, fitted[key].slope) == pytest.approx(
                tuple(brute_fit(x, y)) if len(values) > 1 else (math.log(y[0]), 0), rel=1e-7, abs=1e-8
            )


def test_chunks_do_not_change_the_fit(spark, monkeypatch):
    import tidemark.operators.poisson as poisson

    import pyarrow as pa

    lists = [[{"x": i, "run": 1 + i % 3, "total": float(1 + i + k)} for i in range(0, 9 + k, 3)] for k in range(20)]
    column = pa.array(lists, pa.list_(pa.struct([("x", pa.int64()), ("run", pa.int64()), ("total", pa.float64())])))
    whole = poisson._fit_batch.func(column).to_pylist()
    monkeypatch.setattr(poisson, "CHUNK_POINTS", 7)
    chunked = poisson._fit_batch.func(column).to_pylist()
    sliced = poisson._fit_batch.func(column.slice(5, 4)).to_pylist()
    values = lambda records: np.array([tuple(r.values()) for r in records])
    assert np.allclose(values(chunked), values(whole), rtol=1e-9)
    assert np.allclose(values(sliced), values(whole[5:9]), rtol=1e-9)


def test_workers_need_no_copy_of_the_package(tmp_path):
    import tidemark.operators.poisson as poisson

    payload = tmp_path / "functions"
    payload.write_bytes(cloudpickle.dumps((poisson._fit_batch.func, tm.predict_vectors)))
    script = f"""
import sys, numpy as np, pyarrow as pa
from pyspark import cloudpickle
fit, predict = cloudpickle.loads(open({str(payload)!r}, "rb").read())
point = pa.struct([("x", pa.int64()), ("total", pa.float64())])
print(fit(pa.array([[{{"x": 0, "total": 1.0}}, {{"x": 1, "total": 2.0}}]], pa.list_(point))).to_pylist())
print(len(predict(np.array([1, 2]), np.array([0, 1]), 7.0)["tagCount"]))
assert "tidemark" not in sys.modules
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split("\n")[1] == "2"


def test_forecast_statuses(spark):
    rising = model_row(spark, 0.0, 0.1)
    rows = tm.forecast_until(rising, 3.0).orderBy("days_elapsed").collect()
    assert [r.days_elapsed for r in rows] == list(range(6, 12))
    assert sum(r.tagCount >= 3 for r in rows) == 1 and rows[-1].tagCount >= 3
    assert {r.status for r in rows} == {"reached"}
    capped = tm.forecast_until(rising, 3.0, max_horizon=2).orderBy("days_elapsed").collect()
    assert [(r.days_elapsed, r.status) for r in capped] == [(6, "horizon"), (7, "horizon")]
    assert tuple(tm.crossing_date(rising, 3.0, max_horizon=2).first()) == ("horizon", None, None, None)
    falling = model_row(spark, 0.0, -0.1)
    assert tuples(tm.forecast_until(falling, 3.0)) == []
    assert tm.crossing_date(falling, 3.0).first().status == "no_crossing"
    assert tm.forecast_until(falling, 0.1).first().status == "already_past"
    for target in (0.0, -5.0):
        assert tuples(tm.forecast_until(rising, target).select("days_elapsed", "status")) == [(6, "already_past")]
    nearly_flat = model_row(spark, 0.0, 1e-300)
    assert tm.crossing_date(nearly_flat, 1e300).first().status == "beyond_calendar"
    assert tuples(tm.forecast_until(nearly_flat, 1e300)) == []
    unknown = model_row(spark, None, None)
    assert tm.crossing_date(unknown, 3.0).first().status == "no_crossing"


def test_no_partial_series_and_no_year_beyond_9999(spark):
    slow = model_row(spark, 0.0, 1e-7)
    dated = slow.withColumn("min_date", F.lit("2023-01-01").cast("date"))
    for model in (slow, dated):
        assert tuples(tm.forecast_until(model, 10.0)) == []
        assert tm.crossing_date(dated, 10.0).first().status == "beyond_calendar"
    assert tuples(tm.predicted_series(dated, 10.0)) == []
    # the last day of the calendar is still reached
    days = (dt.date(9999, 12, 31) - dt.date(2023, 1, 1)).days
    edge = tm.predicted_series(dated, float(np.exp(1e-7 * days)) * (1 - 1e-13))
    assert edge.agg(F.max("day")).first()[0] == dt.date(9999, 12, 31)
    cut = tm.predicted_series(dated, 10.0, max_horizon=3)
    assert [r.status for r in cut.collect()] == ["horizon"] * 3


def test_vector_function_ends_where_the_forecast_ends(spark):
    rng = np.random.default_rng(3)
    wrong = 0
    for _ in range(600):
        x = np.arange(int(rng.integers(5, 40)), dtype=float)
        y = np.cumsum(rng.poisson(rng.uniform(1, 9), len(x))) + 1.0
        fit = tm.predict_vectors(y, x, 0.0)
        b0, b1 = (float(c[0]) for c in newton_fit(x, np.ones_like(x), y, np.array([0])))
        day = x.max() + int(rng.integers(1, 200))
        target = float(np.exp(b0 + b1 * day))
        out = tm.predict_vectors(y, x, target)
        wrong += not (out["tagCount"][-1] >= target and (out["tagCount"][:-1] < target).all())
        assert len(fit["days_elapsed"]) == 1
    assert wrong == 0
    flat = tm.predict_vectors(np.array([5.0, 5.0, 5.0]), np.arange(3), 10.0)
    assert len(flat["days_elapsed"]) == 0


def test_distributed_fit_gives_a_model_row(spark, toy):
    stats = tm.stats_from_counts(tm.daily_counts(toy, "created_at"))
    one = tm.fit_stats(stats).first().asDict()
    other = tm.fit_poisson_distributed(stats, origin="date").first().asDict()
    assert other.pop("min_date") == one.pop("min_date")
    assert other == pytest.approx(one, abs=1e-6)


def test_first_day_at_the_target_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        b0, b1, step = rng.uniform(0, 3), rng.uniform(0.001, 0.2), int(rng.integers(10, 60))
        rows.append((float(b0), float(b1), 5, float(np.exp(b0 + b1 * step))))
    model = spark.createDataFrame(rows, "intercept double, slope double, last_x bigint, goal_in double")
    ends = (
        tm.forecast_until(model, F.col("goal_in"), keep=["intercept", "slope", "goal_in"])
        .groupBy("intercept", "slope", "goal_in")
        .agg(F.max("days_elapsed").alias("last"), F.count_if(F.col("tagCount") >= F.col("goal_in")).alias("met"))
        .collect()
    )
    assert len(ends) == 400
    assert {row.met for row in ends} == {1}


def test_apply_series(spark):
    rows = [("a", 2, 1.0), ("a", 1, 3.0), ("b", 1, float("nan")), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "key string, t int, v double")

    def running(values, factor):
        return {"i": range(len(values)), "total": np.cumsum(values) * factor}

    out = tm.apply_series(df, running, ["v"], "i bigint, total double", "key", "t", factor=10)
    assert sorted(tuples(out), key=str) == sorted(
        [("a", 0, 30.0), ("a", 1, 40.0), ("b", 0, None), (None, 0, 20.0)], key=str
    )
    whole = tm.apply_series(df.where("key = 'a'"), running, ["v"], "i bigint, total double", order="t", factor=1)
    assert sorted(tuples(whole)) == [(0, 3.0), (1, 4.0)]


def test_vector_function_equals_the_forecast(spark, toy):
    counts = tm.daily_counts(toy, "created_at")
    vectors = tm.stats_vectors(tm.stats_from_counts(counts))
    schema = "days_elapsed bigint, tagCount double"
    for target in (10.0, 4.0):
        udf = tm.apply_series(
            vectors, tm.predict_vectors, ["csum", "days_elapsed"], schema, order="days_elapsed", target_csum=target
        )
        built_in = tm.forecast_until(tm.fit_counts(counts), target).drop("status")
        for left, right in zip(sorted(tuples(udf)), sorted(tuples(built_in)), strict=True):
            assert left == pytest.approx(right)


def test_null_if_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert [r.v for r in df.select(tm.null_if_missing("v").alias("v")).collect()] == [1.0, None, None]


def test_combined_series(toy):
    counts = tm.daily_counts(toy, "created_at")
    rows = tm.combined_series(tm.stats_from_counts(counts), tm.fit_counts(counts), 10).orderBy("day").collect()
    assert [r.valueType for r in rows] == ["Actual Count"] * 6 + ["Predicted"] * 5
    assert [r.tagCount for r in rows[:6]] == [2, 2, 3, 3, 3, 5]


def keyed_points(spark, seed):
    """Rising, falling, steep, flat, zero, single-point and null-key series; one key holds most rows."""
    rng = np.random.default_rng(seed)
    rows = []
    shapes = {"rise": 0.02, "fall": -0.05, "steep": 0.9, None: 0.01}
    for key, slope in shapes.items():
        for x in range(40):
            rows += [(key, x, float(rng.poisson(np.exp(1 + slope * x)))) for _ in range(2)]
    rows += [("hot", int(x), float(y)) for x, y in zip(rng.integers(0, 3000, 4000), rng.poisson(50, 4000), strict=True)]
    rows += [("flat", x, 7.0) for x in range(5)] + [("zero", x, 0.0) for x in range(5)]
    rows += [("one", 3, 11.0), ("mixed", 1, 0.0), ("mixed", 2, 5.0), ("mixed", 4, 0.0), ("lost", None, 1.0), ("rise", 4, None)]
    return spark.createDataFrame(rows, "key string, x bigint, y double")


@pytest.mark.parametrize("seed", range(2))
def test_keyed_distributed_fit_equals_the_grouped_one(spark, seed):
    df = keyed_points(spark, seed)
    names = ["intercept", "slope", "n_points", "last_x", "last_y"]
    near = {r.key: r for r in tm.fit_poisson(df, "x", "y", by="key").collect()}
    far = {r.key: r for r in tm.fit_poisson_distributed(df, "x", "y", by="key").collect()}
    assert near.keys() == far.keys()
    for key, row in near.items():
        for name in names:
            if row[name] is None:
                assert far[key][name] is None
            else:
                assert far[key][name] == pytest.approx(row[name], rel=1e-7, abs=1e-7), (key, name)


def test_keyed_distributed_fit_takes_any_predictor(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1e6, 1e6, 3000)
    y = rng.poisson(np.exp(2 + 1e-6 * x))
    rows = [("a", 1, float(v), float(w)) for v, w in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "k string, j int, x double, y double")
    row = tm.fit_poisson_distributed(df, "x", "y", by=["k", "j"]).first()
    assert (row.intercept, row.slope) == pytest.approx(tuple(brute_fit(x / 1e6, y) * [1, 1e-6]), rel=1e-6)
    assert row.last_x == pytest.approx(x.max())
    assert tm.fit_poisson_distributed(df.where("false"), "x", "y", by="k").collect() == []
    with pytest.raises(Exception, match="needs values"):
        tm.fit_poisson_distributed(df.withColumn("y", F.lit(-1.0)), "x", "y", by="k").collect()


def test_later_rounds_read_unfinished_keys_only(spark, monkeypatch):
    from tidemark.operators import poisson

    active = []
    plain = poisson._newton_round
    monkeypatch.setattr(poisson, "_newton_round", lambda p, a, k: active.append(a.count()) or plain(p, a, k))
    tm.fit_poisson_distributed(keyed_points(spark, 0), "x", "y", by="key").collect()
    assert active[0] == 6  # flat, zero and single-point series need no round
    assert active == sorted(active, reverse=True) and active[-1] < active[0]


def test_fractional_predictors_are_kept_and_forecast_by_whole_days(spark):
    df = spark.createDataFrame([(0.5, 1.0), (1.5, 2.0), (2.5, 4.0), (10.5, 900.0)], "x double, y double")
    model = tm.fit_poisson_distributed(df, "x", "y")
    assert model.first().last_x == 10.5
    days = [r.days_elapsed for r in tm.forecast_until(model, 5000).collect()]
    assert days[0] == 11 and days == sorted(days)


def test_no_generated_code_is_too_large(spark):
    """A plan whose code outgrows the limit would silently run without code generation."""
    model = model_row(spark, 0.5, 0.01)
    target = F.expr("CASE WHEN last_x > 3 THEN 100 WHEN last_x > 2 THEN 1e300 ELSE 2 * last_x END")
    for rows in (tm.forecast_until(model, target), tm.crossing_date(model, target)):
        codes = rows._jdf.queryExecution().debug().codegenToSeq()
        for i in range(codes.size()):
            code = codes.apply(i)._2()
            assert len(code) < 100_000
            assert code.count("exp(") < 12
