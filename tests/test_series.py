import datetime as dt
import random

import pytest
from conftest import tuples
from pyspark.sql import functions as F

import tidemark as tm

D = dt.date


def sparse(seed, keys=6, rows=300, span=60):
    """Random (key, at) rows with one key holding a third of them, and nulls."""
    rnd = random.Random(seed)
    out = []
    for i in range(rows):
        key = "hot" if i % 3 == 0 else rnd.choice([None, *[f"k{j}" for j in range(keys)]])
        day = None if rnd.random() < 0.05 else D(2023, 1, 1) + dt.timedelta(rnd.randrange(span) // 3 * 3)
        out.append((key, day))
    return out


def expected_stats(rows, bounds="per_key"):
    """The same statistics by plain loops."""
    days = [day for _, day in rows if day]
    out = []
    for key in {key for key, day in rows if day}:
        own = [day for k, day in rows if k == key and day]
        lo, hi = (min(own), max(own)) if bounds == "per_key" else (min(days), max(days))
        total = 0
        for i in range((hi - lo).days + 1):
            day = lo + dt.timedelta(i)
            n = own.count(day)
            total += n
            out.append((key, day, n, total, i))
    return out


def by_text(rows):
    return sorted(rows, key=str)


def test_zero_counts_bound_a_series_too(spark):
    rows = [("a", "2023-01-01", 0), ("a", "2023-01-03", 1), ("a", "2023-01-06", 0), ("b", "2023-01-03", 2)]
    counts = spark.createDataFrame(rows, "key string, date string, daily_count long")
    counts = counts.withColumn("date", F.col("date").cast("date"))
    stats = tm.stats_from_counts(counts, "key", "global").orderBy("key", "date").collect()
    assert [(r.key, r.days_elapsed) for r in stats] == [(k, i) for k in "ab" for i in range(6)]
    dense = tm.densify(counts, "key", bounds="global").orderBy("key", "date").collect()
    assert [(r.key, r.date) for r in dense] == [(r.key, r.date) for r in stats]
    bounds = tm.date_bounds(counts).first()
    assert (str(bounds.first_day), str(bounds.last_day)) == ("2023-01-01", "2023-01-06")


def test_toy_stats(toy):
    assert sorted(tuples(tm.series_stats(toy, "created_at"))) == [
        (D(2023, 1, 1), 2, 2, 0),
        (D(2023, 1, 2), 0, 2, 1),
        (D(2023, 1, 3), 1, 3, 2),
        (D(2023, 1, 4), 0, 3, 3),
        (D(2023, 1, 5), 0, 3, 4),
        (D(2023, 1, 6), 2, 5, 5),
    ]


def test_stats_schema(toy):
    assert tm.series_stats(toy, "created_at").dtypes == [
        ("date", "date"),
        ("filled_daily_count", "bigint"),
        ("running_cumulative_sum", "bigint"),
        ("days_elapsed", "bigint"),
    ]


@pytest.mark.parametrize("bounds", ["per_key", "global"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_keyed_stats_match_loops(spark, seed, bounds):
    rows = sparse(seed)
    df = spark.createDataFrame(rows, "key string, at date").repartition(7)
    stats = tm.series_stats(df, "at", "key", bounds)
    assert by_text(tuples(stats)) == by_text(expected_stats(rows, bounds))


def test_one_key_equals_the_unkeyed_series_of_its_rows(spark):
    df = spark.createDataFrame(sparse(4), "key string, at date")
    keyed = tm.series_stats(df, "at", "key").where("key = 'hot'").drop("key")
    alone = tm.series_stats(df.where("key = 'hot'"), "at")
    assert sorted(tuples(keyed)) == sorted(tuples(alone))


def test_composed_operators_equal_the_fused_plan(spark):
    df = spark.createDataFrame(sparse(5), "key string, at date")
    counts = tm.daily_counts(df, "at", "key")
    for dense in (
        tm.densify(counts, "key"),
        tm.join_spine(tm.date_spine(tm.date_bounds(counts, "key"), "key"), counts, "key"),
    ):
        composed = tm.days_elapsed(tm.running_total(dense, by="key"), "key")
        assert by_text(tuples(composed)) == by_text(tuples(tm.stats_from_counts(counts, "key")))


def test_properties(spark):
    rows = sparse(6)
    df = spark.createDataFrame(rows, "key string, at date")
    stats = tm.series_stats(df, "at").orderBy("date").collect()
    kept = [day for _, day in rows if day]
    assert sum(r.filled_daily_count for r in stats) == len(kept) == stats[-1].running_cumulative_sum
    assert len(stats) == (max(kept) - min(kept)).days + 1
    totals = [r.running_cumulative_sum for r in stats]
    assert totals == sorted(totals)


@pytest.mark.parametrize("bounds", ["per_key", "global"])
def test_densify_is_idempotent(spark, bounds):
    df = spark.createDataFrame(sparse(7), "key string, at date")
    once = tm.densify(tm.daily_counts(df, "at", "key"), "key", bounds=bounds)
    twice = tm.densify(once, "key", bounds=bounds)
    assert by_text(tuples(once)) == by_text(tuples(twice))


def test_densify_several_columns_and_rows_that_share_a_day(spark):
    rows = [(D(2023, 1, 1), 5, "x"), (D(2023, 1, 1), None, "y"), (D(2023, 1, 3), 7, None)]
    df = spark.createDataFrame(rows, "date date, n int, s string")
    dense = tm.densify(df, fill={"n": 0, "s": "-"})
    assert sorted(tuples(dense)) == [
        (D(2023, 1, 1), 0, "y"),
        (D(2023, 1, 1), 5, "x"),
        (D(2023, 1, 2), 0, "-"),
        (D(2023, 1, 3), 7, "-"),
    ]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "key string, at date")
    counts = tm.daily_counts(empty, "at")
    assert tuples(tm.series_stats(empty, "at")) == []
    assert tuples(tm.series_stats(empty, "at", "key", "global")) == []
    assert tuples(tm.date_spine(tm.date_bounds(counts))) == []
    assert tuples(tm.min_date(empty, "at")) == [(None,)]
    assert tuples(tm.fit_counts(counts)) == []
    assert tuples(tm.forecast_until(tm.fit_counts(counts), 10)) == []


def test_single_day(dated):
    df = dated({"a": ["2023-05-05"] * 5})
    assert tuples(tm.series_stats(df, "at")) == [(D(2023, 5, 5), 5, 5, 0)]


def test_times_of_day_count_under_their_day(spark):
    stamps = [dt.datetime(2023, 1, d, h, m) for d in (1, 2) for h, m in ((0, 10), (23, 50))]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame([(s,) for s in stamps], f"at {kind}")
        assert sorted(tuples(tm.series_stats(df, "at"))) == [(D(2023, 1, 1), 2, 2, 0), (D(2023, 1, 2), 2, 4, 1)]


def test_wide_gap_can_be_refused(dated):
    df = dated({"a": ["2023-01-01", "2023-12-31"]})
    counts = tm.daily_counts(df, "at", "key")
    assert tm.densify(counts, "key", max_gap_days=400).count() == 365
    with pytest.raises(Exception, match="gap of 363 days exceeds max_gap_days=100"):
        tm.densify(counts, "key", max_gap_days=100).collect()
    with pytest.raises(ValueError, match="bounds"):
        tm.densify(counts, "key", bounds="none")


def test_date_functions(spark):
    df = spark.createDataFrame([(D(2023, 3, 8), D(2023, 3, 22))], "a date, b date")
    row = df.select(
        tm.iso_date("a"),
        tm.long_date("a"),
        tm.add_days("a", 24),
        tm.days_between("a", "b"),
        tm.date_series("a", "b", "7 days"),
        tm.date_series("b", "a"),
        tm.day_of(F.lit("2023-03-08 10:00:00").cast("timestamp")),
    ).first()
    assert tuple(row) == (
        "2023-03-08",
        "Wed Mar 08 2023",
        D(2023, 4, 1),
        14,
        [D(2023, 3, 8), D(2023, 3, 15), D(2023, 3, 22)],
        None,
        D(2023, 3, 8),
    )


def test_first_reaching(spark):
    df = spark.createDataFrame(sparse(8), "key string, at date")
    stats = tm.series_stats(df, "at", "key")
    found = {row.key: row.day for row in tm.first_reaching(stats, 10, "key").collect()}
    for key in found:
        days = [r[1] for r in expected_stats(sparse(8)) if r[0] == key and r[3] >= 10]
        assert found[key] == (min(days) if days else None)


@pytest.mark.parametrize("name", ["day", "x", "n", "total", "weight", "run", "goal", "root", "rows", "value", "slug"])
def test_key_names_do_not_clash_with_internal_columns(spark, name):
    df = spark.createDataFrame(sparse(9), f"{name} string, at date")
    counts = tm.daily_counts(df, "at", name)
    stats = tm.stats_from_counts(counts, name, "global")
    assert tm.densify(counts, name, bounds="global").count() == stats.count()
    models = [tm.fit_counts(counts, name), tm.fit_poisson(tm.stats_from_counts(counts, name), by=name, origin="date")]
    keys = {row[name] for row in counts.where("date IS NOT NULL").collect()}
    for model in models:
        assert {row[name] for row in tm.crossing_date(model, 1e4, name).collect()} == keys
    assert tm.running_total_rows(df, F.lit(1), "at", name).columns == [name, "at", "running_total"]


def period_start(day, grain):
    if grain == "week":
        return day - dt.timedelta(day.weekday())
    month = {"month": day.month, "quarter": (day.month - 1) // 3 * 3 + 1, "year": 1}.get(grain)
    return day if month is None else D(day.year, month, 1)


def next_period(day, grain):
    if grain in ("day", "week"):
        return day + dt.timedelta(7 if grain == "week" else 1)
    months = {"month": 1, "quarter": 3, "year": 12}[grain]
    index = day.year * 12 + day.month - 1 + months
    return D(index // 12, index % 12 + 1, 1)


@pytest.mark.parametrize("bounds", ["per_key", "global"])
@pytest.mark.parametrize("grain", ["day", "week", "month", "quarter", "year"])
def test_stats_of_every_grain(spark, grain, bounds):
    rnd = random.Random(grain + bounds)
    rows = [("hot" if i % 3 == 0 else rnd.choice([None, "a"]), D(2019, 11, 5) + dt.timedelta(rnd.randrange(1200))) for i in range(60)]
    rows.append(("a", None))
    df = spark.createDataFrame(rows, "key string, at date")
    starts = [(k, period_start(d, grain)) for k, d in rows if d]
    want = []
    for key in {k for k, _ in starts}:
        own = [d for k, d in starts if k == key]
        inside = own if bounds == "per_key" else [d for _, d in starts]
        day, total, i = min(inside), 0, 0
        while day <= max(inside):
            total += own.count(day)
            want.append((key, day, own.count(day), total, i))
            day, i = next_period(day, grain), i + 1
    assert by_text(tuples(tm.series_stats(df, "at", "key", bounds, grain=grain))) == by_text(want)
    dense = tm.densify(tm.daily_counts(df, "at", "key", grain), "key", bounds=bounds, grain=grain)
    assert by_text(tuples(dense)) == by_text([row[:3] for row in want])


def test_hours_cross_days_and_gaps_are_checked(spark):
    rows = [("a", "2023-03-25 22:59:59"), ("a", "2023-03-26 02:00:00"), ("a", "2023-03-26 02:30:00")]
    df = spark.createDataFrame(rows, "key string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    stats = tm.series_stats(df, "at", grain="hour").orderBy("date").collect()
    assert [str(r.date) for r in stats] == [f"2023-03-2{d} {h}:00:00" for d, h in [("5", "22"), ("5", "23"), ("6", "00"), ("6", "01"), ("6", "02")]]
    assert [(r.filled_daily_count, r.running_cumulative_sum, r.days_elapsed) for r in stats] == [(1, 1, 0), (0, 1, 1), (0, 1, 2), (0, 1, 3), (2, 3, 4)]
    with pytest.raises(Exception, match="gap of 3 hours exceeds max_gap_days=2"):
        tm.series_stats(df, "at", grain="hour", max_gap_days=2).collect()
    with pytest.raises(ValueError, match="grain"):
        tm.daily_counts(df, "at", grain="decade")
    model = tm.fit_counts(tm.daily_counts(df, "at", grain="hour"), grain="hour")
    crossing = tm.crossing_date(model, 10, grain="hour").first()
    assert crossing.status == "reached" and str(crossing.crossing_date).startswith("2023-03-26")


@pytest.mark.parametrize("grain", ["hour", "day", "week", "month", "quarter", "year"])
def test_grain_steps_distance_and_spine_agree(spark, grain):
    from tidemark.functions.grains import GRAINS

    g = GRAINS[grain]
    df = spark.createDataFrame([(i * 41,) for i in range(60)], "n int").select(
        g.start(F.expr("timestamp_ntz'2019-12-30 23:10:00' + make_dt_interval(n, n % 24)")).alias("a")
    )
    rows = df.select("a", *[g.add("a", n).alias(f"b{n}") for n in (0, 1, 5, -3)])
    check = rows.select(
        *[(g.between("a", f"b{n}") == n).alias(f"d{n}") for n in (0, 1, 5, -3)],
        (F.size(g.series("a", "b5")) == 6).alias("size"),
        (F.element_at(g.series("a", "b5"), 2) == F.col("b1")).alias("second"),
        (g.start("b5") == F.col("b5")).alias("start"),
        g.series("b1", "a").isNull().alias("crossed"),
    )
    assert all(all(row) for row in check.collect())
