"""Vectors of bounded length, functions over streamed series, strict vectors, nested NaN."""

from collections import defaultdict
from decimal import Decimal

import pytest
from conftest import tuples
from pyspark.sql import functions as F

import tidemark as tm


@pytest.fixture
def series(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, float(i % 11)) for i in range(600)] + [(None, 3, 1.0), (None, 1, 2.0)]
    return spark.createDataFrame(rows, "key string, at bigint, y double").repartition(5)


@pytest.mark.parametrize("length", [1, 7, 1000])
def test_chunks_are_bounded_numbered_and_in_order(spark, series, length):
    vectors = tm.series_to_vectors(series, ["at", "y"], "at", "key", max_length=length).collect()
    held = defaultdict(list)
    for r in sorted(vectors, key=lambda r: (str(r.key), r.part)):
        assert 1 <= len(r.at) <= length and len(r.at) == len(r.y)
        assert r.part == (held[r.key][-1][0] + 1 if held[r.key] else 0)
        assert not held[r.key] or len(held[r.key][-1][1]) == length
        held[r.key].append((r.part, r.at))
    whole = tm.series_to_vectors(series, ["at", "y"], "at", "key").collect()
    assert {r.key: list(r.at) for r in whole} == {k: [x for _, at in parts for x in at] for k, parts in held.items()}


def test_two_rows_of_one_position_fail(spark, series):
    assert tm.series_to_vectors(series, ["y"], "at", "key", one_row_per_order=True).count() == 9
    twice = series.union(series.where("at = 5"))
    with pytest.raises(Exception, match="several rows of one at"):
        tm.series_to_vectors(twice, ["y"], "at", "key", one_row_per_order=True).collect()


def test_chunked_function_carries_its_state(spark, series):
    def totals(chunks, start):
        total, seen = start, 0
        for at, y in chunks:
            assert len(at) <= 50  # never a whole long series
            sums = y.cumsum() + total
            total, seen = sums[-1], seen + 1
            yield {"at": at, "total": sums, "chunk": [seen] * len(at)}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        schema = "at bigint, total double, chunk int"
        out = tm.apply_series_chunks(series, totals, ["at", "y"], schema, "key", "at", start=10.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(r.key, r.at): r.running_total + 10 for r in tm.running_total_rows(series, "y", "at", "key").collect()}
    assert {(r.key, r.at): r.total for r in out} == pytest.approx(want)
    assert max(r.chunk for r in out if r.key == "hot") == 8


def test_nan_inside_results_is_missing(spark):
    def function(x):
        nan = float("nan")
        return {"v": [[1.0, nan, None]], "s": [{"a": nan, "b": [{"c": nan, "d": "t"}]}], "m": [{"k": nan}], "n": [nan]}

    schema = "v array<double>, s struct<a: double, b: array<struct<c: float, d: string>>>, m map<string, double>, n double"
    df = spark.createDataFrame([("a", 1.0)], "key string, x double")
    row = tm.apply_series(df, function, ["x"], schema, "key").first()
    assert list(row.v) == [1.0, None, None] and row.n is None and row.m == {"k": None}
    assert row.s.a is None and row.s.b[0].c is None and row.s.b[0].d == "t"


def test_values_without_floats_are_left_alone(spark):
    from pyspark.sql import types as T

    kind = T.ArrayType(T.StructType([T.StructField("a", T.LongType())]))
    assert "transform" not in str(tm.mask_missing("x", kind))
    rows = spark.createDataFrame([(None,), ([float("nan"), 2.0],)], "v array<double>")
    assert [r[0] for r in rows.select(tm.mask_missing("v", T.ArrayType(T.DoubleType()))).collect()] == [None, [None, 2.0]]


VECTORS = "b array<boolean>, n array<bigint>, d array<double>, c array<decimal(30,10)>, s array<string>, x bigint"


def vector_frame(spark, **values):
    row = {"b": [True], "n": [1, 2], "d": [0.5], "c": [Decimal("0.1")], "s": ["t"], "x": 1} | values
    return spark.createDataFrame([tuple(row[k] for k in ["b", "n", "d", "c", "s", "x"])], VECTORS)


def test_strict_vectors(spark):
    kinds = {"b": "number[]", "n": "number[]", "d": "number[]", "c": "number[]", "s": "string[]"}
    out = tm.strict_cast(vector_frame(spark), kinds)
    assert tuples(out.drop("x")) == [([1.0], [1.0, 2.0], [0.5], [0.1], ["t"])]
    assert tuples(tm.strict_cast(vector_frame(spark, b=[], s=[]), {"b": "boolean[]", "s": "string[]"}).select("b", "s")) == [([], [])]


@pytest.mark.parametrize(
    ("column", "values", "kind", "message"),
    [
        ("n", [1, 2, None], "number[]", "n to number.*element 3"),
        ("n", [2**53 + 1, 1], "number[]", "element 1"),
        ("d", [1.0, float("nan")], "number[]", "element 2"),
        ("c", [Decimal("1"), Decimal("12345678901234567890.1234567891")], "number[]", "element 2"),
        ("b", [None], "boolean[]", "element 1"),
        ("s", ["a", None, None], "string[]", "element 2"),
        ("s", None, "string[]", "a null of s"),
    ],
)
def test_strict_vectors_name_the_first_failing_position(spark, column, values, kind, message):
    with pytest.raises(Exception, match=message):
        tm.strict_cast(vector_frame(spark, **{column: values}), {column: kind}).collect()


def test_strict_vectors_of_another_kind_fail_at_once(spark):
    df = vector_frame(spark)
    for name, kind in [("x", "number[]"), ("n", "number"), ("n", "boolean[]"), ("s", "number[]"), ("b", "string[]")]:
        with pytest.raises(TypeError, match=name):
            tm.strict_cast(df, {name: kind})
    with pytest.raises(ValueError, match="date"):
        tm.strict_cast(df, {"n": "date[]"})


def test_a_decimal_that_a_double_cannot_hold_fails(spark):
    df = spark.createDataFrame([(Decimal("0.1"), Decimal("12345678901234567.123"))], "a decimal(10,2), b decimal(30,3)")
    assert tm.strict_cast(df, {"a": "number"}).first().a == 0.1
    with pytest.raises(Exception, match="value of b"):
        tm.strict_cast(df, {"b": "number"}).collect()


@pytest.mark.parametrize("limit", [1, 20, 10_000])
def test_map_parts_are_bounded_and_complete(spark, limit):
    rows = [("big" if i % 4 else "small", f"key{i:04d}", "v" * (i % 40)) for i in range(800)]
    df = spark.createDataFrame(rows, "entity string, key string, value string")
    parts = tm.collapse_to_map(df, "entity", "key", "value", max_bytes=limit).collect()
    whole = {r.entity: r.record for r in tm.collapse_to_map(df, "entity", "key", "value").collect()}
    joined = defaultdict(dict)
    for r in sorted(parts, key=lambda r: (r.entity, r.part)):
        assert not joined[r.entity] or max(joined[r.entity]) < min(r.record)
        sizes = [len(k) + len(v) for k, v in r.record.items()]
        assert sum(sizes) <= limit or max(sizes) > limit / 2
        joined[r.entity].update(r.record)
    assert dict(joined) == whole


def test_an_entity_of_very_many_keys(spark):
    df = spark.range(300_000).select(F.lit("one").alias("e"), F.col("id").cast("string").alias("k"), F.lit("value").alias("v"))
    parts = tm.collapse_to_map(df, "e", "k", "v", max_bytes=100_000).select(F.size("record").alias("n")).collect()
    assert len(parts) > 20 and sum(r.n for r in parts) == 300_000


def test_predictions_end_where_the_calendar_does():
    import numpy as np

    x, y = np.arange(5), np.exp(0.01 * np.arange(5))
    assert len(tm.predict_vectors(y, x, 1e4)["days_elapsed"]) > 900
    assert len(tm.predict_vectors(y, x, 1e4, last_day=500)["days_elapsed"]) == 0
