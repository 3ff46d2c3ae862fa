import datetime as dt
import json

import pytest
from conftest import TOY, tuples
from pyspark.sql import functions as F

import tidemark as tm
from tidemark.sources.events import parse_day


def toy_document():
    tags = [{"slug": slug, "created_at": day} for slug, day in TOY.items()]
    tags[0]["extra"] = 1
    return {"tags": tags, "version": 3}


def test_read_events_from_one_document(spark, tmp_path):
    path = tmp_path / "tags.json"
    path.write_text(json.dumps(toy_document(), indent=2))
    events = tm.read_events(spark, str(path))
    assert events.schema.simpleString() == "struct<slug:string,created_at:date>"
    assert sorted(tuples(events)) == [(s, dt.date.fromisoformat(d)) for s, d in TOY.items()]


def test_read_events_one_document_per_line_from_many_files(spark, tmp_path):
    for i in range(3):
        lines = [json.dumps(toy_document()), json.dumps({"tags": []})]
        (tmp_path / f"{i}.json").write_text("\n".join(lines))
    paths = [str(tmp_path / f"{i}.json") for i in range(3)]
    assert tm.read_events(spark, paths, one_per_line=True).count() == 3 * len(TOY)


def test_malformed_document_fails(spark, tmp_path):
    path = tmp_path / "broken.json"
    path.write_text('{"tags": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        tm.read_events(spark, str(path)).collect()


def test_other_array_field(spark, tmp_path):
    path = tmp_path / "other.json"
    path.write_text('{"items": [{"slug": "x", "created_at": "2024-02-29"}]}')
    assert tuples(tm.read_events(spark, str(path), "items")) == [("x", dt.date(2024, 2, 29))]


def test_unused_nested_fields_are_not_read(spark, tmp_path):
    tags = F.array(F.struct(F.lit("s").alias("slug"), F.lit("2023-01-01").alias("created_at"), F.lit(1).alias("extra")))
    spark.range(3).select(tags.alias("tags"), "id").write.parquet(str(tmp_path / "docs"))
    rows = tm.unnest_documents(tm.read_table(spark, str(tmp_path / "docs")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<tags:array<struct<slug:string,created_at:string>>>" in plan


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2023-03-08", dt.date(2023, 3, 8)),
        ("2023-03-08T23:59:59Z", dt.date(2023, 3, 8)),
        ("2023-03-08T23:30:00-05:00", dt.date(2023, 3, 9)),
        ("2023-03-08 10:11:12.5", dt.date(2023, 3, 8)),
        ("2023-02-30", None),
        ("junk", None),
        ("12:30", None),
        ("", None),
        (None, None),
        ("Wed Mar 08 2023", dt.date(2023, 3, 8)),
        ("March 8, 2023", dt.date(2023, 3, 8)),
        ("8 Mar 2023 10:00 GMT", dt.date(2023, 3, 8)),
        ("03/08/2023", dt.date(2023, 3, 8)),
        ("1678269600000", dt.date(2023, 3, 8)),
        ("Wed, 08 Mar 2023 10:00:00 GMT", dt.date(2023, 3, 8)),
        ("Wed Mar 08 2023 10:00:00 GMT+0000 (Coordinated Universal Time)", dt.date(2023, 3, 8)),
        ("mar 8 2023", dt.date(2023, 3, 8)),
        ("31 Feb 2023", None),
        ("13/40/2023", None),
        ("Wed Foo 08 2023", None),
        ("8 Mar 2023 10:00 PST", None),
    ],
)
def test_parse_day(spark, text, day):
    df = spark.createDataFrame([(text,)], "t string").select(parse_day("t"))
    assert tuples(df) == [(day,)]


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2023/03/08", "2023-03-08"),
        ("March 8, 2023 10:00 AM", "2023-03-08"),
        ("Wed, 08 Mar 2023 10:00:00 +0200", "2023-03-08"),
        ("Wed, 08 Mar 2023 00:30:00 +0200", "2023-03-07"),
        ("Wed Mar 08 2023 00:00:00 GMT+0100 (CET)", "2023-03-07"),
        ("12/31/2023 11:30 PM -0500", "2024-01-01"),
        ("1/1/2024 12:30 a.m.", "2024-01-01"),
        ("1/1/2024 12:30 PM UTC+13:00", "2023-12-31"),
        ("2/29/2024 23:59:59.999 Z", "2024-02-29"),
        ("2023-03-08T23:30:00-05:00", "2023-03-09"),
        ("2/29/2023", None),
        ("13/1/2024", None),
        ("8 Mar 2023 24:00", None),
        ("8 Mar 2023 13:00 PM", None),
        ("8 Mar 2023 10:60", None),
        ("1|2|3|4|5|6|7|8|9|10|11", None),
        ("8 Mar 2023 (a|b)", "2023-03-08"),
    ],
)
def test_parse_day_with_times_and_zones(spark, text, day):
    df = spark.createDataFrame([(text,)], "t string").select(parse_day("t"))
    assert str(df.first()[0]) == str(day)


def test_bad_and_null_dates_are_set_aside_and_counted(spark):
    raw = spark.createDataFrame([("a", "2023-01-01"), ("b", "junk"), ("c", None)], "slug string, created_at string")
    assert tuples(tm.date_quality(raw)) == [(3, 1, 1)]
    assert sorted(tuples(tm.bad_dates(raw))) == [("b", "junk"), ("c", None)]
    stats = tm.series_stats(tm.parse_days(raw), "created_at")
    assert tuples(stats) == [(dt.date(2023, 1, 1), 1, 1, 0)]
    # the undated rows are still a group of the plain counts
    assert (None, 2) in tuples(tm.daily_counts(tm.parse_days(raw), "created_at"))


def test_time_bounds_reach_the_scan(spark, tmp_path, toy):
    toy.write.parquet(str(tmp_path / "t"))
    df = tm.read_table(spark, str(tmp_path / "t"), "created_at", "2023-01-02", dt.date(2023, 1, 6))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at,2023-01-02)" in plan
    assert "LessThan(created_at,2023-01-06)" in plan
    assert [row.slug for row in df.collect()] == ["c"]
    with pytest.raises(ValueError, match="time_col"):
        tm.read_table(spark, str(tmp_path / "t"), start="2023-01-02")


def test_named_tables_and_sql(spark, toy):
    tm.register_table(toy, "tags")
    tm.register_table(toy, "zags")
    try:
        tables = tm.list_tables(spark)
        assert {"tags", "zags"} <= {row.name for row in tables.collect()}
        listing = tm.table_listing(tables.where("name in ('tags', 'zags')")).first().listing
        assert listing == '- name: "tags"\n- name: "zags"'
        assert tuples(tm.describe_columns("tags", spark)) == [
            ("slug", "string", True),
            ("created_at", "date", True),
        ]
        by_name = tm.run_sql(spark, "SELECT slug FROM tags WHERE created_at > :day", {"day": dt.date(2023, 1, 3)})
        assert sorted(tuples(by_name)) == [("d",), ("e",)]
    finally:
        spark.catalog.dropTempView("tags")
        spark.catalog.dropTempView("zags")
    by_frame = tm.run_sql(spark, "SELECT count(*) AS n FROM {t} WHERE slug = :s", {"s": "a"}, t=toy)
    assert tuples(by_frame) == [(1,)]


def test_records(spark, toy):
    records = list(tm.to_records(tm.event_listing(toy)))
    assert records[0] == {"slug": "a", "created_at": "2023-01-01"}
    assert len(records) == 5


def test_listing_puts_undated_rows_last(dated):
    df = dated({"z": ["2023-01-02", None], "a": ["2023-01-02", "2023-01-01"]})
    assert tuples(tm.event_listing(df, "key", "at")) == [
        ("a", "2023-01-01"),
        ("a", "2023-01-02"),
        ("z", "2023-01-02"),
        ("z", None),
    ]


def test_tabular_view(spark):
    df = spark.createDataFrame([(2, None), (1, dt.date(2023, 1, 1))], "n int, day date")
    assert tuples(tm.tabular_view(df, ["n"])) == [("1", "2023-01-01"), ("2", "")]
    assert tuples(tm.tabular_view(df, ["n"], limit=1)) == [("1", "2023-01-01")]


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_series_sink_is_sorted(spark, tmp_path, toy, fmt):
    counts = tm.daily_counts(toy, "created_at")
    stats, model = tm.stats_from_counts(counts), tm.fit_counts(counts)
    series = tm.combined_series(stats, model, 10).repartition(5)
    path = str(tmp_path / "out")
    tm.write_series(series, path, fmt=fmt)
    reader = spark.read.schema(series.schema).option("header", True)
    back = reader.format(fmt).load(path).select("valueType", "day").collect()
    assert len(back) == 11
    files = sorted((tmp_path / "out").glob("part-*"))
    in_order = [row for f in files for row in reader.format(fmt).load(str(f)).select("valueType", "day").collect()]
    assert in_order == sorted(in_order)
