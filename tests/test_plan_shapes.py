"""Plans that matter at scale: one scan, narrow reads, no stray joins."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
import tidemark as tm

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def executed_plan(df):
    """All final plans, those of subqueries included; initial plans are cut out by their indent."""
    df.collect()
    kept, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        indent = len(re.match(r"[\s:|+-]*", line).group())
        if skip is not None and (indent >= skip or not line.strip()):
            continue
        skip = indent if "== Initial Plan ==" in line else None
        if skip is None:
            kept.append(line)
    return "\n".join(kept)


@pytest.mark.parametrize(
    "name",
    [
        "series_stats",
        "series_stats_by_key",
        "series_stats_by_key_global",
        "densify_daily",
        "densify_by_key_global",
        "sql_passthrough",
        "combined_series",
        "combined_series_by_key",
        "crossing_date_by_key",
        "threshold_day",
        "threshold_day_by_key",
    ],
)
def test_one_scan(spark, name):
    assert executed_plan(entry.queries()[name](spark, SF_DIR)).count("FileScan") == 1


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("series_stats", "struct<o_orderdate:timestamp_ntz>"),
        ("series_stats_by_key", "struct<ts:timestamp_ntz,user_id:bigint>"),
        ("crossing_date_by_key", "struct<ts:timestamp_ntz,event_type:string>"),
        ("min_date", "struct<o_orderdate:timestamp_ntz>"),
    ],
)
def test_narrow_scan(spark, name, columns):
    assert f"ReadSchema: {columns}" in executed_plan(entry.queries()[name](spark, SF_DIR))


@pytest.mark.parametrize("name", ["series_stats_by_key", "densify_by_key", "crossing_date_by_key", "poisson_fit_by_user"])
def test_keyed_series_need_no_join(spark, name):
    plan = executed_plan(entry.queries()[name](spark, SF_DIR))
    assert "Join" not in plan
    assert "SinglePartition" not in plan


@pytest.mark.parametrize(("name", "reads"), [("running_total_rows", 2), ("running_total_rows_by_key", 2), ("running_total_peers", 3)])
def test_row_totals_read_the_source_twice(spark, name, reads):
    """Once for split points, once for rows; with peers the rows are joined back to."""
    plan = executed_plan(entry.queries()[name](spark, SF_DIR))
    assert plan.count("FileScan") == reads
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("name", ["forecast_until", "forecast_by_key", "crossing_date", "combined_series_by_key"])
def test_a_series_is_fitted_once(spark, name):
    assert executed_plan(entry.queries()[name](spark, SF_DIR)).count("ArrowEvalPython") == 1


def test_first_wins_hashes_one_fixed_width_order(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    plan = executed_plan(tm.first_wins(events, "user_id", "event_type", "value", "event_id"))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_counting_starts_before_the_shuffle(spark):
    plan = executed_plan(entry.queries()["daily_counts_by_key"](spark, SF_DIR))
    assert "partial_count" in plan.split("Exchange")[-1]


def test_row_totals_do_not_gather_rows(spark):
    plan = executed_plan(entry.queries()["running_total_rows"](spark, SF_DIR))
    window = plan[plan.index("Window") :]
    assert "hashpartitioning(_bucket" in window
    assert "SortMergeJoin" not in plan
