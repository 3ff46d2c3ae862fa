"""Complete daily series, running totals and Poisson forecasts as Spark DataFrame plans."""

from tidemark.functions.arrays import record_map, zip_vectors
from tidemark.functions.dates import (
    add_days,
    date_series,
    day_of,
    days_between,
    iso_date,
    long_date,
)
from tidemark.functions.missing import mask_missing, null_if_missing, zero_if_null
from tidemark.operators.collapse import collapse_to_map, first_wins
from tidemark.operators.counts import daily_counts, date_bounds, min_date
from tidemark.operators.forecast import crossing_date, forecast_until, predict_response
from tidemark.operators.gaps import date_spine, densify, join_spine
from tidemark.operators.listing import event_listing
from tidemark.operators.poisson import fit_poisson, fit_poisson_distributed, predict_vectors
from tidemark.operators.profile import json_quality, key_profile
from tidemark.operators.strict import strict_cast
from tidemark.operators.threshold import first_reaching
from tidemark.operators.totals import days_elapsed, running_total, running_total_rows
from tidemark.operators.vectors import apply_series, apply_series_chunks, series_to_vectors, vectors_to_rows
from tidemark.plans.report import actual_series, combined_series, predicted_series
from tidemark.plans.stats import fit_counts, fit_stats, series_stats, stats_from_counts, stats_vectors
from tidemark.sources.catalog import (
    describe_columns,
    list_tables,
    register_table,
    run_sql,
    table_listing,
    to_records,
)
from tidemark.sources.events import (
    bad_dates,
    date_quality,
    parse_days,
    read_documents,
    read_events,
    read_table,
    unnest_documents,
)
from tidemark.sources.large_json import read_large_documents, write_large_documents
from tidemark.sources.sinks import ordered_series, tabular_view, write_series

__all__ = [
    "actual_series",
    "add_days",
    "apply_series",
    "apply_series_chunks",
    "bad_dates",
    "collapse_to_map",
    "combined_series",
    "crossing_date",
    "daily_counts",
    "date_bounds",
    "date_quality",
    "date_series",
    "date_spine",
    "day_of",
    "days_between",
    "days_elapsed",
    "densify",
    "describe_columns",
    "event_listing",
    "first_reaching",
    "first_wins",
    "fit_counts",
    "fit_poisson",
    "fit_poisson_distributed",
    "fit_stats",
    "forecast_until",
    "iso_date",
    "join_spine",
    "json_quality",
    "key_profile",
    "list_tables",
    "long_date",
    "mask_missing",
    "min_date",
    "null_if_missing",
    "parse_days",
    "predict_response",
    "predict_vectors",
    "predicted_series",
    "read_documents",
    "read_events",
    "read_large_documents",
    "read_table",
    "record_map",
    "register_table",
    "run_sql",
    "running_total",
    "running_total_rows",
    "series_stats",
    "series_to_vectors",
    "stats_from_counts",
    "stats_vectors",
    "strict_cast",
    "table_listing",
    "tabular_view",
    "to_records",
    "unnest_documents",
    "vectors_to_rows",
    "ordered_series",
    "write_large_documents",
    "write_series",
    "zero_if_null",
    "zip_vectors",
]
