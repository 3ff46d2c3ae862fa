"""The sorted event listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tidemark.functions.dates import iso_date


def event_listing(events: DataFrame, slug: str = "slug", time_col: str = "created_at") -> DataFrame:
    """``(slug, created_at text)`` sorted by date, undated rows last.

    The slug breaks ties, which also lets the range partitioner split a day that
    holds a large share of all rows.
    """
    rows = events.select(F.col(slug).alias("slug"), iso_date(time_col).alias("created_at"))
    return rows.orderBy(F.col("created_at").asc_nulls_last(), F.col("slug").asc_nulls_last())
