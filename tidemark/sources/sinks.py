"""Ordered outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tidemark.functions.columns import key_list


def tabular_view(df: DataFrame, order_by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """The frame as text cells under its own header; nulls are empty cells.

    All rows by default. With ``limit`` the sort becomes a top-k.
    """
    ordered = df.orderBy(*[F.col(c).asc_nulls_last() for c in order_by]) if order_by else df
    if limit is not None:
        ordered = ordered.limit(limit)
    return ordered.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    )


def series_order(by: str | Sequence[str] | None = None) -> list[Column]:
    names = [*key_list(by), "valueType", "day"]
    return [F.col(name).asc_nulls_last() for name in names]


def ordered_series(series: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """A long-form series sorted by key, series and day, as a chart wants it."""
    return series.orderBy(*series_order(by))


def write_series(
    series: DataFrame,
    path: str,
    by: str | Sequence[str] | None = None,
    fmt: str = "parquet",
    mode: str = "errorifexists",
) -> None:
    """Write a long-form series sorted by key, series and day.

    The sort is range-partitioned, so each file holds one stretch of the order.
    """
    writer = ordered_series(series, by).write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
