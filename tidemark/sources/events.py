"""Readers for nested event documents and for columnar event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tidemark.functions.arrays import zip_vectors
from tidemark.functions.columns import as_column, bind

EVENT_FIELDS = "slug string, created_at string"

# A date text must open with a four-digit year. Without this, Spark's cast reads
# a bare time of day as that time on the current date.
YEAR_FIRST = r"^\s*\d{4}-|^\s*\d{4}\s*$"
MILLIS = r"^\s*-?\d{11,15}\s*$"
SHORTEST = 8  # characters of 3/8/2023, the shortest other text

# Month names by their first letters.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

# One pattern for all other forms. The parts of a date have a group in each order that
# they come in; only those of the order that matches are set.
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_DATES = [
    (rf"(\d{{1,2}})[\s-]{_MONTH}[\s-](\d{{4}})", "dmy"),  # 8 Mar 2023
    (rf"{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})", "mdy"),  # March 8, 2023
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", "mdy"),  # 3/8/2023
    (r"(\d{4})/(\d{1,2})/(\d{1,2})", "ymd"),  # 2023/03/08
]
_ORDER = "".join(order for _, order in _DATES)
_TIME = r"(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?:\s*([ap])\.?m\.?)?)?"
_ZONE = r"(?:\s*(?:GMT|UTC|Z)?\s*(?:([+-])(\d{1,2}):?(\d{2}))?)?"
DATE_TEXT = (
    r"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
    rf"(?:{'|'.join(pattern for pattern, _ in _DATES)}){_TIME}{_ZONE}(?:\s*\([^)]*\))?$"
)
_PARTS = ["y", "m", "d", "hour", "minute", "second", "half", "sign", "off_hours", "off_minutes"]
_NUMBERS = {"hour", "minute", "second", "off_hours", "off_minutes"}


def document_schema(array_field: str = "tags", fields: str = EVENT_FIELDS) -> str:
    """Schema of a wrapper document; fields left out here are never parsed."""
    return f"`{array_field}` array<struct<{fields}>>"


def read_documents(
    spark: SparkSession,
    path: str | Sequence[str],
    array_field: str = "tags",
    fields: str = EVENT_FIELDS,
    one_per_line: bool = False,
) -> DataFrame:
    """Read JSON documents that hold their rows in one array field.

    One file is one document, hence one task; ``one_per_line`` reads
    line-delimited documents, whose files Spark can split. Malformed JSON fails
    the job.
    """
    return (
        spark.read.schema(document_schema(array_field, fields))
        .option("multiLine", not one_per_line)
        .option("mode", "FAILFAST")
        .json(path if isinstance(path, str) else list(path))
    )


def unnest_documents(
    docs: DataFrame, array_field: str = "tags", fields: Sequence[str] = ("slug", "created_at")
) -> DataFrame:
    """One row per array element, keeping only ``fields`` of it.

    The fields are taken as arrays and zipped back, since the optimizer prunes
    nested columns of a scan by such paths but not through ``explode``.
    """
    vectors = [F.col(f"{array_field}.{field}").alias(field) for field in fields]
    return docs.select(*vectors).select(F.inline(zip_vectors(*fields)))


def parse_day(text: Column | str) -> Column:
    """Day, in UTC, of a date or date-time text; null where the text is not one.

    Read are ISO texts; ``8 Mar 2023`` and ``March 8, 2023``; ``3/8/2023``, the month
    first, and ``2023/03/08``; and milliseconds since 1970 as at least 11 digits. A
    weekday may stand before a date, a time of day after it, with ``AM`` or ``PM`` or by
    24 hours, and then ``GMT``, ``UTC`` or ``Z``, an offset such as ``+0200`` or
    ``GMT+02:00``, and a remark in brackets. A text without offset is in UTC.
    """
    column = as_column(text)
    trimmed = F.trim(column)
    millis = F.timestamp_millis(F.when(column.rlike(MILLIS), trimmed.cast("bigint")))
    # each text meets one pattern after another until one fits; the last is matched once
    return (
        F.when(column.rlike(YEAR_FIRST), F.to_date(F.try_to_timestamp(column)))
        .when(F.length(trimmed) < SHORTEST, F.lit(None))
        .when(column.rlike(MILLIS), F.to_date(millis))
        .otherwise(bind(_replaced(trimmed), lambda r: bind(_parts(trimmed, r), _day_of_parts)))
    )


def _replaced(text: Column) -> Column:
    """The groups of ``DATE_TEXT`` in the order of ``_PARTS``, or the text as it is."""
    last = len(_ORDER)
    groups = ["".join(f"${i}" for i, part in enumerate(_ORDER, 1) if part == p) for p in "ymd"]
    groups += [f"${i}" for i in range(last + 1, last + 1 + len(_PARTS) - 3)]
    return F.regexp_replace(text, DATE_TEXT, "|".join(groups))


def _parts(text: Column, replaced: Column) -> Column:
    """The groups, null where the text did not fit."""
    return F.split(F.when(replaced != text, replaced), r"\|", -1)


def _day_of_parts(parts: Column) -> Column:
    """The UTC day of the parts of a date text; null if they are no date or no time."""
    part = {name: F.get(parts, F.lit(i)) for i, name in enumerate(_PARTS)}
    # a zero in front makes absent parts 0 at no cost; a failing cast is a slow one
    number = {name: F.concat(F.lit("0"), value).cast("int") for name, value in part.items() if name in _NUMBERS}
    by_name = (F.position(F.lower(F.substring(part["m"], 1, 3)), F.lit(MONTHS)) + 2) / 3
    month = F.when(part["m"].rlike(r"^\d"), part["m"].cast("int")).otherwise(by_name.cast("int"))
    first = F.make_date(part["y"].cast("int"), F.when(month.between(1, 12), month), F.lit(1))
    day = F.date_add(first, part["d"].cast("int") - 1)
    day = F.when(F.trunc(day, "month") == first, day)
    noon = F.when(F.lower(part["half"]) == "p", 12).when(part["half"] != "", 0)
    hour = F.when(part["half"] == "", number["hour"]).otherwise(number["hour"] % 12 + noon)
    in_range = F.when(part["half"] == "", number["hour"] < 24).otherwise(number["hour"].between(1, 12))
    in_range = in_range & (number["minute"] < 60) & (number["second"] < 60) & (number["off_hours"] < 24) & (number["off_minutes"] < 60)
    offset = number["off_hours"] * 60 + number["off_minutes"]
    offset = F.when(part["sign"] == "-", -offset).otherwise(offset)
    minutes = hour * 60 + number["minute"] - offset
    return F.when(parts.isNotNull() & in_range, F.date_add(day, F.floor(minutes / 1440).cast("int")))


def parse_days(df: DataFrame, column: str = "created_at") -> DataFrame:
    """Replace a text column by its dates."""
    return df.withColumn(column, parse_day(column))


def bad_dates(df: DataFrame, column: str = "created_at") -> DataFrame:
    """Side output: the rows, text untouched, that ``parse_days`` turns to null."""
    return df.where(parse_day(column).isNull())


def date_quality(df: DataFrame, column: str = "created_at") -> DataFrame:
    """One row counting all texts, absent ones and unreadable ones."""
    text = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(text.isNull()).alias("n_null"),
        F.count_if(text.isNotNull() & parse_day(text).isNull()).alias("n_bad"),
    )


def read_events(
    spark: SparkSession,
    path: str | Sequence[str],
    array_field: str = "tags",
    one_per_line: bool = False,
) -> DataFrame:
    """Documents to typed rows ``(slug string, created_at date)``."""
    docs = read_documents(spark, path, array_field, one_per_line=one_per_line)
    return parse_days(unnest_documents(docs, array_field))


def read_table(
    spark: SparkSession,
    path: str,
    time_col: str | None = None,
    start: object = None,
    end: object = None,
    schema: str | None = None,
) -> DataFrame:
    """Read Parquet, optionally within ``start <= time_col < end``.

    A declared ``schema`` saves the job that reads one from a file. The bounds are plain comparisons on the stored column, so they reach the
    scan as pushed filters and prune partitions and row groups.
    """
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if time_col is None:
        if start is not None or end is not None:
            raise ValueError("start and end need time_col")
        return df
    kind = df.schema[time_col].dataType
    if start is not None:
        df = df.where(F.col(time_col) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(time_col) < F.lit(end).cast(kind))
    return df
