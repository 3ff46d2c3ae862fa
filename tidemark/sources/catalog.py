"""Named tables, SQL text and result records."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the form of a line in the table listing.
LISTING_LINE = '- name: "%s"'


def register_table(df: DataFrame, name: str) -> DataFrame:
    """Give a frame a table name for SQL text and return it."""
    df.createOrReplaceTempView(name)
    return df


def run_sql(
    spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame
) -> DataFrame:
    """Run SQL text.

    ``:name`` markers take their values from ``args``; ``{name}`` markers stand
    for the frames passed by keyword, with no table registered.
    """
    return spark.sql(text, args=args, **frames)


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of the tables and views the session can see."""
    names = sorted(table.name for table in spark.catalog.listTables())
    return spark.createDataFrame([(name,) for name in names], "name string")


def table_listing(tables: DataFrame, name: str = "name") -> DataFrame:
    """One row of text with a line per table, in name order."""
    line = F.format_string(LISTING_LINE, F.col(name))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(name, line.alias("line")))), lambda r: r.line)
    return tables.agg(F.array_join(lines, "\n").alias("listing"))


def describe_columns(table: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    """Name, type and nullability of each column, in column order."""
    if isinstance(table, str):
        if spark is None:
            raise ValueError("a table name needs a session")
        table = spark.table(table)
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in table.schema.fields]
    return table.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean")


def to_records(df: DataFrame) -> Iterator[dict]:
    """Rows as dictionaries, fetched one partition at a time."""
    return (row.asDict(recursive=True) for row in df.toLocalIterator())
