"""First-wins collapse of key/value rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tidemark.functions.columns import key_list
from tidemark.operators.totals import running_total_rows


def first_wins(
    df: DataFrame,
    entity: str | Sequence[str],
    key: str,
    value: str,
    order_by: str | Sequence[str],
    allow_duplicate_key: bool = True,
    allow_empty_key: bool = False,
) -> DataFrame:
    """First value per entity and key: ``(entity..., key, value)``.

    ``order_by`` must be unique within an entity and key; a null in it fails the
    job, since its value would have no place. An aggregate, so repeats are dropped
    before the shuffle: by hash with one order column and a value of fixed width,
    else after a sort within each task. Empty or null keys fail the job unless
    allowed; so do repeated keys when not allowed.
    """
    entities, order = key_list(entity), key_list(order_by)
    name = F.col(key)
    if not allow_empty_key:
        text = F.raise_error("empty or null key").cast(df.schema[key].dataType)
        name = F.when(name.isNull() | (name.cast("string") == ""), text).otherwise(name)
    placed = [_not_null(df, column).alias(column) for column in order]
    first = F.min_by(value, F.struct(*placed) if len(order) > 1 else placed[0])
    if not allow_duplicate_key:
        repeated = F.raise_error("duplicate key").cast(df.schema[value].dataType)
        first = F.when(F.count(F.lit(1)) > 1, repeated).otherwise(first)
    return df.groupBy(*entities, name.alias(key)).agg(first.alias(value))


def _not_null(df: DataFrame, column: str) -> Column:
    missing = F.raise_error(f"null order in {column}").cast(df.schema[column].dataType)
    return F.when(F.col(column).isNull(), missing).otherwise(F.col(column))


def collapse_to_map(
    collapsed: DataFrame, entity: str | Sequence[str], key: str, value: str, max_bytes: int | None = None
) -> DataFrame:
    """One map per entity from the rows of ``first_wins``, keys sorted.

    A map is one value of one row, so without ``max_bytes`` all keys of an entity must
    fit in a row. With it an entity has as many maps as it needs, numbered from 0 by
    ``part`` in the order of keys, each of at most so many bytes of keys and values, as
    text, unless one entry alone takes more than half of them. The parts come from a distributed running total of bytes, so
    an entity of any size is no task's alone. A map has no null key: one fails the job.
    """
    entities = key_list(entity)
    if max_bytes is not None:
        size = F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + F.coalesce(
            F.octet_length(F.col(value).cast("string")), F.lit(0)
        )
        half = max(1, max_bytes // 2)
        sized = collapsed.withColumn("_size", F.least(size, F.lit(half)).cast("bigint"))
        placed = running_total_rows(sized, "_size", key, entities, out="_upto")
        # an entry belongs where its last byte falls; what its first ones add is another half
        part = F.floor((F.greatest(F.col("_upto"), F.lit(1)) - 1) / half).cast("int").alias("part")
        collapsed, entities = placed.select(*collapsed.columns, part), [*entities, "part"]
    entries = F.sort_array(F.collect_list(F.struct(key, value)))
    return collapsed.groupBy(*entities).agg(F.map_from_entries(entries).alias("record"))
