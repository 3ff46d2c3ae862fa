"""Series as vectors, and functions over whole series."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tidemark.functions.arrays import zip_vectors
from tidemark.functions.columns import key_list
from tidemark.functions.missing import mask_missing
from tidemark.operators.totals import running_total_rows


def series_to_vectors(
    series: DataFrame,
    columns: Sequence[str],
    order: str,
    by: str | Sequence[str] | None = None,
    max_length: int | None = None,
    one_row_per_order: bool = False,
) -> DataFrame:
    """One row per key holding each column as an array in ``order``.

    Without ``max_length`` for series of at most one row per key and day. With it, a key
    has as many rows as it needs, numbered from 0 by ``part``, each of so many positions
    but for the last; positions come from a distributed count, so no task holds a long
    series. Parallel arrays of a part stay parallel. ``one_row_per_order`` fails the job
    if a key has two rows of one ``order``, as a series must not.
    """
    keys = key_list(by)
    if one_row_per_order:
        series = _one_row_per_order(series, [*keys, order])
    if max_length is not None:
        placed = running_total_rows(series, F.lit(1), order, keys, out="_place")
        part = F.floor((F.col("_place") - 1) / max_length).cast("int").alias("part")
        series, by = placed.select(*series.columns, part), [*keys, "part"]
    sorted_rows = F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    vectors = series.groupBy(*key_list(by)).agg(sorted_rows.alias("_rows"))
    return vectors.select(*key_list(by), *[F.col(f"_rows.{c}").alias(c) for c in columns])


def _one_row_per_order(series: DataFrame, position: Sequence[str]) -> DataFrame:
    """The series, its rows counted by position on the way; a second row fails the job."""
    rest = [c for c in series.columns if c not in position]
    rows = series.groupBy(*position).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in rest])
    text = F.raise_error("a key has several rows of one " + position[-1])
    kind = series.schema[position[-1]].dataType
    checked = F.when(F.col("_n") > 1, text.cast(kind)).otherwise(F.col(position[-1])).alias(position[-1])
    return rows.withColumn(position[-1], checked).select(*series.columns)


def vectors_to_rows(
    vectors: DataFrame, columns: Sequence[str], by: str | Sequence[str] | None = None
) -> DataFrame:
    """Parallel arrays back to one row per position."""
    zipped = vectors.select(*key_list(by), F.inline(zip_vectors(*columns)))
    return zipped.toDF(*key_list(by), *columns)


def apply_series(
    series: DataFrame,
    function: Callable[..., Mapping[str, Iterable] | pd.DataFrame],
    inputs: Sequence[str],
    schema: str | T.StructType,
    by: str | Sequence[str] | None = None,
    order: str | None = None,
    **scalars: object,
) -> DataFrame:
    """Run a Python function of column vectors over each whole series.

    ``function(*vectors, **scalars)`` gets the ``inputs`` columns as numpy
    arrays in ``order`` and returns columns that match ``schema``; the key
    columns are added back. NaN in a result becomes null, also in arrays, structs and maps. For
    series of at most one row per key and day, since a key is one Arrow group; for
    longer ones see ``apply_series_chunks``.
    """
    keys, names = key_list(by), list(inputs)
    result = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*[series.schema[key] for key in keys], *result.fields])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(order) if order else group
        out = pd.DataFrame(function(*[ordered[n].to_numpy() for n in names], **scalars))
        for position, key in enumerate(keys):
            out.insert(position, key, group[key].iloc[0])
        return out[full.names]

    needed = list(dict.fromkeys([*keys, *names, *([order] if order else [])]))
    raw = series.select(*needed).groupBy(*keys).applyInPandas(run, full)
    return _masked(raw, keys, result)


def _masked(raw: DataFrame, keys: Sequence[str], result: T.StructType) -> DataFrame:
    return raw.select(*keys, *[mask_missing(f"`{f.name}`", f.dataType).alias(f.name) for f in result.fields])


def apply_series_chunks(
    series: DataFrame,
    function: Callable[..., Iterator[Mapping[str, Iterable]]],
    inputs: Sequence[str],
    schema: str | T.StructType,
    by: str | Sequence[str],
    order: str | Sequence[str],
    **scalars: object,
) -> DataFrame:
    """Run a Python generator over each series, chunk by chunk, for series of any length.

    ``function(chunks, **scalars)`` gets an iterator of the ``inputs`` columns as tuples
    of numpy arrays, consecutive pieces of the series in ``order``, and yields columns
    that match ``schema`` whenever it has some. What it carries from chunk to chunk are
    its local variables; a task holds one chunk, an Arrow batch. A key is sorted by
    Spark, which may spill, and is one task's work, so this is for functions that need
    the whole series in order. Nulls in floating inputs are NaN; NaN in a result
    becomes null.
    """
    keys, names = key_list(by), list(inputs)
    result = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*[series.schema[key] for key in keys], *result.fields])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in full])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = (tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in names) for batch in batches)
        for columns in function(chunks, **scalars):
            out = {name: pa.array(np.asarray(values) if not isinstance(values, list) else values, arrow.field(name).type) for name, values in columns.items()}
            size = len(next(iter(out.values())))
            held = [pa.repeat(value.cast(arrow.field(k).type), size) for k, value in zip(keys, key, strict=True)]
            yield pa.RecordBatch.from_arrays([*held, *[out[n] for n in result.names]], schema=arrow)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    placed = list(dict.fromkeys([*keys, *names, *key_list(order)]))
    ordered = series.select(*placed).repartition(*keys).sortWithinPartitions(*keys, *key_list(order))
    return _masked(ordered.groupBy(*keys).applyInArrow(run, full), keys, result)
