"""Null and NaN handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tidemark.functions.columns import as_column


def zero_if_null(value: Column | str, default: object = 0) -> Column:
    return F.coalesce(as_column(value), F.lit(default))


def null_if_missing(value: Column | str) -> Column:
    """NaN becomes null; null stays null."""
    column = as_column(value)
    return F.when(~F.isnan(column), column)


def mask_missing(value: Column | str, kind: T.DataType) -> Column:
    """The value with every NaN in it null, also inside arrays, structs and maps.

    What holds no floating-point number is left as it is, so that it costs nothing.
    """
    column = as_column(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return null_if_missing(column)
    if not _floating_inside(kind):
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda item: mask_missing(item, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, item: mask_missing(item, kind.valueType))
    fields = [mask_missing(column[f.name], f.dataType).alias(f.name) for f in kind.fields]
    return F.when(column.isNotNull(), F.struct(*fields))


def _floating_inside(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _floating_inside(kind.elementType)
    if isinstance(kind, T.MapType):
        return _floating_inside(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_floating_inside(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.DoubleType, T.FloatType))
