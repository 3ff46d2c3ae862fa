"""Typed extraction that fails instead of guessing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tidemark.functions.columns import bind

# Accepted column types for each requested kind.
ACCEPTED = {
    "boolean": (T.BooleanType,),
    "number": (T.BooleanType, T.NumericType),
    "string": (T.StringType,),
}
RESULT = {"boolean": "boolean", "number": "double", "string": "string"}


def strict_cast(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Cast the named columns to ``boolean``, ``number`` or ``string``, or to vectors of
    these: ``boolean[]``, ``number[]``, ``string[]``.

    A column of another kind raises at once; only booleans may stand in for
    numbers, and a vector kind takes arrays only. A null, or an integer or decimal that
    a double cannot hold, fails the job. So does a vector that is null or has such an
    element, or a NaN, which counts as missing there; the message names the first
    failing position, from 1. Empty vectors are kept.
    """
    return df.withColumns({name: _strict(df, name, kind) for name, kind in kinds.items()})


def _strict(df: DataFrame, name: str, kind: str) -> Column:
    scalar, found = kind.removesuffix("[]"), df.schema[name].dataType
    if scalar not in ACCEPTED:
        raise ValueError(f"unknown kind {kind}")
    element = found.elementType if kind != scalar and isinstance(found, T.ArrayType) else found
    if not isinstance(element, ACCEPTED[scalar]) or (kind != scalar and element is found):
        raise TypeError(f"cannot convert {name} of type {found.simpleString()} to {kind}")
    if kind != scalar:
        return _strict_vector(name, kind, element)
    failure = F.raise_error(f"cannot convert a value of {name} to {kind}").cast(RESULT[kind])
    return F.when(_unfit(F.col(name), found, kind), failure).otherwise(F.col(name).cast(RESULT[kind]))


def _unfit(value: Column, found: T.DataType, kind: str) -> Column:
    """Whether a value is null, or a number that a double cannot hold."""
    bad = value.isNull()
    if kind == "number" and isinstance(found, T.LongType):
        bad = bad | (value.cast("double").cast("decimal(20,0)") != value.cast("decimal(20,0)"))
    if kind == "number" and isinstance(found, T.DecimalType):
        bad = bad | ~value.eqNullSafe(value.cast("double").try_cast(found))
    return bad


def _strict_vector(name: str, kind: str, element: T.DataType) -> Column:
    scalar, result = kind.removesuffix("[]"), f"array<{RESULT[kind.removesuffix('[]')]}>"

    def unfit(value: Column) -> Column:
        bad = _unfit(value, element, scalar)
        return bad | F.isnan(value) if isinstance(element, (T.DoubleType, T.FloatType)) else bad

    def checked(position: Column) -> Column:
        null = F.raise_error(f"cannot convert a null of {name} to {kind}").cast(result)
        text = F.format_string(f"cannot convert {name} to {kind}: element %d", position)
        return (
            F.when(position.isNull(), null)
            .when(position > 0, F.raise_error(text).cast(result))
            .otherwise(F.col(name).cast(result))
        )

    return bind(F.array_position(F.transform(name, unfit), F.lit(True)), checked)
