"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str | int | float) -> Column:
    """Names become columns, numbers become literals, columns stay."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def key_list(by: str | Iterable[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of aliased key columns in which null equals null."""
    tests = (F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}")) for key in keys)
    return reduce(lambda a, b: a & b, tests)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
