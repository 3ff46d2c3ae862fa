"""Array and map functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def zip_vectors(*names: str) -> Column:
    """Parallel array columns as one array of structs, matched by position."""
    return F.arrays_zip(*names)


def record_map(names: Sequence[str]) -> Column:
    """A row as a map of column name to value text (maps need one value type)."""
    return F.map_from_arrays(
        F.array(*[F.lit(name) for name in names]),
        F.array(*[F.col(name).cast("string") for name in names]),
    )
