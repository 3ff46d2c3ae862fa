"""Calendar periods: where they start, how far apart they are, and the spine they make."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from tidemark.functions.columns import as_column


@dataclass(frozen=True)
class Grain:
    """``count`` times ``unit``, the unit being ``hour``, ``day`` or ``month``.

    A period is named by its first day, or its first moment for hours. All of a grain
    follows from its unit and count, so that truncation, distance and spine agree.
    """

    name: str
    unit: str
    count: int

    def start(self, when: Column | str) -> Column:
        """The period that a date or time stamp falls in."""
        column = as_column(when)
        if self.unit == "hour":
            return F.date_trunc("hour", column).cast("timestamp_ntz")
        if self.name == "day":
            return F.to_date(column)
        return F.trunc(F.to_date(column), self.name)

    def add(self, period: Column | str, n: Column | str | int) -> Column:
        """The period ``n`` later."""
        column, steps = as_column(period), as_column(n).cast("int") * self.count
        if self.unit == "hour":
            return F.timestamp_add("HOUR", steps, column)
        return F.date_add(column, steps) if self.unit == "day" else F.add_months(column, steps)

    def between(self, first: Column | str, last: Column | str) -> Column:
        """Whole periods from ``first`` to ``last``, both starts of periods, as bigint."""
        a, b = as_column(first), as_column(last)
        if self.unit == "hour":
            steps = F.timestamp_diff("HOUR", a, b)
        elif self.unit == "day":
            steps = F.datediff(b, a)
        else:
            steps = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        if self.count > 1:
            steps = F.floor(steps / self.count)
        return steps.cast("bigint")

    def series(self, first: Column | str, last: Column | str) -> Column:
        """Array of periods from ``first`` to ``last``, both included; null if crossed."""
        lo, hi = as_column(first), as_column(last)
        return F.when(lo <= hi, F.sequence(lo, hi, F.expr(f"interval {self.count} {self.unit}")))


# Weeks begin on Monday.
GRAINS = {
    grain.name: grain
    for grain in [
        Grain("hour", "hour", 1),
        Grain("day", "day", 1),
        Grain("week", "day", 7),
        Grain("month", "month", 1),
        Grain("quarter", "month", 3),
        Grain("year", "month", 12),
    ]
}


def grain_of(grain: str | Grain) -> Grain:
    """A grain by its name."""
    if isinstance(grain, Grain):
        return grain
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {', '.join(GRAINS)}, not {grain}")
    return GRAINS[grain]
