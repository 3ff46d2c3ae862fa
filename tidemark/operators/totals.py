"""Running totals, by series and by row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tidemark.functions.columns import as_column, key_list, same_keys
from tidemark.functions.dates import days_between

SAMPLED_BITS = 6  # rows whose hash ends in so many zeros may be sampled
CELLS_PER_BUCKET = 64  # positions sampled, at most


def running_total(
    series: DataFrame,
    value: str = "daily_count",
    by: str | Sequence[str] | None = None,
    order: str = "date",
    out: str = "running_cumulative_sum",
) -> DataFrame:
    """Add the running total of ``value`` along each key's dates.

    For series of at most one row per key and day, so that a key has no more
    rows than its calendar has days. Use ``running_total_rows`` on raw events.
    """
    frame = (
        Window.partitionBy(*key_list(by))
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return series.withColumn(out, F.sum(value).over(frame))


def days_elapsed(
    series: DataFrame, by: str | Sequence[str] | None = None, order: str = "date"
) -> DataFrame:
    """Add the whole days since the first date of each key, as bigint."""
    first = F.min(order).over(Window.partitionBy(*key_list(by)))
    return series.withColumn("days_elapsed", days_between(first, order))


def running_total_rows(
    df: DataFrame,
    value: Column | str,
    order_by: str | Sequence[str],
    by: str | Sequence[str] | None = None,
    out: str = "running_total",
    buckets: int | None = None,
    peers: bool = False,
) -> DataFrame:
    """Running total over raw rows, ``order_by`` being unique within a key.

    With ``peers`` it need not be: rows that tie get the total up to and with all
    of them, which is SQL's default frame. Ties are then summed up before the
    totals are taken and the totals joined back, so that a tie of any size is one
    row until then; the join is left to Spark, which splits a skewed side.

    A plain window would sort all rows of a key, or without keys the whole
    table, in one task. Here rows go to buckets that are ranges of
    (key, order), each bucket gets a running sum of its own, and what the same
    key summed up in earlier buckets is added. A hot key is thus spread over as
    many buckets as its size asks for.

    The source is read twice: once, of few columns, for a sample of positions from
    which split points are taken, and once for the rows. These are shuffled by
    bucket; running sums and the sums of buckets both come from the shuffled rows.
    With ``peers`` the rows that the totals are joined back to are a third read. The
    split points live in the plan, so a lost task gives its rows the same buckets
    again and nothing is cached or checkpointed. Nulls sort last.
    """
    keys, order = key_list(by), key_list(order_by)
    if peers:
        position = [*keys, *order]
        ties = df.groupBy(*position).agg(F.sum(as_column(value)).alias("_tied"))
        totals = _totals(ties, df, "_tied", keys, order, out, buckets)
        on = same_keys("rows", "totals", position)
        joined = df.alias("rows").join(totals.alias("totals"), on)
        return joined.select(*[F.col(f"rows.{c}") for c in df.columns], F.col(f"totals.{out}"))
    return _totals(df, df, value, keys, order, out, buckets)


def _totals(
    df: DataFrame,
    sampled: DataFrame,
    value: Column | str,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    buckets: int | None,
) -> DataFrame:
    """Totals of ``df``; split points come from the positions of ``sampled``."""
    if buckets is None:
        buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits = _split_points(sampled, [*keys, *order], buckets)
    placed = _with_bucket(df.withColumn("_value", as_column(value)), [*keys, *order], splits, buckets)
    dealt = placed.repartitionById(buckets + 1, F.col("_bucket"))

    # every column is used here too, or the optimizer would prune this exchange and
    # so read and shuffle the source once more; the test is always true
    sums = dealt.groupBy("_bucket", *keys).agg(F.sum("_value").alias("_sum"), *_uses(dealt))
    sums = sums.where("_used >= 0 AND _hash IS NOT NULL")
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.sum("_sum").over(earlier)).where("_offset IS NOT NULL")
    # ranges are in key order: only the key that opens a bucket can have earlier
    # rows, so there are fewer offsets than buckets and they can be broadcast
    offsets = F.broadcast(offsets.select("_bucket", *keys, "_offset"))

    along = (
        Window.partitionBy("_bucket", *keys)
        .orderBy(*[F.col(c).asc_nulls_last() for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = dealt.withColumn("_local", F.sum("_value").over(along))
    on = same_keys("rows", "offsets", ["_bucket", *keys])
    total = F.when(F.col("_offset").isNull(), F.col("_local")).otherwise(
        F.coalesce(F.col("_local"), F.lit(0)) + F.col("_offset")
    )
    kept = [c for c in df.columns if c != "_tied"]
    return (
        local.alias("rows")
        .join(offsets.alias("offsets"), on, "left")
        .select(*[F.col(f"rows.{c}") for c in kept], total.alias(out))
    )


def _uses(df: DataFrame) -> list[Column]:
    """Aggregates that need every column: counts of those that may be null, a hash of the others."""
    nullable = [F.count(F.col(f.name)) for f in df.schema if f.nullable]
    fixed = [F.col(f.name) for f in df.schema if not f.nullable]
    used = nullable[0] if nullable else F.lit(0)
    for column in nullable[1:]:
        used = used + column
    return [used.alias("_used"), F.bit_xor(F.xxhash64(*fixed, F.lit(0))).alias("_hash")]


def _position(names: Sequence[str]) -> Column:
    """Key and order columns as one sortable value; the flags put nulls after values."""
    return F.struct(*[c.alias(f"p{i}") for i, n in enumerate(names) for c in (F.col(n).isNull(), F.col(n))])


def _split_points(df: DataFrame, names: Sequence[str], buckets: int) -> Column:
    """Sorted positions that cut the rows into ``buckets`` + 1 parts of about equal size.

    A mergeable sample that comes with its counts in one aggregate: rows chosen by the
    last bits of their hash fall into cells, and a cell keeps its position of least hash
    and how many rows it has seen. A task sends at most a row per cell, and the cells
    are bounded by the buckets, whatever the size of the source.
    """
    rows = df.select(F.xxhash64(*names).alias("hash"), _position(names).alias("position"))
    rows = rows.where(F.col("hash").bitwiseAND(F.lit((1 << SAMPLED_BITS) - 1)) == 0)
    cell = F.pmod(F.shiftright("hash", SAMPLED_BITS), F.lit(buckets * CELLS_PER_BUCKET)).alias("cell")
    cells = rows.groupBy(cell).agg(
        F.min(F.struct("hash", "position"))["position"].alias("position"), F.count(F.lit(1)).alias("weight")
    )
    upto = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = (F.sum("weight").over(upto) - F.col("weight")) / F.sum("weight").over(Window.partitionBy())
    part = F.floor(share * (buckets + 1)).alias("part")
    cuts = cells.select("position", part).where("part > 0").groupBy("part").agg(F.min("position").alias("cut"))
    return cuts.agg(F.array_distinct(F.sort_array(F.collect_list("cut")))).scalar()


def _with_bucket(df: DataFrame, names: Sequence[str], splits: Column, buckets: int) -> DataFrame:
    """Add ``_bucket``: how many split points are at or before the row's position."""
    # binary search in the split array, one halving step per projection
    rows = df.withColumns({"_bucket": F.lit(0), "_position": _position(names)})
    for exponent in reversed(range(math.floor(math.log2(buckets)) + 1)):
        step = 1 << exponent
        probe = F.get(splits, F.col("_bucket") + (step - 1))
        rows = rows.withColumn(
            "_bucket", F.col("_bucket") + F.when(probe <= F.col("_position"), step).otherwise(0)
        )
    return rows.drop("_position")
