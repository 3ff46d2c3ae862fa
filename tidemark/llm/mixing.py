"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a circular stream of its documents in the order of a hash, cut
into blocks of equal size. The schedule has one slot per block to take: slot ``s``
has the point ``s * golden ratio mod 1``, mapped through the cumulative targets
to a source, and the slots of a source, ranked, take its blocks in turn. Slots
beyond a source's target are left out, and the few that the sequence is short of
are added at its end, so every source meets its target to a word.

Ranks and running sizes come in two steps, within a bucket and over the sums of
buckets, so no source is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, fresh, written

BLOCK = 1024  # words in a block
BUCKET_DIGITS = 4  # hex digits of the hash that name a bucket of documents
SLOTS = 1 << 16  # slots ranked in one task
GOLDEN_RATIO = 0.6180339887498949
MOST = 3  # a source gives at most so many times its size
WEIGHTS = 3  # sources weigh 1, 2, ... WEIGHTS, repeating


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` of one row per source.

    Sources are ordered by code point, null last, and weigh 1, 2, 3, repeating.
    The total is shared by weight; a target stops at three times its source's
    size and the excess is shared again: the level of the shares is the one at
    which all targets add up to the total. One task holds one row per source.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    rows = sizes.select(
        "source",
        "source_size",
        (F.col("source_size") * MOST).alias("cap"),
        F.row_number().over(ordered).alias("place"),
    ).withColumn("weight", ((F.col("place") - 1) % WEIGHTS + 1).cast("bigint"))
    whole = Window.partitionBy()
    rows = rows.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)).alias("capped"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("left_weight"),
    )
    level = (F.col("total") - F.coalesce("capped", F.lit(0))) / F.col("left_weight")
    # the level rises while sources of the least ratio are capped, and falls after that
    return rows.withColumn("level", F.max(level).over(whole)).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def _streams(docs: DataFrame) -> DataFrame:
    """``docs(key, source, size)`` with ``begin``, the words before it in its source's stream."""
    order = Window.partitionBy("source", "bucket").orderBy("hash", "key")
    docs = docs.withColumn("hash", F.md5(F.col("key").cast("string").cast("binary"))).fillna({"hash": ""})
    docs = docs.withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    buckets = docs.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("before")
    )
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    docs = docs.withColumn("inside", running)
    same = docs.source.eqNullSafe(buckets.s) & (docs.bucket == buckets.b)
    return docs.join(buckets, same).select("key", "source", "size", (F.col("inside") + F.col("before")).alias("begin"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``source, rank, slot, words``: which source's block each slot takes, in mixing order.

    ``rank`` counts a source's slots from 0; slot ``rank`` takes block ``rank mod
    blocks`` of its source, and ``words`` of it: all but for a source's last.
    """
    spark = targets.sparkSession
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    goal = F.round("target").cast("bigint")
    blocks = F.ceil(F.col("source_size") / block).cast("bigint")
    rest = goal - F.floor(goal / F.col("source_size")).cast("bigint") * F.col("source_size")
    plan = (
        targets.where("source_size > 0")
        .select(
            "source",
            "source_size",
            goal.alias("goal"),
            blocks.alias("blocks"),
            (F.floor(goal / F.col("source_size")).cast("bigint") * blocks + F.ceil(rest / block).cast("bigint")).alias("need"),
        )
        .withColumn("upto", F.sum("goal").over(order) / F.sum("goal").over(Window.partitionBy()))
        .withColumn("from", F.coalesce(F.lag("upto").over(order), F.lit(0.0)))
    )
    n_slots = plan.agg(F.sum("need")).first()[0] or 0  # one number
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN_RATIO) % 1).alias("point"), F.floor(F.col("id") / SLOTS).alias("chunk")
    )
    # one row per source: sorted cumulative targets, looked up by the point
    cuts = plan.agg(F.array_sort(F.collect_list(F.struct("from", "source", "need"))).alias("cuts"))
    cell = F.expr("element_at(filter(cuts, c -> c.from <= point), -1)")
    placed = points.crossJoin(F.broadcast(cuts)).select("slot", "chunk", cell.alias("cell"))
    placed = placed.select("slot", "chunk", "cell.source", "cell.need")
    counts = placed.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts_before = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = placed.withColumn("inside", inside).join(
        counts_before, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))
    )
    ranked = ranked.select("source", "slot", (F.col("inside") + F.col("before")).alias("rank"), "need")
    ranked = ranked.where("rank < need").drop("need")
    got = counts.groupBy("source").agg(F.sum("n").alias("got")).withColumnRenamed("source", "s")
    missing = plan.join(got, plan.source.eqNullSafe(got.s), "left").where("coalesce(got, 0) < need")
    missing = missing.select("source", F.explode(F.expr("sequence(coalesce(got, 0L), need - 1)")).alias("rank"))
    missing = missing.select("source", (F.lit(n_slots) + F.col("rank")).alias("slot"), "rank")
    slots = ranked.unionByName(missing)
    # words that a slot takes: its block's, but for the last of the source only what is left of the goal
    own = plan.select(F.col("source").alias("s"), "source_size", "goal", "blocks")
    slots = slots.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("s")))  # one row per source
    at = (F.col("rank") % F.col("blocks")) * block
    taken_before = F.floor(F.col("rank") / F.col("blocks")).cast("bigint") * F.col("source_size") + at
    words = F.least(F.lit(block), F.col("source_size") - at, F.col("goal") - taken_before)
    return slots.select("source", "slot", "rank", (F.col("rank") % F.col("blocks")).alias("block"), words.alias("words"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    ``taken`` counts the words that the scheduled blocks take of the document,
    repeats included; a document is taken at most three times as a whole. Null
    text has size 0 and null source is a source of its own, last. Documents of one
    id in one source are one document of their summed size in the mix; each row
    gets a share of its words taken, in proportion to its size, rounded down.
    An empty table gives no rows. Reruns agree.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size")
    )
    return mix_sizes(rows, block)


def mix_sizes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``mix`` over rows of ``doc_id, source, size``.

    The sizes are written once, so that texts are read and counted once.
    """
    rows = written(rows, "sizes")
    targets = written(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    docs = rows.groupBy(F.col("doc_id").alias("key"), "source").agg(F.sum("size").alias("size"))
    streams = _streams(docs)
    slots = schedule(targets, block)
    # a block is taken whole some times and at most once in part
    full = F.count("*").alias("times")
    uses = slots.groupBy("source", "block", "words").agg(full)
    uses = uses.groupBy("source", "block").agg(F.collect_list(F.struct("words", "times")).alias("uses"))
    uses = uses.select(F.col("source").alias("s"), F.col("block").alias("b"), "uses")
    last = F.when(F.col("size") > 0, F.floor((F.col("begin") + F.col("size") - 1) / block)).cast("bigint")
    pieces = streams.where("size > 0").select(
        "key", "source", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / block).cast("bigint"), last)).alias("block")
    )
    low = F.greatest(F.col("begin") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("begin") + F.col("size") - F.col("block") * block, F.lit(block))
    pieces = pieces.select("key", "source", "block", low.alias("low"), high.alias("high"))
    met = pieces.join(uses, pieces.source.eqNullSafe(uses.s) & (pieces.block == uses.b))
    words = F.expr("aggregate(uses, 0L, (a, u) -> a + u.times * greatest(0L, least(high, u.words) - low))")
    taken = met.select(F.col("key").alias("k"), F.col("source").alias("s"), words.alias("words"))
    taken = taken.groupBy("k", "s").agg(F.sum("words").alias("words"))
    streams = docs.select(F.col("key").alias("k2"), F.col("source").alias("s2"), F.col("size").alias("whole"))
    by_doc = streams.join(taken, F.col("k2").eqNullSafe(F.col("k")) & F.col("s2").eqNullSafe(F.col("s")), "left")
    by_doc = by_doc.select("k2", "s2", "whole", F.coalesce("words", F.lit(0)).alias("words"))
    out = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("k2")) & F.col("source").eqNullSafe(F.col("s2")))
    targets = targets.select(F.col("source").alias("s3"), "source_size", "target")
    out = out.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("s3")))  # one row per source
    share = F.when(F.col("whole") > 0, F.floor(F.col("words") * F.col("size") / F.col("whole"))).otherwise(0).cast("bigint")
    return out.select("doc_id", "size", "source_size", "target", share.alias("taken"))


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as the mix takes it.

    A document is repeated once for every begun multiple of its size that is
    taken, so at most three times; documents of which nothing is taken go.
    Rows without words have nothing to take and go too.
    """
    mixed = mix(docs, text, source, doc_id).where("taken > 0")
    i, times = fresh(docs, "mix_id", "mix_times")
    copies = F.least(F.ceil(F.col("taken") / F.col("size")), F.lit(MOST)).cast("int")
    # of rows that share an id, those of equal size are taken alike
    chosen = mixed.groupBy("doc_id", "size").agg(F.max(copies).alias(times)).withColumnRenamed("doc_id", i)
    size = word_count(docs[f"`{text}`"])
    out = docs.join(chosen, docs[f"`{doc_id}`"].eqNullSafe(chosen[i]) & (size == chosen["size"]))
    repeated = out.select(*[docs[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(times))
    return repeated.drop(times)


def targets_sql(sizes: str) -> str:
    """CTEs ``src`` to ``tgt(source, source_size, target, place)`` in DuckDB SQL, from a table of ``source, size``."""
    return f"""
    src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM {sizes} GROUP BY 1),
    placed AS (SELECT *, {MOST} * source_size AS cap,
                      row_number() OVER (ORDER BY source IS NULL, source) AS place FROM src),
    heavy AS (SELECT *, (place - 1) % {WEIGHTS} + 1 AS weight, sum(source_size) OVER () AS total FROM placed),
    ratio AS (SELECT *,
        coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place
                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM heavy),
    lev AS (SELECT *, CAST(total - capped AS DOUBLE) / CAST(left_weight AS DOUBLE) AS level_k FROM ratio),
    tgt AS (SELECT source, source_size, place,
                   least(CAST(cap AS DOUBLE),
                         max(level_k) OVER () * weight) AS target FROM lev)"""
