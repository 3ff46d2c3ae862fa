"""Removal of repeated runs of lines, by prefix doubling over sequences of line ids.

A document is a sequence of line ids. As in the building of a suffix array by
prefix doubling, the class of the next ``2k`` lines from a place comes from the
classes of the ``k`` lines there and ``k`` further on; the first place of a class
names it, so names are exact and need no global sort. Classes of one member leave
at once: no longer run from there is repeated. At depth ``min_lines`` each class is
an interval of the suffix array of common prefix ``min_lines``; all its members but
the first mark their lines, and overlapping marks join to the maximal repeated
runs. Built from DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, written

MIN_LINES = 2  # a run of so many lines is repeated text whatever its length
MIN_WORDS = 40  # and so is a single line of so many words


def document_key(doc_id: Column, text: Column) -> Column:
    """Rows equal in id and text are one document."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def line_places(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``key, at, a, b, long``: every line of every document by its place, with its 128-bit hash."""
    column = docs[f"`{text}`"]
    rows = docs.where(column.isNotNull()).select(
        document_key(docs[f"`{doc_id}`"], column).alias("key"), F.posexplode(F.split(column, "\n", -1)).alias("at", "line")
    )
    words = F.regexp_count("line", F.lit(WORD))
    return rows.select(
        "key",
        "at",
        F.xxhash64("line").alias("a"),
        F.xxhash64(F.lit(7), F.col("line")).alias("b"),
        (words >= MIN_WORDS).alias("long"),
    )


def _named(places: DataFrame, a: str, b: str) -> DataFrame:
    """``places`` with ``name``: the first place of its class; classes of one member are left out."""
    first = F.min(F.struct("key", "at")).alias("name")
    classes = places.groupBy(F.col(a).alias("ca"), F.col(b).alias("cb")).agg(first, F.count("*").alias("n")).where("n > 1")
    return places.join(classes, (places[a] == classes.ca) & (places[b] == classes.cb)).drop("ca", "cb", "n")


def repeated_places(places: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``key, at, size``: the later places of repeated runs of ``size`` lines.

    ``size`` is ``min_lines``, or 1 for long lines.
    """
    named = _named(written(places, "places"), "a", "b").select("key", "at", "name", "long")
    # equal rows are one document: one place for each of its lines, or the joins below would pair them all
    named = written(named.dropDuplicates(["key", "at"]), "named")
    later = [named.where("long AND name <> struct(key, at)").select("key", "at", F.lit(1).alias("size"))]
    level, depth = named.select("key", "at", "name"), 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)  # the last windows may overlap
        ahead = level.select(
            F.col("key").alias("k2"), (F.col("at") - step).alias("at2"), F.col("name").alias("name2")
        )
        pairs = level.join(ahead, (F.col("key") == F.col("k2")) & (F.col("at") == F.col("at2")))
        pairs = written(pairs.select("key", "at", F.col("name").alias("n1"), "name2"), "pairs")
        level = _named(pairs, "n1", "name2").select("key", "at", "name")
        depth += step
    if min_lines > 1:
        later.append(level.where("name <> struct(key, at)").select("key", "at", F.lit(min_lines).alias("size")))
    else:
        later = [named.where("name <> struct(key, at)").select("key", "at", F.lit(1).alias("size"))]
    return reduce(DataFrame.unionByName, later)


def repeated_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_lines: int = MIN_LINES) -> DataFrame:
    """``key, begin, end``: the maximal runs of lines that are copies of earlier text.

    ``end`` is the line after the run. Places are ordered by document id, then by line.
    """
    marks = repeated_places(line_places(docs, text, doc_id), min_lines)
    order = Window.partitionBy("key").orderBy("at", "size")
    reach = F.max(F.col("at") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.coalesce(reach, F.lit(-1)) < F.col("at"), 1).otherwise(0)
    runs = marks.withColumn("opens", opens)
    runs = runs.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("key", "run").agg(F.min("at").alias("begin"), F.max(F.col("at") + F.col("size")).alias("end")).drop("run")


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from the text.

    A place is later than another by document id (null first), then by line. A run
    counts as repeated from ``min_lines`` lines on, and so does a single line of 40
    words. Adds ``n_lines`` and ``n_deleted`` (replacing columns so named). Null
    text stays null, with 0 lines; empty text is one empty line. Rows equal in id
    and text are one document and get the same answer. A text all of whose lines
    go becomes empty. An empty table stays empty.
    """
    keep = [c for c in docs.columns if c.lower() not in {"n_lines", "n_deleted"}]
    rows = docs.select(
        document_key(docs[f"`{doc_id}`"], docs[f"`{text}`"]).alias("key"), F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row")
    )
    runs = repeated_runs(docs, text, doc_id, min_lines)
    spans = runs.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    joined = rows.join(spans, F.col("key").eqNullSafe(F.col("k")), "left")
    column = F.col(f"row.`{text}`")
    lines = F.split(column, "\n", -1)
    gone = F.expr("flatten(transform(runs, r -> sequence(r.begin, r.end - 1)))")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    joined = joined.select("row", lines.alias("lines"), F.coalesce(gone, F.array().cast("array<int>")).alias("gone"))
    text_left = F.when(F.size("gone") == 0, column).otherwise(
        F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")
    )
    out = joined.withColumn("kept", kept)
    columns = [text_left.alias(c) if c.lower() == text.lower() else F.col(f"row.`{c}`") for c in keep]
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("bigint")
    return out.select(*columns, n_lines.alias("n_lines"), F.size("gone").cast("bigint").alias("n_deleted"))
