"""Removal of repeated byte strings: a radix sort of suffixes, no deeper than the threshold.

Only suffixes that can matter are sorted. Every window of ``window`` bytes has an
anchor, the least hashed gram in it; windows with one anchor in common are one run
of suffixes, kept as one row. Passes go from the most significant digit on:

1. by the gram at the anchor: runs alone in their group hold nothing repeated;
2. by the whole run's text: runs equal as a whole are repeated as a whole;
3. the distinct runs left in a group, by each full window: equal groups of windows
   are exactly the repeated ones.

The last pass works on a group's texts in memory; of larger groups every window
becomes a row that is counted by its hash. Equal means equal 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import (
    GOLDEN,
    byte_codes,
    cell_counts,
    cell_of,
    digest,
    mixed,
    prefix_hash,
    slices,
    span_hash,
    utf8,
    written,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 200
GRAM = 80  # bytes hashed at an anchor; less than the window
CELLS = 1 << 21  # of the pre-filter of documents
GROUP = 4096  # runs of a group compared in memory
SPANS = "key long, begin long, stop long"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from minima within blocks of ``width``."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    full = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    blocks = full.reshape(-1, width)
    onward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[:n], onward[width - 1 : width - 1 + n])


def document_keys(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A key of each row's id and text, so that rows of one id but other texts stay apart."""
    ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy().view(np.uint64)
    texts = np.array([digest(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
    return mixed(texts + mixed(ids * GOLDEN)).view(np.int64)


def runs(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, first and last window, and anchor of every run of windows with one anchor."""
    if len(data) < window:
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(len(data) - gram + 1)
    hashed = span_hash(prefix, at, at + gram)
    least = sliding_least((hashed & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), window - gram + 1)
    start = np.arange(len(least))
    inside = start + window <= np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    start, anchor = start[inside], (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(start) - 1]])
    doc = np.searchsorted(offsets, start[first], "right") - 1
    return doc, start[first], start[last], anchor[first]


def _suffix_runs(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``gram, whole, key, begin, size``: hash of the anchor's gram and of the run's
    text with its anchor's place; the first window's place and the number of windows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes()
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column("text"))
            prefix = prefix_hash(data, codes)
            keys = document_keys(part, data, offsets)
            doc, first, last, anchor = runs(data, offsets, prefix, window, gram)
            if not len(doc):
                continue
            head = span_hash(prefix, anchor, anchor + gram)
            whole = mixed(span_hash(prefix, first, last + window) + (anchor - first).astype(np.uint64) * GOLDEN)
            arrays = [head.view(np.int64), whole.view(np.int64), keys[doc], first - offsets[doc], last - first + 1]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], RUN)

    return rows.mapInArrow(find, ", ".join(f"{c} long" for c in RUN))


RUN = ["gram", "whole", "key", "begin", "size"]
GROUPED = "gram long, key long, begin long, size long, twice boolean, part boolean"


def _grouped(found: DataFrame) -> DataFrame:
    """Passes 1 and 2. Rows with ``twice`` are runs repeated as a whole; rows with
    ``part``, one per distinct run, are to be compared within their group.

    Groups pass through in order; of a group one row is held, its first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last row, whose successor is not known yet
        lead: list | None = None  # first row of the group at hand: columns, twice, order of the run
        before: tuple | None = None  # gram and whole of the row before ``held``
        order_before = 0

        def emit(columns: list[np.ndarray], following: tuple | None) -> Iterator[pa.RecordBatch]:
            nonlocal lead, before, order_before
            gram, whole = columns[0], columns[1]
            same_gram = np.append(gram[1:] == gram[:-1], following is not None and following[0] == gram[-1])
            same = same_gram & np.append(whole[1:] == whole[:-1], following is not None and following[1] == whole[-1])
            joins_gram = np.insert(same_gram[:-1], 0, before is not None and before[0] == gram[0])
            joins = np.insert(same[:-1], 0, before is not None and before == (gram[0], whole[0]))
            # order of each distinct run within its group
            new = (joins_gram & ~joins).astype(np.int64)
            opens = ~joins_gram
            total = np.cumsum(new)
            heads = np.maximum.accumulate(np.where(opens, np.arange(len(gram)), -1))
            order = np.where(heads >= 0, total - total[heads], total + order_before)
            twice = joins | same
            part = ~joins & (order > 0)
            # the first run of a group is compared too, once a second one is met
            second = np.flatnonzero(~joins & (order == 1))
            late: list[tuple] = []
            for i in second:
                if heads[i] >= 0:
                    part[heads[i]] = True
                elif lead is not None:
                    late.append(lead)
            keep = twice | part
            yield as_rows([c[keep] for c in (gram, *columns[2:])], twice[keep], part[keep])
            if late:
                yield as_rows([np.array([x[0][j] for x in late]) for j in (0, 2, 3, 4)], np.array([x[1] for x in late]), np.ones(len(late), bool))
            if heads[-1] >= 0:
                lead = ([c[heads[-1]] for c in columns], bool(twice[heads[-1]]))
            before, order_before = (gram[-1], whole[-1]), int(order[-1])

        def as_rows(columns: list[np.ndarray], twice: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns], pa.array(twice), pa.array(part)],
                ["gram", "key", "begin", "size", "twice", "part"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if len(columns[0]) > 1:
                yield from emit([c[:-1] for c in columns], (columns[0][-1], columns[1][-1]))
            held = [c[-1:] for c in columns]
        if held is not None:
            yield from emit(held, None)

    dealt = found.repartition("gram").sortWithinPartitions(*RUN)
    return dealt.select(*RUN).mapInArrow(run, GROUPED)


def _texts_of(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``key, text`` of the documents whose cell is wanted: all that are, and a few more."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column("text"))
            keys = document_keys(part, data, offsets)
            chosen = pa.RecordBatch.from_arrays([pa.array(keys), part.column("text")], ["key", "text"])
            yield chosen.filter(pa.array(wanted[cell_of(keys, CELLS)]))

    return rows.mapInArrow(pick, "key long, text string")


def _compared(parts: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """Pass 3: ``key, begin, stop`` of repeated windows, and of large groups each window's ``hash``."""
    mine = parts.groupBy("key").agg(F.collect_list(F.struct("gram", "begin", "size", "twice")).alias("runs"))
    joined = mine.join(texts.dropDuplicates(["key"]), "key").select("key", "runs", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column("text"))
            listed = part.column("runs")
            owner = np.repeat(np.arange(part.num_rows), np.diff(listed.offsets.to_numpy()))
            inner = listed.flatten()
            gram, begin, size, twice = (inner.field(i) for i in range(4))
            first = offsets[owner] + begin.to_numpy()
            bodies = [data[a:b].tobytes() for a, b in zip(first, first + size.to_numpy() + window - 1, strict=True)]
            arrays = [gram, pa.array(part.column("key").to_numpy()[owner]), begin, twice, pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["gram", "key", "begin", "twice", "body"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes()

        def windows(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
            sizes = np.array([len(r[4]) for r in rows])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            counts = sizes - window + 1
            owner = np.repeat(np.arange(len(rows)), counts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            first = offsets[owner] + place
            return owner, place, span_hash(prefix_hash(data, codes), first, first + window)

        def spans(rows: list[tuple]) -> pa.RecordBatch:
            owner, place, hashed = windows(rows)
            _, inverse, counts = np.unique(hashed, return_inverse=True, return_counts=True)
            found = counts[inverse] > 1
            owner, place = owner[found], place[found]
            cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(place) != 1)) + 1
            first = np.concatenate([[0], cut])[: len(owner)].astype(np.int64)
            last = np.concatenate([cut - 1, [len(owner) - 1]])[: len(owner)].astype(np.int64)
            begin = np.array([r[2] for r in rows])
            key = np.array([r[1] for r in rows])
            arrays = [key[owner[first]], begin[owner[first]] + place[first], begin[owner[first]] + place[last] + window]
            return pa.RecordBatch.from_arrays([*[pa.array(a, pa.int64()) for a in arrays], pa.nulls(len(first), pa.int64())], FOUND)

        def single(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 512):
                some = rows[i : i + 512]
                owner, place, hashed = windows(some)
                begin = np.array([r[2] for r in some])[owner] + place
                arrays = [np.array([r[1] for r in some])[owner], begin, begin + window, hashed.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], FOUND)

        done: list[tuple] = []  # whole groups
        group: list[tuple] = []
        large = False
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and row[0] != group[-1][0]:
                    if large:
                        yield from single(group)
                    else:
                        done += group
                        if len(done) >= GROUP:
                            yield spans(done)
                            done = []
                    group, large = [], False
                group.append(row)
                if len(group) >= GROUP:
                    large = True
                    yield from single(group[:-1])
                    group = group[-1:]
        if large:
            yield from single(group)
        else:
            done += group
        if done:
            yield spans(done)

    bodies = joined.mapInArrow(cut, "gram long, key long, begin long, twice boolean, body binary")
    dealt = bodies.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(compare, f"{SPANS}, hash long")


FOUND = ["key", "begin", "stop", "hash"]


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``key, begin, stop``: byte spans made of repeated windows; they may overlap."""
    rows = _rows(docs, text, doc_id)
    grouped = written(_grouped(_suffix_runs(rows, window, gram)), "grouped")
    whole = grouped.where("twice").select("key", "begin", (F.col("begin") + F.col("size") + (window - 1)).alias("stop"))
    parts = grouped.where("part").select("gram", "key", "begin", "size", "twice")
    texts = _texts_of(rows, cell_counts(parts.select("key"), CELLS) > 0)
    found = written(_compared(parts, texts, window), "found")
    single = found.where("hash IS NOT NULL")
    often = single.groupBy(F.col("hash").alias("h")).agg(F.count("*").alias("n")).where("n > 1")
    single = single.join(often, F.col("hash") == F.col("h")).select("key", "begin", "stop")
    return whole.unionByName(found.where("hash IS NULL").drop("hash")).unionByName(single)


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def without_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id", keep_text: bool = True
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept``.

    Texts are UTF-8 bytes, null is empty. Every byte covered by a string of
    ``window`` bytes that also starts anywhere else, in the same document too, is
    removed, judged on the input; matches never cross documents. ``n_spans`` counts
    the maximal removed runs; ``kept`` has the bytes left, joined, bytes that are no
    UTF-8 any more as U+FFFD. Rows of one id are documents of their own, and equal
    rows repeat each other. An empty table gives no rows.
    """
    if not 0 < gram < window < 256:
        raise ValueError("0 < gram < window < 256 is needed")
    rows = _rows(docs, text, doc_id)
    spans = written(repeated_spans(docs, window, gram, text, doc_id), "spans")
    touched = cell_counts(spans.select("key"), CELLS) > 0

    def report(part: pa.RecordBatch, covers: list[tuple[np.ndarray, np.ndarray] | None]) -> pa.RecordBatch:
        data, offsets = utf8(part.column("text"))
        out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for i, cover in enumerate(covers):
            body = data[offsets[i] : offsets[i + 1]]
            removed = n_spans = 0
            if cover is not None:
                depth = np.zeros(len(body) + 1, np.int64)
                np.add.at(depth, cover[0], 1)
                np.add.at(depth, cover[1], -1)
                gone = np.cumsum(depth)[:-1] > 0
                removed = int(gone.sum())
                n_spans = int(np.count_nonzero(gone & ~np.insert(gone[:-1], 0, False)))
                kept = body[~gone].tobytes()
            else:
                kept = body.tobytes()
            row = (len(body), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None)
            for values, value in zip(out.values(), row, strict=True):
                values.append(value)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *[pa.array(v, t) for v, t in zip(out.values(), REPORT_TYPES, strict=True)]],
            ["doc_id", *out],
        )

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column("text"))
            keys = document_keys(part, data, offsets)
            rest = part.filter(pa.array(~touched[cell_of(keys, CELLS)]))
            yield report(rest, [None] * rest.num_rows)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column("text"))
            keys = document_keys(part, data, offsets)
            named = pa.RecordBatch.from_arrays([pa.array(keys), *part.columns], ["key", "doc_id", "text"])
            yield named.filter(pa.array(touched[cell_of(keys, CELLS)]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            covers = []
            for span in part.column("spans"):
                inner = span.values if span.is_valid else None
                covers.append(None if inner is None else tuple(inner.field(i).to_numpy() for i in (0, 1)))
            yield report(part.select(["doc_id", "text"]), covers)

    gathered = spans.groupBy("key").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))
    maybe = rows.mapInArrow(keyed, "key long, doc_id long, text string").join(gathered, "key", "left")
    changed = maybe.select("doc_id", "text", "spans").mapInArrow(cut, REPORT)
    return rows.mapInArrow(untouched, REPORT).unionByName(changed)


REPORT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
