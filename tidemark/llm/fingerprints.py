"""SimHash fingerprints and their search by permuted block tables.

The terms of a text are its runs of five words, A-Z in lower case, each weighing
as often as it occurs. Every term's hash votes on 256 signed sums; the signs are
the fingerprint. Two fingerprints within a Hamming radius of ``r`` agree on one of
``r + 1`` blocks of bits, so one table per block, keyed by it, finds all of them.
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

from tidemark.llm.common import GOLDEN, mixed, shingles, slices, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 256
WORDS = 5
BUCKET_ROWS = 1024  # documents of a bucket of neighbouring ids, while there are at most MOST_BUCKETS
MOST_BUCKETS = 20_000  # bounds what the driver holds: one number and one id for each


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> np.ndarray:
    """``BITS / 8`` bytes for each text. A text without words has no votes: all bits are 0."""
    terms, owner = shingles(data, offsets, words)
    n = len(offsets) - 1
    sign = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
    votes = np.zeros((n, BITS))
    lanes = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * GOLDEN
    for lane in range(BITS // 64):
        raw = mixed(terms + lanes[lane]).view(np.uint8).reshape(-1, 8)
        for i in range(8):
            tally = np.bincount(owner * 256 + raw[:, i], minlength=n * 256).reshape(n, 256)
            at = lane * 64 + i * 8
            votes[:, at : at + 8] = tally @ sign
    return np.packbits(votes > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=-1) / BITS


def fingerprint(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with ``fingerprint`` in hex. Null text is empty text; equal texts have
    equal fingerprints. A column of that name is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            codes = pa.array([x.tobytes().hex() for x in fingerprints(*utf8(part.column("text")), words)])
            yield pa.RecordBatch.from_arrays([part.column("row"), codes], ["row", "fingerprint"])

    keep = [docs[f"`{c}`"] for c in docs.columns if c.lower() != "fingerprint"]
    rows = docs.select(docs[f"`{text}`"].cast("string").alias("text"), F.struct(*keep).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, fingerprint string").select("row.*", "fingerprint")


def classes(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per distinct fingerprint: ``fingerprint, class_id`` (its smallest id) and ``n_rows``."""
    return prints.groupBy("fingerprint").agg(F.min(f"`{doc_id}`").alias("class_id"), F.count("*").alias("n_rows"))


def within_radius(prints: DataFrame, radius: int, doc_id: str = "doc_id") -> DataFrame:
    """All pairs of classes whose fingerprints differ in 1 to ``radius`` bits:
    ``left_id, right_id, distance``, with ``left_id < right_id``.

    Copies share a class and are never paired. Each of ``radius + 1`` tables is
    keyed by one block of bits and its value; the tables are one shuffle, and a
    pair is taken from the first block it agrees on, so it is found once.
    """
    if not 0 < radius < BITS // 4:
        raise ValueError(f"radius must be from 1 to {BITS // 4 - 1}")
    digits = BITS // 4
    cuts = [i * digits // (radius + 1) for i in range(radius + 2)]
    blocks = F.array(*[F.substring("fingerprint", a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)])
    rows = classes(prints, doc_id).select("class_id", blocks.alias("blocks"), _lanes("fingerprint").alias("lanes"))
    rows = rows.select("class_id", "blocks", "lanes", F.posexplode("blocks").alias("block", "value"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.value") == F.col("b.value")))
    met = met.where("a.class_id < b.class_id").where(
        "NOT exists(sequence(0, a.block), i -> i < a.block AND a.blocks[i] = b.blocks[i])"
    )
    distance = F.expr("aggregate(zip_with(a.lanes, b.lanes, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    pairs = met.select(F.col("a.class_id").alias("left_id"), F.col("b.class_id").alias("right_id"), distance.alias("distance"))
    return pairs.where(F.col("distance") <= radius)


def _lanes(column: str):
    parts = [F.conv(F.substring(column, i * 16 + 1, 16), 16, -10).cast("bigint") for i in range(BITS // 64)]
    return F.array(*parts)


def edited_likeness(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how like they are.

    The edited text has its last ``n_chars // 2`` code points replaced by the
    first as many (or all) of the next document by descending id; after the last
    comes the first. ``near_edited`` and ``near_next`` are the shares of bits in
    which the fingerprint equals the edited text's and the next document's.
    Null text is empty; null ids come last; rows of one id are ordered by text;
    a single row is its own next. An empty table gives no rows.

    Documents are dealt into buckets of neighbouring ids by approximate quantiles
    and read in order, one after the other; the first document of a bucket also
    goes to the end of the bucket before it. Texts are shuffled once.
    """
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    n_buckets = max(1, min(MOST_BUCKETS, rows.count() // BUCKET_ROWS))
    steps = [i / n_buckets for i in range(1, n_buckets)]
    found = rows.approxQuantile("doc_id", steps, 0.2 / n_buckets) if steps else []
    edges = np.array(sorted(set(found)), np.float64)

    def bucket_of(ids: pa.Array) -> np.ndarray:
        lowest = np.iinfo(np.int64).min
        return np.searchsorted(edges, ids.fill_null(lowest).to_numpy().astype(np.float64))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = {"bucket": bucket_of(batch.column(0)), "doc_id": batch.column(0)}
            best = pa.table(pairs).group_by("bucket").aggregate([("doc_id", "max")])
            yield from best.select(["bucket", "doc_id_max"]).rename_columns(["bucket", "top"]).to_batches()

    heads = rows.select("doc_id").mapInArrow(tops, "bucket long, top long").groupBy("bucket").agg(F.max("top"))
    top = sorted(tuple(r) for r in heads.collect())  # one row per bucket
    # the head of each bucket is the next of the last in the bucket above; the very first, of the very last
    goes = {b: top[(i + 1) % len(top)][0] for i, (b, _) in enumerate(top)}
    head = dict(top)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = bucket_of(batch.column("doc_id"))
            ids = batch.column("doc_id").to_pylist()
            extra = [i for i, (b, x) in enumerate(zip(bucket.tolist(), ids, strict=True)) if head[b] == x]
            for at, flag, to in (
                (range(len(ids)), False, bucket.tolist()),
                (extra, True, [goes[bucket[i]] for i in extra]),
            ):
                if len(to):
                    part = batch.take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to, pa.int64()), pa.array([flag] * len(to)), *part.columns],
                        ["bucket", "extra", "doc_id", "text"],
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for part in slices(batches, "text"):
            prints = fingerprints(*utf8(part.column("text")), words)
            texts = [t or "" for t in part.column("text").to_pylist()]
            block = list(zip(part.column("doc_id").to_pylist(), part.column("extra").to_pylist(), texts, prints, strict=True))
            line = [held, *block] if held else block
            held = line[-1]
            pairs = [(a, b) for a, b in zip(line, line[1:], strict=False) if not a[1]]
            if pairs:
                yield edited_rows(pairs, words)

    dealt = rows.mapInArrow(deal, "bucket long, extra boolean, doc_id long, text string").repartition("bucket")
    order = ["bucket", "extra", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text")]
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.sortWithinPartitions(*order).mapInArrow(run, kinds)


def edited_rows(pairs: list[tuple], words: int) -> pa.RecordBatch:
    """Result rows of (document, next) pairs of (id, flag, text, fingerprint)."""
    edited = []
    for (_, _, text, _), (_, _, following, _) in pairs:
        half = len(text) // 2
        edited.append(text[: len(text) - half] + following[:half])
    own = np.array([a[3] for a, _ in pairs])
    changed = fingerprints(*utf8(pa.array(edited)), words)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([a[0] for a, _ in pairs], pa.int64()),
            "n_chars": [len(a[2]) for a, _ in pairs],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": [x.tobytes().hex() for x in own],
            "edited_fingerprint": [x.tobytes().hex() for x in changed],
            "near_edited": likeness(own, changed),
            "near_next": likeness(own, np.array([b[3] for _, b in pairs])),
        }
    )
