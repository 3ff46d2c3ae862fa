"""Helpers shared by the operators: names, shared folder, text kernels for Arrow batches.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Kernels work on the UTF-8 bytes of many
texts at once, so a batch costs a few numpy passes and no loop over its rows.
"""

from __future__ import annotations

import gc
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import staging

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20  # text handled at once by a kernel; a longer text is handled alone

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# 2^64 divided by the golden ratio, and the two multipliers of the splitmix64 finaliser.
GOLDEN, MIX_1, MIX_2 = (
    np.uint64(0x9E3779B97F4A7C15),
    np.uint64(0xBF58476D1CE4E5B9),
    np.uint64(0x94D049BB133111EB),
)


# --- frames -----------------------------------------------------------------------


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The row as one struct ``row``, beside ``columns``: names of ``df`` cannot clash then."""
    return df.select(*[c.alias(n) for n, c in columns.items()], F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the folder that all executors share, read again: a cut in the
    lineage that outlives executors."""
    out = staging.written(df, name)
    gc.collect()  # Java objects are held in reference cycles of Python, and their shuffles with them
    df.sparkSession._jvm.System.gc()  # lets Spark delete the shuffle files that nothing reads any more
    return out


# --- Arrow batches ----------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) and the offsets of each."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: int | str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``most`` bytes of text; every row stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(text))
        block, begin = offsets[:-1] // most, 0
        for end in [*(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]:
            yield batch.slice(begin, end - begin)
            begin = end


CHUNK_CELLS = 4096


def cell_counts(values: DataFrame, cells: int) -> np.ndarray:
    """How many of the longs of ``values`` fall in each of ``cells`` hash cells.

    A table of fixed size, whatever the input: every task counts on its own, the
    counts are added chunk by chunk, and the sums (at most 65,535 each) come to the
    driver. It only ever says "at most so often", so it may order or pre-filter,
    but not decide.
    """
    if cells % CHUNK_CELLS:
        raise ValueError(f"cells must be a multiple of {CHUNK_CELLS}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cell_rows((b.column(0).to_numpy(zero_copy_only=False) for b in batches), cells)

    return added_cells(values.mapInArrow(count, CELL_ROW), cells)


CELL_ROW = "chunk int, counts binary"


def cell_of(values: np.ndarray, cells: int) -> np.ndarray:
    return (mixed(values.view(np.uint64)) % np.uint64(cells)).astype(np.int64)


def cell_rows(arrays: Iterator[np.ndarray], cells: int) -> Iterator[pa.RecordBatch]:
    """One task's counts, as rows of chunks that are not all zero."""
    total = np.zeros(cells, np.int64)
    for values in arrays:
        total += np.bincount(cell_of(values, cells), minlength=cells)
    table = np.minimum(total, 65535).astype(np.uint16).reshape(-1, CHUNK_CELLS)
    used = np.flatnonzero(table.any(axis=1))
    if len(used):
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([table[i].tobytes() for i in used])], ["chunk", "counts"]
        )


def added_cells(rows: DataFrame, cells: int) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # at most cells / CHUNK_CELLS arrays
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(chunk, np.zeros(CHUNK_CELLS, np.int64))
                total[chunk] += np.frombuffer(counts, np.uint16)
        if total:
            counts = [np.minimum(t, 65535).astype(np.uint16).tobytes() for t in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(counts)], ["chunk", "counts"])

    out = np.zeros((cells // CHUNK_CELLS, CHUNK_CELLS), np.uint16)
    for chunk, counts in rows.repartition("chunk").mapInArrow(add, CELL_ROW).collect():
        out[chunk] = np.frombuffer(counts, np.uint16)
    return out.reshape(-1)


# --- hashing ----------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


def byte_codes() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


HASH_BASE = 0x5851F42D4C957F2D  # odd, hence invertible modulo 2^64
HASH_INVERSE = pow(HASH_BASE, -1, 1 << 64)


LONG_SPAN = 256  # bytes; a polynomial modulo 2^64 is safe well below 1,024 places, not beyond


def digest(data: np.ndarray) -> np.uint64:
    """64-bit hash of bytes for long spans, where other texts could meet in one polynomial
    hash by their pattern alone, as Thue-Morse words do."""
    return np.frombuffer(hashlib.blake2b(data.tobytes(), digest_size=8).digest(), np.uint64)[0]


def prefix_hash(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` takes any span from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers(HASH_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span by its content alone."""
    inverse = powers(HASH_INVERSE, len(prefix))
    return mixed((prefix[end] - prefix[begin]) * inverse[begin])


# --- words and shingles -----------------------------------------------------------


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of every word."""
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``words`` words, A-Z in lower case, in
    order; a text of fewer words gives its whole sequence as one."""
    data = LOWER[data]
    begin, end, doc = word_spans(data, offsets)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = span_hash(prefix_hash(data, byte_codes()), begin, end)
    for i in np.flatnonzero(end - begin > LONG_SPAN):
        word[i] = digest(data[begin[i] : end[i]])
    # sums over a window of words, each word times a power: one more polynomial hash
    prefix = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * powers(HASH_BASE, len(word)), out=prefix[1:])
    n_docs = len(offsets) - 1
    counts = np.bincount(doc, minlength=n_docs)
    heads = np.concatenate([[0], np.cumsum(counts)])[:-1]
    short = np.flatnonzero((counts > 0) & (counts < words))
    at = np.arange(max(0, len(word) - words + 1))
    at = at[doc[at] == doc[at + words - 1]]
    starts = np.concatenate([at, heads[short]])
    stops = np.concatenate([at + words, heads[short] + counts[short]])
    owners = np.concatenate([doc[at], short])
    order = np.argsort(starts, kind="stable")
    starts, stops, owners = starts[order], stops[order], owners[order]
    return mixed(span_hash(prefix, starts, stops) + (stops - starts).astype(np.uint64) * GOLDEN), owners
