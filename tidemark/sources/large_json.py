"""One large JSON document read by many tasks.

A document of many lines is one task to Spark's JSON reader. Here the file is cut into
byte ranges. Where a range begins, nothing tells a quote that opens a string from one
that closes it, so a first pass sums up each range for every state it may begin in:
the state it ends in and how it changes the nesting. Chained from the start of the
file, the summaries give the true state of each range, and a second pass takes the
array elements that begin in it, each from its own border.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 16 << 20
AHEAD = 1 << 16  # bytes that a field's name, colon and bracket may take
MORE = 1 << 20  # bytes read at once behind a range, for the element that reaches over its end
ROWS = 2048
QUOTE, BACKSLASH, OPEN, CLOSE = ord('"'), ord("\\"), (ord("{"), ord("[")), (ord("}"), ord("]"))
SUMMARY = "file int, at long, ends string, fields string"


# --- structure of a piece of JSON ---------------------------------------------------


@dataclass(frozen=True)
class State:
    """Of a byte: is it within a string, and is the run of backslashes before it odd?"""

    in_string: bool = False
    odd: bool = False


STATES = [State(s, o) for s in (False, True) for o in (False, True)]


def structure(data: np.ndarray, state: State) -> tuple[np.ndarray, np.ndarray, State, np.ndarray]:
    """Brackets outside strings and how each changes the depth; the state after the last
    byte; places of the quotes that open or close strings."""
    quotes = np.flatnonzero(data == QUOTE)
    run = np.zeros(len(quotes), np.int64)  # backslashes before each quote
    live = np.arange(len(quotes))
    step = 1
    while len(live):
        at = quotes[live] - step
        live = live[(at >= 0) & (data[np.maximum(at, 0)] == BACKSLASH)]
        run[live] += 1
        step += 1
    run += state.odd & (run == quotes)  # the run began before the first byte
    quotes = quotes[run % 2 == 0]
    brackets = np.flatnonzero(np.isin(data, (*OPEN, *CLOSE)))
    inside = (np.searchsorted(quotes, brackets) + state.in_string) % 2 == 1
    brackets = brackets[~inside]
    change = np.where(np.isin(data[brackets], OPEN), 1, -1)
    other = np.flatnonzero(data[::-1] != BACKSLASH)
    tail = int(other[0]) if len(other) else len(data)
    odd = (tail + (state.odd if tail == len(data) else 0)) % 2 == 1
    return brackets, change, State(bool((len(quotes) + state.in_string) % 2), bool(odd)), quotes


def opened_file(path: str) -> pa.NativeFile:
    uri = re.sub(r"^file:/+", "file:///", path)
    files, place = pafs.FileSystem.from_uri(uri)
    return files.open_input_file(place)


def bytes_of(file: pa.NativeFile, begin: int, end: int) -> np.ndarray:
    return np.frombuffer(file.read_at(end - begin, begin), np.uint8)


# --- first pass: what each range does -------------------------------------------------


def summary(file: pa.NativeFile, size: int, begin: int, end: int, field: str) -> tuple[list, list]:
    """For each state the range may begin in, how it ends: that state, the change of
    depth, and its least depth; and where ``field`` may open an array, at what depth,
    and the least depth behind it."""
    whole = bytes_of(file, begin, min(end + AHEAD, size))
    data = whole[: end - begin]
    pattern = re.compile(re.escape(json.dumps(field, ensure_ascii=False).encode()) + rb"\s*:\s*\[")
    found = [(m.start(), m.end() - 1) for m in pattern.finditer(whole.tobytes()) if m.start() < len(data)]
    ends, fields = [], [[] for _ in found]
    for state in STATES:
        brackets, change, after, quotes = structure(data, state)
        depth = np.cumsum(change)
        ends.append([after.in_string, after.odd, int(depth[-1]) if len(depth) else 0, int(depth.min(initial=0))])
        for row, (name, bracket) in zip(fields, found, strict=True):
            at = int(np.searchsorted(brackets, name))
            opens = bool((np.searchsorted(quotes, name) + state.in_string) % 2 == 0) and name in quotes
            before = int(depth[at - 1]) if at else 0
            behind = depth[np.searchsorted(brackets, bracket, "right") :]
            row.append([begin + bracket, opens, before, int(behind.min(initial=before + 1))])
    return ends, fields


def chained(summaries: Sequence[tuple[int, list, list]]) -> list[dict]:
    """The true state and depth at the start of each range of one file, in order, and
    between which bytes the wanted array lies, as far as the range can tell."""
    state, depth, opened = State(), 0, None
    out = []
    for begin, ends, fields in summaries:
        which = STATES.index(state)
        in_string, odd, change, least = ends[which]
        closed = opened is not None and opened < begin and depth + least < 2
        for row in fields:
            bracket, opens, before, least_behind = row[which]
            if opens and depth + before == 1:
                opened, closed = bracket, depth + least_behind < 2
        out.append({"begin": begin, "in_string": state.in_string, "odd": state.odd, "depth": depth, "opened": opened})
        if closed:  # the array ends in this range
            opened = None
        state, depth = State(in_string, odd), depth + change
    if depth or state.in_string:
        raise ValueError("malformed JSON: the document does not end")
    return out


# --- second pass: elements ------------------------------------------------------------


def elements(file: pa.NativeFile, size: int, begin: int, end: int, start: dict) -> Iterator[str | None]:
    """The texts of the array elements that begin within the range; null for null."""
    data = bytes_of(file, begin, end)
    brackets, change, after, _ = structure(data, State(start["in_string"], start["odd"]))
    depth = start["depth"] + np.cumsum(change)
    first = max(start["opened"] - begin, -1)
    last = np.flatnonzero((depth == 1) & (change == -1) & (brackets > first))
    stop = int(brackets[last[0]]) if len(last) else len(data)  # where the array closes
    here = (brackets > first) & (brackets < stop)
    opens = brackets[here & (change == 1) & (depth == 3)]
    closes = brackets[here & (change == -1) & (depth == 2)]
    reached = int(depth[-1]) if len(depth) else start["depth"]
    text, border = data.tobytes(), first + 1 if first >= 0 else None
    if border is None and start["depth"] == 2:
        border = 0
    if border is None and len(closes):  # the element that another range began ends here
        border = int(closes[0]) + 1
    closes = closes[closes > opens[0]] if len(opens) else closes[:0]
    for a, b in zip(opens.tolist(), closes.tolist(), strict=False):
        yield from between(text[border:a])
        yield text[a : b + 1].decode()
        border = b + 1
    if len(opens) > len(closes):
        yield from between(text[border : opens[-1]])
        yield (text[opens[-1] :] + rest_of_element(file, size, end, after, reached)).decode()
    elif border is not None:
        yield from between(text[border:stop])


def between(text: bytes) -> Iterator[None]:
    """What stands between elements: commas, white space and nulls. A null that a range
    cuts counts where it begins."""
    left = re.sub(rb"[\s,]", b"", text)
    if left.strip(b"nul"):
        raise ValueError(f"malformed JSON: an element is not an object: {left[:40]!r}")
    yield from [None] * left.count(b"n")


def rest_of_element(file: pa.NativeFile, size: int, at: int, state: State, depth: int) -> bytes:
    """From byte ``at``, what is left of the element that is open there."""
    parts = []
    while at < size:
        data = bytes_of(file, at, min(at + MORE, size))
        brackets, change, state, _ = structure(data, state)
        levels = depth + np.cumsum(change)
        closed = brackets[(levels == 2) & (change == -1)]
        if len(closed):
            parts.append(data[: closed[0] + 1].tobytes())
            return b"".join(parts)
        parts.append(data.tobytes())
        depth = int(levels[-1]) if len(levels) else depth
        at += len(data)
    raise ValueError("malformed JSON: an element does not end")


# --- data source ------------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    file: int
    path: str
    size: int
    begin: int
    end: int
    start: dict | None


class JsonRanges(DataSource):
    """Byte ranges of JSON files: their summaries, or with their states the elements."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_json_ranges"

    def schema(self) -> str:
        return SUMMARY if self.options["rows"] == "summaries" else "element string"

    def reader(self, schema) -> DataSourceReader:
        return JsonRangesReader(self.options["rows"], self.options["field"], json.loads(self.options["ranges"]))


class JsonRangesReader(DataSourceReader):
    def __init__(self, rows: str, field: str, ranges: list):
        self.rows, self.field, self.ranges = rows, field, ranges

    def partitions(self) -> Sequence[InputPartition]:
        return [Range(*values) for values in self.ranges]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with opened_file(part.path) as file:
            if self.rows == "summaries":
                ends, fields = summary(file, part.size, part.begin, part.end, self.field)
                columns = [[part.file], [part.begin], [json.dumps(ends)], [json.dumps(fields)]]
                types = [pa.int32(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "at", "ends", "fields"]
                )
                return
            held: list[str | None] = []
            for text in elements(file, part.size, part.begin, part.end, part.start):
                held.append(text)
                if len(held) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["element"])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["element"])


def write_large_documents(rows: DataFrame, path: str, array_field: str = "tags") -> None:
    """Write rows as JSON documents with one array of objects, a document per partition.

    A task streams its rows, one line each, into one file, so documents may be of any
    size. A partition without rows is a document with an empty array.
    """
    lines = rows.select(F.to_json(F.struct(*[rows[f"`{c}`"] for c in rows.columns])).alias("value"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda text: pa.RecordBatch.from_arrays([pa.array([text])], ["value"])
        yield line(json.dumps({array_field: []})[:-2])
        first = True
        for batch in batches:
            texts = [f",{text}" for text in batch.column(0).to_pylist()]
            if first and texts:
                texts[0], first = texts[0][1:], False
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])
        yield line("]}")

    lines.mapInArrow(whole, "value string").write.text(path)


def read_large_documents(
    spark: SparkSession,
    path: str | Sequence[str],
    array_field: str = "tags",
    fields: str = "slug string, created_at string",
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """The rows of ``unnest_documents(read_documents(path))`` for a few large documents.

    Eager for the first pass, which reads every byte once and returns a row of some
    numbers per range; the rows themselves are read lazily, a range per task. An
    element is parsed by Spark with the declared fields. Elements are objects or null;
    a document without the field has no rows, and malformed JSON fails the job. Files
    are UTF-8 and in a store that Arrow can open (local or mounted, HDFS, S3, GCS).
    """
    # Spark lists the files; their content is not among the columns read
    listing = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    files = [tuple(r) for r in listing.select("path", "length").collect()]  # a few documents
    ranges = [
        (i, name, size, begin, min(begin + range_bytes, size), None)
        for i, (name, size) in enumerate(files)
        for begin in range(0, size, range_bytes)
    ]
    spark.dataSource.register(JsonRanges)

    def load(rows: str, wanted: list) -> DataFrame:
        options = {"rows": rows, "field": array_field, "ranges": json.dumps(wanted)}
        return spark.read.format(JsonRanges.name()).options(**options).load()

    found: dict[int, list] = {}
    for row in load("summaries", ranges).collect() if ranges else []:
        found.setdefault(row["file"], []).append((row["at"], json.loads(row["ends"]), json.loads(row["fields"])))
    starts = {(i, start["begin"]): start for i, rows in found.items() for start in chained(sorted(rows, key=lambda r: r[0]))}
    wanted = [(*r[:5], starts[r[0], r[3]]) for r in ranges]
    wanted = [r for r in wanted if r[5]["opened"] is not None and r[5]["opened"] < r[4]]
    struct = f"struct<{fields}>"
    if wanted:
        texts = load("elements", wanted)
    else:
        texts = spark.createDataFrame([], "element string")
    parsed = F.from_json("element", struct, {"mode": "FAILFAST"})
    return texts.select(parsed.alias("element")).select("element.*")
