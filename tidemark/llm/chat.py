"""Chat formatting by prefix-target expansion.

Every turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. A conversation gives one
example per assistant turn: all turns before it are context, and of the reply the
text alone is trainable. An example's context is the example before it and what
follows that, so ``examples`` keeps it by reference: the row of an example holds the
turns since the last one, where these begin in the conversation, and the digest of all
text before them, its context; spans count from the begin of the conversation. That is
what is shuffled: it grows with the turns, not with their square. ``full_examples``
expands it: it resolves every reference, fails if a context is not what its example was
written with, and spells each example out, prefix and target. ``read_examples`` reads
those. A conversation of any length passes through a task part by part.

Control strings in texts are escaped reversibly: ``<``, any number of backslashes
and ``|`` get one backslash more, so neither ``<|im_start|>`` nor ``<|im_end|>``
can arise from a text.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
ESCAPED = re.compile(r"<\\(\\*)\|")
FLUSH_CHARS = 4 << 20
PART_CHARS = 4 << 20  # of an example in one row
HELD_BYTES = 16 << 20  # of a conversation held in memory while its examples are spelt out
EXAMPLE = (
    "conv_id long, example int, turns int, is_target boolean, begin long, context_sha256 string, "
    "formatted string, loss_begin long, loss_end long"
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def _role(role: Column) -> Column:
    """A role keeps to its line: backslash and line feed are spelt out."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def examples(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The examples of all conversations, as increments.

    ``conv_id``; ``example``, from 0; ``turns`` in ``formatted``, which are those
    since the example before; ``begin``, where they start in the conversation, and
    ``context_sha256``, the digest of all that stands before, the example's context;
    ``loss_begin`` and ``loss_end``, the trainable characters, counted in the
    conversation. Rows without target (``is_target`` false, nothing trainable) hold the
    turns after the last reply, and part of the turns before a reply that are too many
    for one row; they have the ``example`` they lead to.

    Null text and null role are empty. Turns of one number stand in order of role
    and text, null turns first, repeated rows each count; a null conversation is
    one like any other. An empty table gives no rows.
    """
    rows = chats.select(
        chats[f"`{conv_id}`"].cast("long").alias("conv_id"),
        chats[f"`{turn}`"].alias("turn"),
        F.coalesce(chats[f"`{role}`"], F.lit("")).alias("role"),
        F.coalesce(chats[f"`{text}`"], F.lit("")).alias("text"),
    )
    turns = rows.select(
        "conv_id", "turn", "role", "text", _role(F.col("role")).alias("role_text"), escape(F.col("text")).alias("body")
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = ordered.select("conv_id", (F.col("role") == TRAINED).alias("trained"), "role_text", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, now, parts, context = 0, NOTHING, [], hashlib.sha256()
        example = begin = at = 0

        def row(target: bool, first: int, last: int) -> tuple:
            formatted, before = "".join(parts), context.hexdigest()
            context.update(formatted.encode())
            return now, example, len(parts), target, begin, before, formatted, first, last

        for batch in batches:
            for conv, trained, name, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if conv != now:
                    if parts:
                        out.append(row(False, at, at))
                    now, parts, example, begin, at, context = conv, [], 0, 0, 0, hashlib.sha256()
                head = f"{START}{name}\n"
                parts.append(f"{head}{body}{END}")
                size += len(parts[-1])
                first = at + len(head)
                at += len(parts[-1])
                if trained:
                    out.append(row(True, first, first + len(body)))
                    parts, example, begin = [], example + 1, at
                if size > FLUSH_CHARS and parts:  # turns without a reply, too many to wait for one
                    out.append(row(False, at, at))
                    parts, begin = [], at
                if size > FLUSH_CHARS and out:
                    yield as_batch(out, EXAMPLE_NAMES, EXAMPLE_TYPES)
                    out, size = [], 0
        if parts:
            out.append(row(False, at, at))
        if out:
            yield as_batch(out, EXAMPLE_NAMES, EXAMPLE_TYPES)

    return ordered.mapInArrow(run, EXAMPLE)


NOTHING = object()
EXAMPLE_NAMES = [part.split()[0] for part in EXAMPLE.split(", ")]
KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
EXAMPLE_TYPES = [KINDS[part.split()[1]] for part in EXAMPLE.split(", ")]
FULL = "conv_id long, example int, part int, is_target boolean, text string, loss_begin long, loss_end long"
FULL_NAMES = [part.split()[0] for part in FULL.split(", ")]
FULL_TYPES = [KINDS[part.split()[1]] for part in FULL.split(", ")]
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_examples long"
)
DIGEST_NAMES = [part.split()[0] for part in DIGEST.split(", ")]
DIGEST_TYPES = [KINDS[part.split()[1]] for part in DIGEST.split(", ")]


def as_batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def full_examples(increments: DataFrame) -> DataFrame:
    """Prefix-target expansion: each example spelt out, from the first turn of its
    conversation to its reply: ``conv_id, example, part, is_target, text, loss_begin,
    loss_end``.

    One row per example; only one of more than ``PART_CHARS`` characters is several,
    ``part`` from 0. The loss span counts from the begin of the example. Turns after the
    last reply are in one more row, of the whole conversation, with nothing trainable
    (``is_target`` false). Rows of a conversation follow one another in order. Every
    context is resolved, and the job fails if it is not the text the example was
    written with. The text grows with the square of the turns, but a task holds one part
    of an example, and what came before it in a file once that is long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, now, at, prefix, context, open_end = 0, NOTHING, 0, None, None, None

        def parts(example: int, target: bool, first: int, last: int) -> Iterator[tuple]:
            prefix.seek(0)
            part = 0
            while text := prefix.read(PART_CHARS):
                yield now, example, part, target, text, first, last
                part += 1
            prefix.seek(0, os.SEEK_END)

        def flushed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal out, size
            for row in rows:
                out.append(row)
                size += len(row[4])
                if size > FLUSH_CHARS:
                    yield as_batch(out, FULL_NAMES, FULL_TYPES)
                    out, size = [], 0

        for batch in batches:
            for conv, example, target, begin, before, formatted, first, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if conv != now:
                    if open_end is not None:
                        yield from flushed(parts(open_end, False, at, at))
                    if prefix:
                        prefix.close()
                    prefix = tempfile.SpooledTemporaryFile(HELD_BYTES, "w+", encoding="utf-8", newline="")
                    now, at, context, open_end = conv, 0, hashlib.sha256(), None
                if begin != at or before != context.hexdigest():
                    raise ValueError(f"conversation {conv}: the context of an example is not the text before it")
                prefix.write(formatted)
                context.update(formatted.encode())
                at += len(formatted)
                open_end = None if target else example
                if target:
                    yield from flushed(parts(example, True, first, last))
        if open_end is not None:
            yield from flushed(parts(open_end, False, at, at))
        if prefix:
            prefix.close()
        if out:
            yield as_batch(out, FULL_NAMES, FULL_TYPES)

    ordered = increments.repartition("conv_id").sortWithinPartitions("conv_id", "begin")
    columns = ["conv_id", "example", "is_target", "begin", "context_sha256", "formatted", "loss_begin", "loss_end"]
    return ordered.select(*columns).mapInArrow(run, FULL)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and span of the still escaped text of every turn in ``formatted``."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        stop = formatted.index(END, line + 1)
        role = unescape_role(formatted[at + len(START) : line])
        out.append((role, unescape(formatted[line + 1 : stop]), line + 1, stop))
        at = stop + len(END)
    return out


def read_back(increments: DataFrame) -> DataFrame:
    """``read_examples`` of the examples spelt out."""
    return read_examples(full_examples(increments))


def read_examples(full: DataFrame) -> DataFrame:
    """Digests of what the examples hold, one row per conversation, read from the
    formatted texts alone: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_examples``. Texts under the loss mask are unescaped.

    Takes the rows as ``full_examples`` gives them. Every example is read whole; the
    job fails if one does not begin with the example before it, or if rows are
    missing or out of order. Only turns that the example before did not have are taken
    apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Reading | None = None
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or row[0] != state.conv:
                    if state:
                        out.append(state.digests())
                    state = Reading(row[0])
                state.take(*row[1:])
            if out:
                yield as_batch(out, DIGEST_NAMES, DIGEST_TYPES)
        if state:
            yield as_batch([state.digests()], DIGEST_NAMES, DIGEST_TYPES)

    return full.select(*FULL_NAMES).mapInArrow(run, DIGEST)


class Reading:
    """What has been read of one conversation's examples."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.n_turns = self.loss_chars = self.n_examples = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.example, self.next_part, self.target = -1, 0, True
        self.at, self.whole, self.rest, self.trained = 0, 0, "", []
        self.text, self.before = hashlib.sha256(), hashlib.sha256().hexdigest()

    def fail(self, what: str) -> None:
        raise ValueError(f"conversation {self.conv}, example {self.example}: {what}")

    def take(self, example: int, part: int, target: bool, text: str, first: int, last: int) -> None:
        """One part of an example."""
        if part == 0:
            self.close()
            if example != self.example + 1 or not self.target:
                self.fail("the next one is missing")
            self.before, self.text = self.text.hexdigest(), hashlib.sha256()
            self.whole, self.at = self.at, 0
            self.example, self.next_part, self.target = example, 0, target
        if (example, part) != (self.example, self.next_part):
            self.fail("a part is missing")
        self.next_part += 1
        known = min(len(text), max(0, self.whole - self.at))
        self.text.update(text[:known].encode())
        if known and self.at + known == self.whole and self.text.hexdigest() != self.before:
            self.fail("it does not begin with the example before it")
        self.text.update(text[known:].encode())
        self.rest += text[known:]
        stop = self.rest.rfind(END) + len(END)
        if stop >= len(END):
            for role, said, _, _ in parse(self.rest[:stop]):
                self.n_turns += 1
                self.turns.update(f"{role}\n{said}\n".encode())
            self.rest = self.rest[stop:]
        self.trained.append(text[max(0, first - self.at) : max(0, last - self.at)])
        self.at += len(text)

    def close(self) -> None:
        """The end of an example."""
        if self.at < self.whole or self.rest:
            self.fail("its text is cut off")
        if self.example >= 0:
            trained = unescape("".join(self.trained))
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())
            self.n_examples += self.target
        self.trained = []

    def digests(self) -> tuple:
        self.close()
        turns, loss = self.turns.hexdigest(), self.loss.hexdigest()
        return self.conv, self.n_turns, turns, self.loss_chars, loss, self.at, self.n_examples
