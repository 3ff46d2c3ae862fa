"""Best-fit packing of documents into training sequences by a grouping genetic algorithm.

A document's tokens and its end token are one piece, or several if they exceed a
sequence. A genome is a grouping of pieces into sequences. Crossover injects whole
well-filled sequences of one parent into the other, removes the sequences that held
the same pieces, and puts the pieces displaced by that where they fit best.

Pieces are dealt to blocks of about ``BLOCK``. Several islands evolve a population for
each block, apart from each other; between epochs the best grouping of an island
migrates to the next one. The best grouping of a block is then kept, but for its
worst-filled sequences: their pieces are dealt anew, to a fraction of the blocks,
until one block holds all that is left. A block is the most that a task ever holds.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import Vocabulary, byte_letters, vocabulary_text
from tidemark.llm.common import slices, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
END = 0  # token that closes a document
BLOCK = 2048  # pieces evolved together, about
ISLANDS = 2  # populations of each block
EPOCHS = 2
GENERATIONS = 6  # of each epoch, at most
LAST_GENERATIONS = 60  # the same for the one block of the last level
POPULATION = 5
INJECTED = 0.25  # share of a parent's sequences that crossover injects, at most
LOOSE = 4  # one in so many pieces of a block is dealt anew
LONG_TEXT = 1 << 20  # characters encoded at once

# Fixed value: the pattern that cuts text into words in this family of tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Between a character and a space before another character two words always meet.
BORDER = re.compile(r"(?<=\S) (?=\S)")


# --- tokens -----------------------------------------------------------------------


class Encoder:
    """Token ids by a ``tokenizers`` file of byte-level BPE whose merges are in the order of their ids."""

    def __init__(self, file: str):
        self.file, self.slow = file, None
        spec, letters = json.loads(file), byte_letters()
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][t] for t in made]
        if order != sorted(order) or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("the file is not of byte-level BPE with merges in the order of their ids")
        self.ids = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text; the strings of special tokens are those tokens. Long
        texts are encoded in parts that end where two words meet."""
        parts, at = [], 0
        while at < len(text) or not parts:
            border = BORDER.search(text, at + LONG_TEXT) if len(text) - at > LONG_TEXT else None
            end = border.start() if border else len(text)
            parts.append(self.part(text[at:end]))
            at = end
        return np.concatenate(parts)

    def part(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.ids.encode_to_numpy(text, allowed_special="all"), np.uint32)
        except ValueError:  # a run of white space too long for the pattern matcher
            self.slow = self.slow or Vocabulary(self.file)
            return np.array(self.slow.encode([text])[0], np.uint32)


def kept_encoder(file: str) -> Encoder:
    """The encoder a worker process has built, by the content of its file."""
    held = sys.modules.setdefault("tidemark_encoders", types.ModuleType("tidemark_encoders")).__dict__
    key = f"{len(file)}:{zlib.crc32(file.encode())}"
    if key not in held:
        held[key] = Encoder(file)
    return held[key]


PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", end: int = END, keep_ids: bool = False) -> DataFrame:
    """Every document's tokens and ``end``, cut only if they exceed ``capacity``: the
    first piece is then the shorter one, and all others are full.

    Null text is empty text, so its one piece is the end token. Repeated rows and ids
    give pieces each; other columns are not read. With ``keep_ids`` also the ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))  # a file of fixed size
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    schema = PIECES.format(rows.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            encoder = kept_encoder(shared.value)
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, value in enumerate(part.column("text").to_pylist()):
                tokens = np.append(encoder.encode(value or ""), np.uint32(end)).astype("<u4")
                first = (len(tokens) - 1) % capacity + 1
                edges = [0, *range(first, len(tokens) + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append(row)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b].tobytes()))
                    if keep_ids:
                        ids.append(pa.array(tokens[a:b].astype(np.int32)))
            columns = [
                part.column("doc_id").take(pa.array(rows, pa.int64())),
                pa.array(piece, pa.int32()),
                *[pa.array(values, pa.int64()) for values in (start, length, crc)],
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(ids)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(cut, schema)


# --- groupings --------------------------------------------------------------------


def best_fit(order: list[int], length: list[int], group: np.ndarray, room: dict[int, int], capacity: int, fresh: int) -> None:
    """Put the pieces of ``order``, one by one, into the sequence with the least room
    that takes them, or else into a new one numbered from ``fresh``. ``room`` has the
    room of the sequences there are; ``group`` gets the sequence of each piece."""
    by_room: dict[int, list[int]] = {}
    for sequence, left in room.items():
        if left:
            by_room.setdefault(left, []).append(sequence)
    rooms = sorted(by_room)
    for i in order:
        size = length[i]
        at = bisect_left(rooms, size)
        if at < len(rooms):
            left = rooms[at]
            same = by_room[left]
            sequence = same.pop()
            if not same:
                del by_room[left], rooms[at]
        else:
            left, sequence = capacity, fresh
            fresh += 1
        group[i] = sequence
        left -= size
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(sequence)


def numbered(group: np.ndarray) -> np.ndarray:
    return np.unique(group, return_inverse=True)[1].reshape(-1)


def packed_in_order(order: np.ndarray, length: np.ndarray, capacity: int) -> np.ndarray:
    group = np.zeros(len(length), np.int64)
    best_fit(order.tolist(), length.tolist(), group, {}, capacity, 0)
    return group


def fill_of(group: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.bincount(group, length).astype(np.int64)


def cost(group: np.ndarray, length: np.ndarray) -> tuple[int, int]:
    """Fewer sequences first; then the more unequal fill, which leaves room together."""
    fill = fill_of(group, length)
    return len(fill), -int((fill * fill).sum())


def repaired(child: np.ndarray, displaced: np.ndarray, length: np.ndarray, capacity: int) -> np.ndarray:
    """``child`` with the displaced pieces put, longest first, where they fit best."""
    stay = ~displaced
    fill = np.bincount(child[stay], length[stay], minlength=int(child.max()) + 1).astype(np.int64)
    used = np.unique(child[stay])
    room = dict(zip(used.tolist(), (capacity - fill[used]).tolist(), strict=True))
    moved = np.flatnonzero(displaced)
    order = moved[np.argsort(-length[moved], kind="stable")]
    best_fit(order.tolist(), length.tolist(), child, room, capacity, int(child.max()) + 1)
    return numbered(child)


def crossover(taker: np.ndarray, giver: np.ndarray, length: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject well-filled sequences of ``giver`` into ``taker``."""
    fill = fill_of(giver, length)
    best = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    count = int(rng.integers(1, max(2, int(INJECTED * len(fill)) + 1)))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.permutation(best)[:count]] = True
    injected = chosen[giver]
    broken = np.zeros(int(taker.max()) + 1, bool)
    broken[taker[injected]] = True  # sequences that would hold a piece twice
    child = np.where(injected, len(broken) + giver, taker)
    return repaired(child, broken[taker] & ~injected, length, capacity)


def mutation(group: np.ndarray, length: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve some sequences, the worst-filled and a few others."""
    fill = fill_of(group, length)
    broken = np.zeros(len(fill), bool)
    broken[np.argsort(fill, kind="stable")[:2]] = True
    broken[rng.integers(0, len(fill), 4)] = True
    return repaired(group.copy(), broken[group], length, capacity)


def evolve(length: np.ndarray, capacity: int, settlers: list[np.ndarray], rng: np.random.Generator, generations: int = GENERATIONS) -> np.ndarray:
    """The best grouping after some generations, or once no grouping can be better.
    ``settlers`` join best fit by falling length and by orders near it."""
    population = [*settlers]
    if not settlers:
        population.append(packed_in_order(np.argsort(-length, kind="stable"), length, capacity))
    while len(population) < POPULATION:
        near = length * rng.uniform(0.8, 1.25, len(length))
        population.append(packed_in_order(np.argsort(-near, kind="stable"), length, capacity))
    least = -(-int(length.sum()) // capacity)
    rank = lambda group: cost(group, length)
    population.sort(key=rank)
    for _ in range(generations):
        if rank(population[0])[0] <= least:
            break
        children = []
        for _ in range(POPULATION):
            a, b = rng.choice(len(population), 2, replace=False)
            children.append(crossover(population[a], population[b], length, capacity, rng))
        children.append(mutation(population[0], length, capacity, rng))
        population = sorted([*population, *children], key=rank)[:POPULATION]
    return population[0]


# --- blocks and islands -----------------------------------------------------------

GROUPED = "item long, length long, block long, island int, sequence int"
PLACED = "item long, length long, sequence_id long, offset long"


def island_epoch(rows: DataFrame, capacity: int, epoch: int, generations: int) -> DataFrame:
    """One epoch on every island of every block. A row is a piece in a grouping that the
    island starts from: none in the first epoch, its own and a migrant's after it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, island = (k.as_py() for k in key)
        item, length, source, sequence = (table.column(n).to_numpy() for n in ("item", "length", "source", "sequence"))
        order = np.lexsort((item, source))
        item, length, source, sequence = (a[order] for a in (item, length, source, sequence))
        n = len(item) // len(np.unique(source))
        settlers = [numbered(sequence[at : at + n]) for at in range(0, len(item), n)] if epoch else []
        rng = np.random.default_rng([block, island, epoch])
        group = evolve(length[:n], capacity, settlers, rng, generations)
        out = {"item": item[:n], "length": length[:n], "block": np.full(n, block), "island": np.full(n, island, np.int32)}
        return pa.table(out | {"sequence": group.astype(np.int32)})

    return rows.groupBy("block", "island").applyInArrow(run, GROUPED)


def kept_and_loose(rows: DataFrame, capacity: int, level: int, last: bool) -> DataFrame:
    """Place the pieces by the best grouping of their block. Unless it is the ``last``
    level, the worst-filled sequences and, up to one piece in ``LOOSE``, those of most
    pieces are dissolved: their pieces have no sequence."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        item, length, island, sequence = (table.column(n).to_numpy() for n in ("item", "length", "island", "sequence"))
        order = np.lexsort((item, island))
        item, length, island, sequence = (a[order] for a in (item, length, island, sequence))
        n = len(item) // len(np.unique(island))
        groups = [numbered(sequence[at : at + n]) for at in range(0, len(item), n)]
        item, length = item[:n], length[:n]
        group = min(groups, key=lambda g: cost(g, length))
        fill, size = fill_of(group, length), np.bincount(group)
        loose = np.zeros(len(fill), bool)
        if not last:
            full = fill == capacity
            open_first = np.lexsort((-size, np.where(full, 0, fill), full))
            loose[open_first[: np.searchsorted(np.cumsum(size[open_first]), n // LOOSE, "right")]] = True
        order = np.lexsort((item, group))
        item, length, group = item[order], length[order], group[order]
        before = np.cumsum(length) - length
        head = np.searchsorted(group, group)
        name = (level << 56) + (block << 16) + group
        gone = loose[group]
        return pa.table(
            {
                "item": item,
                "length": length,
                "sequence_id": pa.array(name, pa.int64(), mask=gone),
                "offset": pa.array(before - before[head], pa.int64(), mask=gone),
            }
        )

    return rows.groupBy("block").applyInArrow(run, PLACED)


def evolved(items: DataFrame, blocks: int, capacity: int, level: int) -> DataFrame:
    """All epochs of one level on ``items`` (``item``, ``length``)."""
    block = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks))
    islands = F.explode(F.array([F.lit(i) for i in range(ISLANDS)])).alias("island")
    none = F.lit(0).alias("source"), F.lit(0).alias("sequence")
    rows = items.select("item", "length", block.alias("block"), islands).select("*", *none)
    for epoch in range(EPOCHS):
        rows = island_epoch(rows, capacity, epoch, GENERATIONS if blocks > 1 else LAST_GENERATIONS)
        if epoch < EPOCHS - 1:
            # the best of each island stays and migrates to the next island
            goes = F.explode(F.array(F.lit(0), F.lit(1))).alias("source")
            rows = rows.select("*", goes).withColumn("island", F.pmod(F.col("island") + F.col("source"), F.lit(ISLANDS)))
    return kept_and_loose(rows, capacity, level, last=blocks == 1)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", end: int = END, block: int = BLOCK, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset`` in that sequence.

    Eager: it writes the pieces, then the groupings of each level, of which there are
    as many as the logarithm of the blocks to base ``LOOSE``. A piece that is full is a
    sequence of its own and takes no part. Sequences are gapless from offset 0.
    Nulls, empty texts, repeated rows and repeated ids are documents like any other; an
    empty table gives no pieces. Very long texts are many full pieces and one other.
    Extra columns are left out, whatever their names. Reruns give the same groupings.
    """
    cut = pieces(docs, path, capacity, text, doc_id, end, keep_ids)
    # the number depends on a scan's partitions, which a retried task repeats
    cut = written(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    rest = cut.where(F.col("length") < capacity).select("item", "length")
    placed = cut.where(F.col("length") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    count, level = rest.count(), 0
    while count:
        blocks = -(-count // block)
        done = written(evolved(rest, blocks, capacity, level), f"packing{level}")
        placed = placed.unionByName(done.where("sequence_id IS NOT NULL").select("item", "sequence_id", "offset"))
        rest = done.where("sequence_id IS NULL").select("item", "length")
        count, level = rest.count() if blocks > 1 else 0, level + 1
    return cut.join(placed, "item").drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of ``pack(keep_ids=True)``: ``sequence_id``, the ``ids`` in
    order, and ``starts``, where each document's piece begins."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("starts"))
