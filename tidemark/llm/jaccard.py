"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the hashes of its word shingles. Documents of equal sets are
one class. Tokens are ordered rarest first, by a sketch of their counts and then by
hash; two sets similar enough share a token within prefixes of known length, so
an index of prefix tokens finds every pair. Tokens of long lists get combined:
with prefixes one longer the pair also shares a second token, so those lists are
split by every later token of the prefix. Candidates are verified on whole texts.

Every set also has a parity bitmap: each token flips one bit, so two bitmaps differ in
no more bits than the sets differ in tokens, and pairs that differ in too many are
left out for certain.

What is asked for are the components, so a pair within a component already known
needs no proof: first each document is only verified against the nearest of its
lists by bitmap, then only pairs of different components are, in full. Large
groups of copies thus cost their size, not its square.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import staging
from tidemark.llm.common import (
    CELL_ROW,
    WORD,
    added_cells,
    cell_counts,
    cell_of,
    cell_rows,
    fresh,
    mixed,
    shingles,
    slices,
    utf8,
    written,
)
from tidemark.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 1 << 21  # cells of the sketch of token counts; its size is fixed, more cells order more finely
LONG_LIST = 2048  # members of a token's list from which tokens are combined
BITMAP = 512  # bits of a parity bitmap
ROUNDS = 2  # in which documents are verified against their nearest only
BLOCK = 1024  # members of a list among which the nearest is sought
NODE = "doc_id long, a long, b long"


def token_sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of the texts, sorted within each, with the size of each set."""
    tokens, owner = shingles(*utf8(batch.column("text")), words)
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    first = np.ones(len(tokens), bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    tokens, owner = tokens[first], owner[first]
    return tokens, owner, np.bincount(owner, minlength=batch.num_rows)


def signatures(tokens: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that equal sets share: sums of hashes."""
    out = []
    for salt in (0x1B873593, 0xCC9E2D51):
        total = np.zeros(n, np.uint64)
        np.add.at(total, owner, mixed(tokens ^ np.uint64(salt)))
        out.append(total.view(np.int64))
    return out[0], out[1]


def prefix_length(n, share: tuple[int, int]):
    """Tokens of a set of ``n`` of which one is in any similar set."""
    return n - -(-share[0] * n // share[1]) + 1


def _documents(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))


def _described(rows: DataFrame, words: int) -> DataFrame:
    """A row per document, ``doc_id, n, a, b``, and rows of the sketch, ``chunk, counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def each() -> Iterator[np.ndarray]:
            for part in slices(batches, "text"):
                tokens, owner, n = token_sets(part, words)
                a, b = signatures(tokens, owner, part.num_rows)
                none = pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())
                held.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(a), pa.array(b), *none], names))
                yield tokens

        names = ["doc_id", "n", "a", "b", "chunk", "counts"]
        for cells in cell_rows(each(), CELLS):
            none = [pa.nulls(cells.num_rows, pa.int64())] * 4
            held.append(pa.RecordBatch.from_arrays([*none, *cells.columns], names))
        yield from held

    return rows.mapInArrow(run, f"doc_id long, n long, a long, b long, {CELL_ROW}")


def _prefixes(rows: DataFrame, counts: np.ndarray, words: int, share: tuple[int, int]) -> DataFrame:
    """``doc_id, a, b, n, tokens, bits``: each document's rarest tokens, one more than its prefix, and bitmap."""
    rank = np.log2(counts.astype(np.float64) + 1).astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            tokens, owner, n = token_sets(part, words)
            a, b = signatures(tokens, owner, part.num_rows)
            order = np.lexsort((tokens, rank[cell_of(tokens, CELLS)], owner))
            begin = np.concatenate([[0], np.cumsum(n)])[:-1]
            place = np.arange(len(tokens)) - begin[owner]
            taken = place <= prefix_length(n, share)[owner]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[taken], minlength=part.num_rows))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens[order][taken].view(np.int64)))
            flips = np.bincount(owner * BITMAP + (tokens >> np.uint64(55)).astype(np.int64), minlength=part.num_rows * BITMAP)
            bits = np.packbits((flips & 1).astype(np.uint8).reshape(-1, BITMAP), axis=1)
            bits = pa.array([x.tobytes() for x in bits], pa.binary())
            arrays = [part.column("doc_id"), pa.array(a), pa.array(b), pa.array(n), lists, bits]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "a", "b", "n", "tokens", "bits"])

    return rows.mapInArrow(run, f"{NODE}, n long, tokens array<long>, bits binary")


def _listed(index: DataFrame) -> DataFrame:
    """Of ``token, rep, n, place`` the lists of two members or more. Lists pass through
    in order; one row is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the head of a list, until a second member comes
        last: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column("token").to_numpy()
            joins = np.append(token[:1] == last, token[1:] == token[:-1])
            keep = joins | np.append(joins[1:], False)
            if held is not None and joins[0]:
                yield held
            yield batch.filter(pa.array(keep))
            held = None if joins[-1] else batch.slice(batch.num_rows - 1)
            last = token[-1]

    dealt = index.repartition("token").sortWithinPartitions("token").select("token", "rep", "n", "place")
    return dealt.mapInArrow(run, "token long, rep long, n long, place long")


PAIR = ["u", "v", "who", "apart"]


def _pairs_across(lists: DataFrame, share: tuple[int, int], nearest: bool, long_list: int | None = None) -> DataFrame:
    """Pairs ``u, v`` of different components within each list that may be similar.

    ``lists`` has ``token, rep, n, place, bits, component``. With ``nearest`` each
    member (``who``) is only paired with the one before it whose bitmap is the least
    ``apart``. Else all pairs are given, and a row with null ``v`` names in ``u`` a
    token whose list is longer than ``long_list``.
    """
    s, w = share

    def partners(i: int, to: int, n, place, comp, bits) -> tuple[np.ndarray, np.ndarray]:
        """Of ``i + 1`` to ``to``, those ``i`` may be similar to, and how far apart they are."""
        j = np.arange(i + 1, to)
        both = n[i] + n[j]
        j = j[(comp[j] != comp[i]) & (s * both <= (s + w) * np.minimum(n[i] - place[i], n[j] - place[j]))]
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)
        both = n[i] + n[j]
        near = apart <= both + 2 * (-s * both // (s + w))
        return j[near], apart[near]

    def nearest_pairs(rep, n, place, comp, bits, ends) -> Iterator[list[np.ndarray]]:
        best = np.full(len(rep), np.iinfo(np.int64).max)
        mate = np.full(len(rep), -1)
        for i in range(len(rep) - 1):
            j, apart = partners(i, min(ends[i], (i // BLOCK + 1) * BLOCK), n, place, comp, bits)
            closer = apart < best[j]
            best[j[closer]], mate[j[closer]] = apart[closer], i
        at = np.flatnonzero(mate >= 0)
        if len(at):
            yield [np.minimum(rep[at], rep[mate[at]]), np.maximum(rep[at], rep[mate[at]]), rep[at], best[at]]

    def all_pairs(rep, n, place, comp, bits, ends) -> Iterator[list[np.ndarray]]:
        for i in range(len(rep) - 1):
            j, apart = partners(i, ends[i], n, place, comp, bits)
            if len(j):
                yield [np.minimum(rep[j], rep[i]), np.maximum(rep[j], rep[i]), np.full(len(j), rep[i]), apart]

    def as_rows(found: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], PAIR)

    def closed(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, rep, n, place, comp, bits = columns
        cuts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1])
        stops = np.append(cuts[1:], len(token))
        open_lists = np.minimum.reduceat(comp, cuts) != np.maximum.reduceat(comp, cuts)
        found, size = [], 0
        for c, e in zip(cuts[open_lists].tolist(), stops[open_lists].tolist(), strict=True):
            if long_list and e - c > long_list:
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(token[c : c + 1]), none, none, none], PAIR)
                continue
            # rows are in order of size, so a row's partners end where sizes get too large
            ends = np.searchsorted(n[c:e], n[c:e] * w // s, "right")
            pairs = nearest_pairs if nearest else all_pairs
            for pair in pairs(rep[c:e], n[c:e], place[c:e], comp[c:e], bits[c:e], ends):
                found.append(pair)
                size += len(pair[0])
                if size > 1 << 16:
                    yield as_rows(found)
                    found, size = [], 0
        if found:
            yield as_rows(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns[:5]]
            columns.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, BITMAP // 64))
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            last = np.searchsorted(columns[0], columns[0][-1])  # the last list may go on
            if last:
                yield from closed([c[:last] for c in columns])
            held = [c[last:] for c in columns]
        if held is not None:
            yield from closed(held)

    dealt = lists.repartition("token").sortWithinPartitions("token", "n", "rep")
    dealt = dealt.select("token", "rep", "n", "place", "component", "bits")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in PAIR))


def _verified(pairs: DataFrame, rows: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """The pairs ``u, v`` whose whole sets are similar. Only texts that may be needed are shuffled."""
    pairs = written(pairs.distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    wanted = cell_counts(ids, CELLS) > 0
    s, w = share

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("doc_id").fill_null(-1).to_numpy()
            part = batch.filter(pa.array(wanted[cell_of(at, CELLS)]))
            if part.num_rows:
                yield part

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "text"):
                left, left_owner, left_n = token_sets(part.select(["u", "v", "text"]), words)
                other = pa.RecordBatch.from_arrays([part.column("other")], ["text"])
                right, right_owner, right_n = token_sets(other, words)
                both = np.concatenate([left, right])
                owner = np.concatenate([left_owner, right_owner])
                order = np.lexsort((both, owner))
                both, owner = both[order], owner[order]
                twice = (both[1:] == both[:-1]) & (owner[1:] == owner[:-1])
                common = np.bincount(owner[1:][twice], minlength=part.num_rows)
                good = (w * common >= s * (left_n + right_n - common)) & (common > 0)
                yield part.select(["u", "v"]).filter(pa.array(good))

    texts = rows.mapInArrow(maybe, "doc_id long, text string")
    left = texts.select(F.col("doc_id").alias("u"), "text")
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("other"))
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "text", "other")
    return joined.mapInArrow(check, "u long, v long").distinct()


def near_components(
    docs: DataFrame, words: int = 4, share: tuple[int, int] = (85, 100), text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z in lower case. A set holds the
    distinct shingles of ``words`` words; fewer words are one shingle as a whole; none
    (or null text) give an empty set, linked with nothing. Two documents link when
    ``share[1] * common >= share[0] * union``. ``component_id`` is the least id
    reachable over links, the own included. Rows of one id count as linked with each
    other; a row without id is linked with nothing and has a null component. An empty table
    gives no rows. Shingles are compared by 64-bit hashes.
    """
    rows = _documents(docs, text, doc_id)
    described = written(_described(rows, words), "described")
    counts = added_cells(described.where("chunk IS NOT NULL").select("chunk", "counts"), CELLS)
    sets = written(described.where("chunk IS NULL").select("doc_id", "n", "a", "b"), "sets")
    staging.discard(described)
    linkable = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(linkable.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep")), "classes")
    same_id = linkable.groupBy("doc_id").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x <> y").select("doc_id")
    own = linkable.join(same_id, "doc_id").join(classes, ["n", "a", "b"])
    of_one_id = own.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    # the index, of one document per class
    prefixes = _prefixes(rows, counts, words, share).where("n > 0 AND doc_id IS NOT NULL")
    reps = classes.select(F.col("rep").alias("doc_id"), "n", "a", "b")
    prefixes = prefixes.join(reps, ["doc_id", "n", "a", "b"]).dropDuplicates(["doc_id", "n", "a", "b"])
    prefixes = written(prefixes.select(F.col("doc_id").alias("rep"), "n", "tokens", "bits"), "prefixes")
    index = prefixes.select("rep", "n", F.posexplode("tokens").alias("place", "token"))
    length = F.expr(f"n - ceil({share[0]} * n / {share[1]}) + 1")
    index = index.where(F.col("place") < length).select("token", "rep", "n", F.col("place").cast("long").alias("place"))
    lists = written(_listed(index), "lists")
    bitmaps = prefixes.select("rep", "n", "bits").distinct()

    def members(known: DataFrame) -> DataFrame:
        named = bitmaps.join(known.withColumnRenamed("node", "rep"), "rep", "left")
        return lists.join(named.select("rep", "n", "bits", F.coalesce("component", "rep").alias("component")), ["rep", "n"])

    edges = written(of_one_id, "links")
    known = components(edges)
    for _ in range(ROUNDS):
        near = _pairs_across(members(known), share, nearest=True)
        chosen = near.groupBy("who").agg(F.min(F.struct("apart", "u", "v")).alias("best")).select("best.u", "best.v")
        edges = written(edges.unionByName(_verified(chosen, rows, words, share)), "links")
        known = written(components(edges), "known")

    # what is left: all pairs of different components
    member = members(known)
    across = written(_pairs_across(member, share, False, LONG_LIST), "across")
    long_tokens = across.where("v IS NULL").select(F.col("u").alias("token"))
    combined = member.join(long_tokens, "token").join(prefixes.select("rep", "n", "tokens"), ["rep", "n"])
    later = F.explode(F.expr("slice(tokens, int(place) + 2, size(tokens))")).alias("second")
    combined = combined.select("token", "rep", "n", "place", "bits", "component", later)
    combined = combined.withColumn("token", F.xxhash64("token", "second")).drop("second")
    rest = across.where("v IS NOT NULL").unionByName(_pairs_across(combined, share, False))
    found = _verified(rest.select("u", "v"), rows, words, share)
    known = components(edges.unionByName(found))
    staging.discard(prefixes, lists, across)  # what is returned reads sets, classes and components

    final = classes.join(known.withColumnRenamed("node", "rep"), "rep", "left")
    final = final.select("n", "a", "b", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(final, ["n", "a", "b"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _without(docs: DataFrame, doc_id: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone``. Only rows that share a cell with one
    of those ids are shuffled; all others stay where they are."""
    held = cell_counts(gone, CELLS) > 0

    @F.arrow_udf("boolean")
    def shares_cell(ids: pa.Array) -> pa.Array:
        return pa.array(held[cell_of(ids.to_numpy(zero_copy_only=False), CELLS)])

    key = docs[f"`{doc_id}`"]
    may_go = key.isNotNull() & shares_cell(F.coalesce(key.cast("long"), F.lit(0)))
    return docs.where(~may_go).union(docs.where(may_go).join(gone, key == gone["gone"], "left_anti"))


def one_of_each(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The row of ``docs`` that is the first of each component, by id; rows without id or words stay.

    Of rows that share the first id, one stays, the first by text and then by the other
    columns that have an order. Very long texts are handled whole; an empty table stays
    empty, and other columns stay as they are.
    """
    found = written(near_components(docs, words, share, text, doc_id), "components")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    rest = _without(docs, doc_id, gone)
    several = found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    several = written(several.select(F.col("doc_id").alias("several")), "several")
    if several.isEmpty():  # as where ids are unique
        return rest
    same = rest[f"`{doc_id}`"] == several["several"]
    (rank,) = fresh(docs, "rank")
    worded = F.coalesce(rest[f"`{text}`"].rlike(WORD), F.lit(False))
    order = [rest[f"`{f.name}`"] for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType, T.StructType, T.ArrayType))]
    first = Window.partitionBy(rest[f"`{doc_id}`"], worded).orderBy(rest[f"`{text}`"].asc_nulls_last(), *order)
    one = rest.join(several, same, "left_semi").withColumn(rank, F.row_number().over(first)).where((F.col(rank) == 1) | ~worded).drop(rank)
    return rest.join(several, same, "left_anti").unionByName(one)
