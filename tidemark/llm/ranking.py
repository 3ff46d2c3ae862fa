"""Ranked lexical search by presence masks.

Only terms of the items matter, so a document becomes the list of those it holds, with
their occurrences. A task keeps one bitmap of documents per term. For an item, the
bitmaps of its terms laid side by side give each document a mask of matched terms;
documents of one mask form a group with a common highest possible score. Groups are
scored in falling order of it until the next one cannot enter the best of the item.

Scores are integers: doubles only make the weight of a term.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BEST = 10
ITEMS = 512  # items searched in one pass over the documents, about
ITEM_TERMS = 1 << 16  # distinct terms of all items of such a pass, about; an item stays whole
DOCS = 4096  # documents grouped by mask at once
PART = 1 << 20  # bytes of a text cut into terms at once
SCORED = 256  # documents scored between two looks at the threshold

# A term is a run of ASCII letters and digits, and of anything beyond ASCII: all else
# becomes a space, which no byte of a longer UTF-8 sequence is, and A-Z small letters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytearray(b" " * 128 + bytes(range(128, 256)))
for _byte in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _FOLD[_byte] = _byte
for _byte in range(ord("A"), ord("Z") + 1):
    _FOLD[_byte] = _byte + 32
FOLD = bytes(_FOLD)


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in parts of about ``PART`` bytes; a term stays whole."""
    folded = (text or "").encode().translate(FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PART)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


@dataclass(frozen=True)
class Search:
    """Items of one pass: for each its id, the places of its terms in the pass's
    vocabulary, and their weights times their repeats in the item."""

    items: list[tuple[int, np.ndarray, np.ndarray]]
    n_docs: int
    n_terms: int


def item_terms(items: DataFrame) -> DataFrame:
    """``id, term, repeats``: the terms of all rows of an item together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                for found in terms_of(text):
                    terms, counts = np.unique(np.array(found, object), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"id": np.full(len(terms), i), "term": [t.decode() for t in terms], "repeats": counts})

    found = items.mapInArrow(count, "id long, term string, repeats long")
    return found.groupBy("id", "term").agg(F.sum("repeats").alias("repeats"))


def postings(docs: DataFrame, names: list[str]) -> DataFrame:
    """Per document that has a term: its ``id``, its number of terms ``n``, and which of
    ``names`` it holds, as ``at`` (their places) and ``tf``."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name.encode(): i for i, name in enumerate(names)}
        for part in slices(batches, "text"):
            ids, sizes, at, tf = [], [], [], []
            for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                n, held = 0, {}
                for found in terms_of(text):
                    n += len(found)
                    for p in map(place.get, found):
                        if p is not None:
                            held[p] = held.get(p, 0) + 1
                if n:
                    ids.append(i)
                    sizes.append(n)
                    at.append(list(held))
                    tf.append(list(held.values()))
            arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "at", "tf"])

    return docs.mapInArrow(look_up, "id long, n long, at array<int>, tf array<long>")


class Block:
    """Some documents: a bitmap of documents and the impacts for each term they hold."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, offsets: np.ndarray, at: np.ndarray, tf: np.ndarray, search: Search):
        self.ids, self.size = ids, len(ids)
        doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
        norm = 100 - 75 + (75 * n * search.n_docs) // search.n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[doc])
        order = np.argsort(at, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.terms, begin = np.unique(at[order], return_index=True)
        self.edges = np.append(begin, len(order))
        self.most = np.maximum.reduceat(self.impact, begin) if len(begin) else np.zeros(0, np.int64)
        self.bitmaps = np.zeros((len(self.terms), -(-self.size // 8)), np.uint8)
        for i in range(len(self.terms)):
            row = np.zeros(self.size, bool)
            row[self.doc[self.edges[i] : self.edges[i + 1]]] = True
            self.bitmaps[i] = np.packbits(row)

    def find(self, places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms among ``places`` that the block holds, and their weights."""
        at = np.searchsorted(self.terms, places)
        held = at < len(self.terms)
        held[held] = self.terms[at[held]] == places[held]
        return at[held], weights[held]

    def groups(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents in falling order of the highest score that their mask of matched
        terms allows; where each mask's group begins; that score of each group."""
        bits = np.unpackbits(self.bitmaps[terms], axis=1, count=self.size)
        packed = np.packbits(bits, axis=0)
        words = np.zeros((self.size, -(-len(packed) // 8) * 8), np.uint8)
        words[:, : len(packed)] = packed.T
        words = words.view(np.uint64)
        if words.shape[1] == 1:
            _, first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
        else:
            _, first, group = np.unique(words, axis=0, return_index=True, return_inverse=True)
        highest = bits[:, first].T.astype(np.int64) @ (weights * self.most[terms])
        rank = np.empty(len(first), np.int64)
        falling = np.argsort(-highest, kind="stable")
        rank[falling] = np.arange(len(first))
        place = rank[group.reshape(-1)]
        docs = np.argsort(place, kind="stable")
        begins = np.searchsorted(place[docs], np.arange(len(first)))
        return docs, begins, highest[falling]

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), np.int64)
        for term, weight in zip(terms, weights, strict=True):
            held = self.doc[self.edges[term] : self.edges[term + 1]]
            at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            impact = self.impact[self.edges[term] : self.edges[term + 1]][at]
            total += np.where(held[at] == docs, weight * impact, 0)
        return total

    def improve(self, places: np.ndarray, weights: np.ndarray, score: np.ndarray, ids: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
        """The best of ``score, ids`` and of this block's documents for one item."""
        terms, weights = self.find(places, weights)
        if not len(terms):
            return score, ids
        docs, begins, highest = self.groups(terms, weights)
        begins, group = np.append(begins, len(docs)), 0
        while group < len(highest):
            least = max(int(score[-1]) if len(score) == best else 1, 1)
            if highest[group] < least:  # nor can any later group reach the best
                break
            end = max(group + 1, int(np.searchsorted(begins, begins[group] + SCORED, "right")) - 1)
            end = min(end, int(np.searchsorted(-highest, -least, "right")))
            chosen = np.sort(docs[begins[group] : begins[end]])
            found = self.scores(chosen, terms, weights)
            keep = found >= least
            score, ids = np.append(score, found[keep]), np.append(ids, self.ids[chosen[keep]])
            order = np.lexsort((ids, -score))[:best]
            score, ids, group = score[order], ids[order], end
        return score, ids


def best_of_tasks(rows: DataFrame, search: Search, best: int) -> DataFrame:
    """``item_id, doc_id, score``: each task's best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        held = [(empty, empty) for _ in search.items]
        for batch in batches:
            for begin in range(0, batch.num_rows, DOCS):
                part = batch.slice(begin, DOCS)
                ids, n = (part.column(c).to_numpy() for c in ("id", "n"))
                at, tf = part.column("at"), part.column("tf")
                offsets = at.offsets.to_numpy()
                block = Block(ids, n, offsets, at.flatten().to_numpy(), tf.flatten().to_numpy(), search)
                for i, (_, places, weights) in enumerate(search.items):
                    held[i] = block.improve(places, weights, *held[i], best)
        for (item, _, _), (score, ids) in zip(search.items, held, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_pydict({"item_id": np.full(len(ids), item), "doc_id": ids, "score": score})

    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, best: int = BEST, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The ``best`` documents of each item: ``item_id, rank, doc_id, score``.

    Items are searched in blocks of about ``ITEMS``; each block reads the documents
    once, and its terms and their document counts, which the block bounds, go through
    the driver. The texts themselves are not shuffled: what a task returns is ``best``
    rows per item.

    Null and empty texts have no terms. Documents without an id count but cannot be
    returned, items without one are left out. Rows that repeat a document's id are
    documents of their own; those that repeat an item's id are one item, equal rows
    counting once. Ids are whole numbers. Very long texts are cut into terms part by
    part. Other columns are not read, whatever their names; empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[f"`{doc_id}`"].cast("long").alias("id"), docs[f"`{text}`"].alias("text"))
    asked = items.select(items[f"`{item_id}`"].cast("long").alias("id"), items[f"`{item_text}`"].alias("text"))
    terms = written(item_terms(asked.where("id IS NOT NULL AND text IS NOT NULL").distinct()), "items")
    n_items, n_terms = terms.agg(F.count_distinct("id"), F.count("*")).first()
    blocks = max(-(-n_items // ITEMS), -(-n_terms // ITEM_TERMS))
    found = None
    for block in range(blocks):
        chosen = terms.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()  # bounded by the block
        names = sorted({r["term"] for r in chosen})
        held = written(postings(texts, names), f"postings{block}")
        total = held.agg(F.count("*"), F.sum("n")).first()
        counts = dict(held.select(F.explode("at").alias("at")).groupBy("at").count().collect())
        search = weighed(chosen, names, counts, total[0], total[1])
        part = best_of_tasks(held.where("id IS NOT NULL"), search, best)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("item_id", "rank", "doc_id", "score")


def weighed(terms: list, names: list[str], counts: dict[int, int], n_docs: int, n_terms: int | None) -> Search:
    """The search for ``terms`` (``id, term, repeats``), with documents' ``counts`` by place."""
    place = {name: i for i, name in enumerate(names)}
    items: dict[int, list[tuple[int, int]]] = {}
    for item, term, repeats in terms:
        at = place[term]
        if at in counts:
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts[at] + 1)))
            items.setdefault(item, []).append((at, repeats * weight))
    rows = [(item, *np.array(sorted(found), np.int64).T) for item, found in sorted(items.items())]
    return Search(rows, n_docs, n_terms or 0)


def rank_sql(best: int = BEST) -> str:
    """The same for DuckDB over ``documents`` and ``benchmark``."""
    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
    WITH q AS (SELECT item_id, term, count(*) AS repeats
               FROM (SELECT item_id, unnest(regexp_extract_all({folded}, '{TERM}')) AS term
                     FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY 1, 2),
    d AS (SELECT doc_id, regexp_extract_all({folded}, '{TERM}') AS terms FROM documents),
    c AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
    m AS (SELECT doc_id, 100 - 75 + (75 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM d, c WHERE len(terms) > 0),
    t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d)
          WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
          FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), c),
    s AS (SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
          FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM s WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {best}"""
