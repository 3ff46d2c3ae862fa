"""Ranked search against a plain version, with blocks small enough to matter."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import docs, no_docs, texts  # noqa: F401

from tidemark.llm import ranking


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def naive(rows, items, best):
    held = [(i, Counter(re.findall(ranking.TERM, fold(t)))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in set(items):
        if item is not None and text is not None:
            asked.setdefault(item, Counter()).update(re.findall(ranking.TERM, fold(text)))
    out = Counter()
    for item, query in asked.items():
        scored = []
        for i, c in held:
            m = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(
                repeats * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, repeats in query.items()
                if c[t]
            )
            if score > 0 and i is not None:
                scored.append((-score, i))
        out.update((item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:best], 1))
    return out


ITEMS = [
    (1, "w7 W200 w3 w3 nothing"),
    (2, "one TWO one two tie"),
    (3, " ".join(f"w{i}" for i in range(0, 300, 3))),  # more terms than a machine word has bits
    (4, "héllo 日本語 straße"),
    (5, None),
    (6, ""),
    (7, "unknown terms only"),
    (8, "other line here"),
    (8, "short tail"),
    (8, "short tail"),
    (None, "one two"),
]


@pytest.mark.parametrize("small", [False, True])
def test_rank_equals_plain_version(spark, docs, monkeypatch, small):
    if small:
        for name, value in [("DOCS", 3), ("SCORED", 1), ("ITEMS", 2), ("PART", 16)]:
            monkeypatch.setattr(ranking, name, value)
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, score long")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for best in (1, 4, 100):
        got = Counter(tuple(r) for r in ranking.rank(docs, items, best).collect())
        assert got == naive(rows, ITEMS, best)


def test_rank_of_random_words(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SCORED", 4)
    monkeypatch.setattr(ranking, "DOCS", 64)
    rng = np.random.default_rng(5)
    word = lambda: f"t{int(rng.zipf(1.3)) % 40}"
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(0, 30))))) for i in range(400)]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in ranking.rank(frame, asked).collect()) == naive(rows, items, 10)


def test_rank_of_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert ranking.rank(no_docs, items).collect() == []
    assert ranking.rank(docs, items.where("false")).collect() == []


def test_terms_of_long_texts_stay_whole(monkeypatch):
    text = "ab-cd " * 1000 + "x" * 5000 + " end"
    monkeypatch.setattr(ranking, "PART", 64)
    found = [t.decode() for part in ranking.terms_of(text) for t in part]
    assert found == re.findall(ranking.TERM, text)


def test_low_masks_are_not_scored(monkeypatch):
    """Once the best are known, groups that cannot reach them are left out."""
    rng = np.random.default_rng(2)
    n, terms = 4000, 12
    held = rng.random((n, terms)) < 0.2
    at = np.nonzero(held)[1].astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(held.sum(axis=1))])
    search = ranking.Search([], n, n * 10)
    block = ranking.Block(np.arange(n), np.full(n, 10), offsets, at, np.ones(len(at), np.int64), search)
    scored = []
    plain = block.scores
    block.scores = lambda docs, *rest: scored.append(len(docs)) or plain(docs, *rest)
    empty = np.zeros(0, np.int64)
    weights = rng.integers(500, 4000, terms)
    score, ids = block.improve(np.arange(terms), weights, empty, empty, 10)
    every = plain(np.arange(n), np.arange(terms), weights)
    order = np.lexsort((np.arange(n), -every))[:10]
    assert ids.tolist() == order.tolist() and score.tolist() == every[order].tolist()
    assert sum(scored) < n / 4
