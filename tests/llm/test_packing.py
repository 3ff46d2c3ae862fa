"""Best-fit packing: tokens against the library, pieces and sequences against their rules."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import docs, no_docs, sf_dir, texts  # noqa: F401
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.queries import op11_packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encoder():
    with open(FILE, encoding="utf-8") as file:
        return packing.Encoder(file.read())


def expected_pieces(rows, library, capacity):
    out = Counter()
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return out


def check_sequences(rows, capacity):
    """Every sequence is gapless from 0 and within the capacity; their number."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_tokens_equal_the_library(encoder, library, texts, monkeypatch):
    odd = ["<|endoftext|>", "a <|endoftext|> b", " " * 3000 + "x", "é" * 2000, "x  y  z", "I'll don't 'S"]
    for text in [*filter(None, texts), *odd]:
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "LONG_TEXT", 50)
    for text in [*filter(None, texts), *odd]:
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert encoder.encode("").tolist() == []


def test_very_long_texts(encoder, library):
    words = " ".join(f"w{i} héllo\n\n it's" for i in range(150_000))  # over 2 MB
    assert encoder.encode(words).tolist() == library.encode(words, add_special_tokens=False).ids
    blank = "a" + " " * 1_200_000 + "b"  # too long a run for the pattern matcher
    ids = encoder.encode(blank)
    assert library.decode(ids.tolist()) == blank


@pytest.mark.parametrize("capacity, block", [(2048, 2048), (64, 8), (7, 5)])
def test_pieces_and_sequences(spark, docs, library, capacity, block):
    packed = packing.pack(docs, FILE, capacity, block=block).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    assert got == expected_pieces(rows, library, capacity)
    used = check_sequences(packed, capacity)
    total = sum(r["length"] for r in packed)
    assert -(-total // capacity) <= used <= -(-total // capacity) * 1.15 + 2


def test_reruns_agree_and_empty_tables(spark, docs, no_docs):
    first = packing.pack(docs, FILE, 64, block=8).select("doc_id", "piece", "ids_crc32", "offset")
    again = packing.pack(docs, FILE, 64, block=8).select("doc_id", "piece", "ids_crc32", "offset")
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    assert packing.pack(no_docs, FILE).collect() == []


def test_sequences_hold_the_ids(spark, docs, library):
    packed = packing.pack(docs, FILE, 64, block=8, keep_ids=True)
    pieces = {(r["sequence_id"], r["offset"]): r for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) <= 64
        for start, end in zip(r["starts"], [*r["starts"][1:], len(r["ids"])], strict=True):
            piece = pieces[r["sequence_id"], start]
            assert r["ids"][start:end] == piece["ids"]
            assert zlib.crc32(np.array(piece["ids"], "<u4").tobytes()) == piece["ids_crc32"]


def test_query_needs_few_sequences(spark, sf_dir):
    rows = op11_packing(spark, sf_dir).collect()
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert check_sequences(rows, 2048) <= least + 1


def whole(group, length, capacity):
    assert len(group) == len(length) and packing.fill_of(group, length).max() <= capacity
    assert set(group.tolist()) == set(range(group.max() + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=2, max_size=60), st.integers(0, 1000))
def test_crossover_and_mutation_keep_every_piece(lengths, seed):
    length, rng = np.array(lengths), np.random.default_rng(seed)
    a = packing.packed_in_order(rng.permutation(len(length)), length, 100)
    b = packing.packed_in_order(np.argsort(-length), length, 100)
    whole(a, length, 100)
    whole(packing.crossover(a, b, length, 100, rng), length, 100)
    whole(packing.mutation(a, length, 100, rng), length, 100)


def test_crossover_injects_whole_sequences():
    length = np.array([60, 40, 70, 30, 50, 50, 20, 10])
    giver = np.array([0, 0, 1, 1, 2, 2, 3, 3])
    taker = np.array([0, 1, 2, 3, 0, 3, 1, 2])
    taker = packing.numbered(taker)
    child = packing.crossover(taker, giver, length, 120, np.random.default_rng(0))
    whole(child, length, 120)
    pairs = [(0, 1), (2, 3), (4, 5)]
    assert any(child[i] == child[j] for i, j in pairs)


def test_evolution_mends_what_best_fit_decreasing_misses():
    # best fit by falling length needs 3 sequences here, 2 are enough
    length = np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6])
    best = packing.evolve(length, 90, [], np.random.default_rng(0), generations=40)
    whole(best, length, 90)
    assert best.max() + 1 == -(-length.sum() // 90)
    start = packing.packed_in_order(np.argsort(-length, kind="stable"), length, 90)
    assert packing.cost(best, length) <= packing.cost(start, length)


def test_migrants_join_the_population():
    length = np.array([60, 40, 70, 30, 50, 50])
    perfect = np.array([0, 0, 1, 1, 2, 2])
    poor = np.arange(6)
    best = packing.evolve(length, 100, [poor, perfect], np.random.default_rng(0), generations=0)
    assert best.tolist() == perfect.tolist()
