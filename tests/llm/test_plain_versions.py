"""Language model and fingerprints against plain Python, and texts that fool a polynomial hash."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import docs, no_docs, sf_dir, texts  # noqa: F401
from test_documents import pairs_of, removed

from tidemark.llm import fingerprints, jaccard, language, repeats
from tidemark.llm.common import GOLDEN, mixed, shingles, utf8

M32 = 0xFFFFFFFF


def plain_features(text):
    points = [ord(c) for c in text.lower()]
    counts = Counter()
    for n in language.NGRAMS:
        for i in range(len(points) - n + 1):
            rolled = 0
            for k in range(n):
                rolled = (rolled + points[i + k] + k + 1) * 0x9E3779B1 & M32
            bucket = rolled ^ (rolled >> 15)
            bucket = (bucket * 0x85EBCA77 & M32) >> (32 - int(math.log2(language.BUCKETS)))
            counts[bucket] += 1
    return dict(counts)


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_features_equal_dictionary_counts(spark, sf_dir, texts, monkeypatch, piece):
    monkeypatch.setattr(language, "SLICE", piece)
    monkeypatch.setattr(language, "ROWS", 5)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(12).collect()
    sample = [t or "" for t in texts] + [r.text[:900] for r in rows]
    at, cols, counts = language.features(sample)
    for i, text in enumerate(sample):
        mine = at == i
        assert dict(zip(cols[mine].tolist(), counts[mine].tolist(), strict=True)) == plain_features(text)


def plain_ftrl(rows, target, k, epochs, alpha, beta, l1, l2):
    """The same updates, a number at a time."""
    z, n = {}, {}

    def weight(c, j):
        zs = z.get((c, j), 0.0)
        if abs(zs) <= l1:
            return 0.0
        return (math.copysign(l1, zs) - zs) / ((beta + math.sqrt(n.get((c, j), 0.0))) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x = [*zip(*(a.tolist() for a in rows[i]), strict=True), (language.BUCKETS, 0.1)]
            logits = [sum(v * weight(c, j) for c, v in x) for j in range(k)]
            top = max(logits)
            e = [math.exp(v - top) for v in logits]
            current = {(c, j): weight(c, j) for c, _ in x for j in range(k)}
            for c, v in x:
                for j in range(k):
                    g = v * (e[j] / sum(e) - (j == target[i]))
                    old = n.get((c, j), 0.0)
                    n[c, j] = old + g * g
                    z[c, j] = z.get((c, j), 0.0) + g - (math.sqrt(n[c, j]) - math.sqrt(old)) / alpha * current[c, j]
    return weight


def test_training_equals_scalar_updates(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL").limit(50).collect()
    names = sorted({r.lang for r in rows})
    target = np.array([names.index(r.lang) for r in rows])
    vectors = []
    for r in rows:
        counts = plain_features(r.text[:150])
        values = {c: 1 + math.log(v) for c, v in counts.items()}
        size = math.sqrt(sum(v * v for v in values.values()))
        cols = np.array(sorted(values))
        vectors.append((cols, np.array([values[c] / size for c in cols.tolist()])))
    settings = {"epochs": 2, "alpha": 1.0, "beta": 1.0, "l1": 0.02, "l2": 0.02}
    w, b = language.ftrl(vectors, target, len(names), **settings)
    weight = plain_ftrl(vectors, target.tolist(), len(names), **settings)
    seen = sorted({c for cols, _ in vectors for c in cols.tolist()})
    for j in range(len(names)):
        assert w[seen, j].tolist() == pytest.approx([weight(c, j) for c in seen], abs=1e-9)
        assert b[j] == pytest.approx(0.1 * weight(language.BUCKETS, j), abs=1e-9)
    assert (w == 0).mean() > 0.5  # the penalty leaves most weights at zero


def plain_fingerprint(text):
    terms, _ = shingles(*utf8(pa.array([text])), fingerprints.WORDS)
    votes = [0] * fingerprints.BITS
    for term in terms:
        for lane in range(fingerprints.BITS // 64):
            with np.errstate(over="ignore"):
                raw = mixed(np.array([term + np.uint64(lane + 1) * GOLDEN]))[0].tobytes()
            for i, byte in enumerate(raw):
                for bit in range(8):
                    votes[lane * 64 + i * 8 + bit] += 1 if byte >> (7 - bit) & 1 else -1
    bits = "".join("1" if v > 0 else "0" for v in votes)
    return int(bits, 2).to_bytes(fingerprints.BITS // 8, "big").hex()


def test_fingerprints_equal_plain_votes(spark, docs):
    for row in fingerprints.fingerprint(docs.select("doc_id", "text")).collect():
        assert row.fingerprint == plain_fingerprint(row.text or "")


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_words_that_fool_a_polynomial_hash(spark, n):
    """The two words differ in every letter, yet have one hash modulo 2^64."""
    a, b = thue_morse(n)
    rows = [(1, a), (2, b), (3, f"one {a} two three"), (4, f"one {b} two three"), (5, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.near_components(df).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(df).collect()}
    assert prints[1] == prints[5] and len(set(prints.values())) == 4


def test_texts_that_fool_a_polynomial_hash_keep_apart(spark):
    a, b = thue_morse(2048)
    df = spark.createDataFrame([(None, a), (None, b), (7, "x" * 150 + a[:60] + "y"), (8, b)], "doc_id long, text string")
    rows = [tuple(r) for r in df.collect()]
    out = repeats.without_repeats(df)
    assert pairs_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(rows, 200)
