"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader, calibrated by a
temperature.

Document frequencies cover all training rows. The classifier is fitted on a
bounded sample of them: the ``sample`` rows of each language whose hashed id is
smallest. Prediction reads nothing but the whole text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 13  # n-grams are hashed into so many features
NGRAMS = (1, 2, 3)
SAMPLE = 512  # rows of each language the classifier is fitted on, at most
UNKNOWN = "und"
SLICE = 1 << 20  # characters counted at once
ROWS = 64  # texts counted at once


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, mostly zero
    bias: np.ndarray
    idf: np.ndarray
    temperature: float


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature and count of all n-grams of the lower-cased texts.

    Counted ``ROWS`` texts at a time, so that the table of counts has a fixed size, and
    a long text part by part.
    """
    lowered = [text.lower() for text in texts]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    begin = size = 0
    for i, text in enumerate(lowered):
        size += len(text)
        if i + 1 < len(lowered) and i + 1 - begin < ROWS and size + len(lowered[i + 1]) <= SLICE:
            continue
        counts = np.zeros((i + 1 - begin) * BUCKETS, np.int64)
        if size <= SLICE:
            add_grams(counts, "".join(lowered[begin : i + 1]), [len(t) for t in lowered[begin : i + 1]], size)
        else:
            for at in range(0, size, SLICE):  # one long text; a part also sees what its last n-grams reach into
                part = text[at : at + SLICE + max(NGRAMS) - 1]
                add_grams(counts, part, [len(part)], SLICE)
        cells = np.flatnonzero(counts)
        found.append((cells + begin * BUCKETS, counts[cells]))
        begin, size = i + 1, 0
    cells = np.concatenate([c for c, _ in found]) if found else np.zeros(0, np.int64)
    counts = np.concatenate([n for _, n in found]) if found else np.zeros(0, np.int64)
    return cells // BUCKETS, cells % BUCKETS, counts


def add_grams(counts: np.ndarray, text: str, lengths: list[int], starts: int) -> None:
    """Add to ``counts`` the n-grams of texts laid end to end that start before ``starts``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    rolled = np.zeros(len(points), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        rolled = (rolled[:size] + points[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        if n in NGRAMS:
            within = doc[:size] == doc[n - 1 :]
            within[starts:] = False
            bucket = rolled[within] ^ (rolled[within] >> np.uint32(15))
            bucket = (bucket * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            counts += np.bincount(doc[:size][within] * BUCKETS + bucket, minlength=len(counts))


def weighted(rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Sub-linear TF-IDF of unit length per text."""
    values = (1 + np.log(counts)) * idf[cols]
    length = np.sqrt(np.bincount(rows, values * values, minlength=n))
    return values / np.maximum(length, 1e-12)[rows]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict_texts(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    known = [t if t and has_letter(t) else "" for t in texts]
    rows, cols, counts = features(known)
    values = weighted(rows, cols, counts, model.idf, len(texts))
    k = len(model.languages)
    logits = np.zeros((len(texts), k)) + model.bias
    for j in range(k):
        logits[:, j] += np.bincount(rows, values * model.weights[cols, j], minlength=len(texts))
    chance = softmax(logits / model.temperature)
    best = chance.argmax(axis=1)
    names = [model.languages[b] if t else UNKNOWN for b, t in zip(best, known, strict=True)]
    return names, np.where([bool(t) for t in known], chance[np.arange(len(texts)), best], 0.0)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]],
    target: np.ndarray,
    k: int,
    epochs: int = 4,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after ``epochs`` passes of FTRL-proximal with elastic net."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def current(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            cols, values = rows[i]
            at, x = np.append(cols, BUCKETS), np.append(values, 0.1)  # the last is the bias
            w = current(at)
            error = softmax(x @ w)
            error[target[i]] -= 1
            g = x[:, None] * error
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
    w = current(np.arange(BUCKETS + 1))
    return w[:-1], 0.1 * w[-1]


def calibrate(logits: np.ndarray, target: np.ndarray) -> float:
    """Temperature of least log loss on rows the weights were not fitted on."""
    if not len(target):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(softmax(logits / t)[np.arange(len(target)), target] + 1e-300).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learn from the rows of ``docs`` whose text and language are not null.

    Eager: three small jobs. What reaches the driver is bounded: one document
    frequency per feature, and the features of ``sample`` rows per language. No
    usable row gives a model without languages, which predicts ``und``.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")
    ).where("text IS NOT NULL AND lang IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(BUCKETS, np.int64), 0
        for part in slices(batches, 0, SLICE):
            _, cols, _ = features(part.column(0).to_pylist())
            total += np.bincount(cols, minlength=BUCKETS)
            seen += part.num_rows
        if seen:
            yield pa.RecordBatch.from_pydict(
                {"feature": np.arange(-1, BUCKETS), "n": np.concatenate([[seen], total])}
            )

    table = rows.select("text").mapInArrow(frequencies, "feature long, n long")
    found = dict(table.groupBy("feature").agg(F.sum("n")).where("`sum(n)` > 0").collect())
    seen = found.pop(-1, 0)
    df = np.zeros(BUCKETS)
    df[list(found)] = list(found.values())
    idf = np.log((1 + seen) / (1 + df)) + 1

    order = F.xxhash64("id")
    ranked = rows.select("id", "lang", order.alias("order")).selectExpr(
        "id", "lang", "row_number() OVER (PARTITION BY lang ORDER BY order, id) AS rank"
    )
    chosen = ranked.where(F.col("rank") <= sample).groupBy("id").agg(F.min("rank").alias("rank"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            at, cols, counts = features(part.column("text").to_pylist())
            cuts = np.searchsorted(at, np.arange(1, part.num_rows))
            arrays = [pa.array([c.tolist() for c in np.split(x, cuts)], pa.list_(pa.int32())) for x in (cols, counts)]
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), part.column("rank"), *arrays], ["lang", "rank", "cols", "counts"]
            )

    picked = rows.join(F.broadcast(chosen), "id").select("lang", "rank", "text")  # bounded by ``sample``
    data = picked.mapInArrow(sparse, "lang string, rank int, cols array<int>, counts array<int>").toArrow()
    names = data.column("lang").to_pylist()
    languages = sorted(set(names), key=lambda s: s.encode())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), idf, 1.0)
    vectors = []
    for cols, counts in zip(data.column("cols"), data.column("counts"), strict=True):
        c, x = np.array(cols.as_py(), np.int64), np.array(counts.as_py(), np.float64)
        vectors.append((c, weighted(np.zeros(len(c), np.int64), c, x, idf, 1)))
    target = np.array([languages.index(name) for name in names])
    # a stable order of the rows, whatever the order in which they arrive
    key = sorted(range(len(names)), key=lambda i: (data.column("rank")[i].as_py(), names[i], vectors[i][0].tobytes()))
    vectors, target = [vectors[i] for i in key], target[key]
    apart = np.arange(len(vectors)) % 5 == 4
    k = len(languages)
    w, b = ftrl([v for v, a in zip(vectors, apart, strict=True) if not a], target[~apart], k)
    logits = np.array([v @ w[c] + b for (c, v), a in zip(vectors, apart, strict=True) if a]).reshape(-1, k)
    return Model(languages, w.astype(np.float32), b, idf.astype(np.float32), calibrate(logits, target[apart]))


def predictor(model: Model):
    """A column function: text to ``struct<lang_pred string, score double>``."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        values = [t or "" for t in texts]
        names: list[str] = []
        scores: list[np.ndarray] = []
        begin = size = 0
        for i, value in enumerate(values):
            size += len(value)
            if size >= SLICE // 2 or i == len(values) - 1:
                if model.languages:
                    name, score = predict_texts(model, values[begin : i + 1])
                else:
                    name, score = [UNKNOWN] * (i + 1 - begin), np.zeros(i + 1 - begin)
                names += name
                scores.append(score)
                begin, size = i + 1, 0
        return pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else []})

    return predict


def held_out(doc_id: str | Column, folds: int = 5) -> Column:
    """Whether the CRC-32 of the id as text leaves no remainder; a null id is held out."""
    column = F.col(f"`{doc_id}`") if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == 0, F.lit(True))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``, learned from its own rows.

    Rows that are held out, or whose language or text is null, are not learned
    from. Null text and text without a letter are ``und`` with score 0. Ties go to
    the language first by code point. Repeated rows are rows like any other; an
    empty table stays empty. A column of ``docs`` named like a new one is replaced.
    """
    model = train(docs.where(~held_out(doc_id)), text, lang, doc_id, sample)
    keep = [c for c in docs.columns if c.lower() not in {"held_out", "lang_pred", "score"}]
    answer = predictor(model)(docs[f"`{text}`"]).alias("answer")
    inner = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), held_out(docs[f"`{doc_id}`"]).alias("held_out"), answer)
    return inner.select("row.*", "held_out", "answer.lang_pred", "answer.score")


def drop_unidentified(docs: DataFrame, least: float = 0.5, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose language is known with a calibrated chance of ``least`` or more."""
    model = train(docs.where(~held_out(doc_id)), text, lang, doc_id)
    inner = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), predictor(model)(docs[f"`{text}`"]).alias("answer"))
    return inner.where(F.col("answer.score") >= least).select("row.*")
