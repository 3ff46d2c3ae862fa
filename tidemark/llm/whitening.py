"""Embedding whitening by QDWH spectral divide and conquer.

The polar factor of a symmetric matrix shifted by a value inside its spectrum is the
matrix sign: plus one on the eigenvectors above the shift, minus one below. Half of
its sum with the identity projects on the former. The matrix is split along both
subspaces, and each part again, down to single components. Polar factors come from the
QR-based dynamically weighted Halley iteration, which needs a handful of steps however
small the gap at the shift is.

Tasks sum up counts, vectors and centred products; only sums of one number or one row
per dimension reach the driver, and what is broadcast is one matrix of dimensions by
components.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT = 64, 1_000_000  # entry c becomes floor(SCALE * c) + SHIFT
COMPONENTS = 32
LARGEST = 1 << 49  # of scaled entries, so that sums over a batch are exact
NO_VARIANCE = 1e-12  # an eigenvalue below this share of the largest is taken as zero
EPS = float(np.finfo(float).eps)


# --- spectral divide and conquer --------------------------------------------------


def polar(a: np.ndarray, most_steps: int = 40) -> np.ndarray | None:
    """Orthogonal polar factor of a symmetric matrix; None if it is singular."""
    n = len(a)
    norm = np.sqrt(np.abs(a).sum(axis=0).max() * np.abs(a).sum(axis=1).max())
    if norm == 0:
        return None
    x = a / norm
    try:
        inverse = np.linalg.inv(x)
    except np.linalg.LinAlgError:
        return None
    # lower bound of the singular values of x
    least = min(1.0, 1 / np.sqrt(np.abs(inverse).sum(axis=0).max() * np.abs(inverse).sum(axis=1).max()))
    if not least > 16 * n * EPS:
        return None
    eye = np.eye(n)
    for _ in range(most_steps):
        square = least * least
        gamma = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + gamma)
        alpha = root + np.sqrt(8 - 4 * gamma + 8 * (2 - square) / (square * root)) / 2
        beta = (alpha - 1) ** 2 / 4
        c = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = beta / c * x + (alpha - beta / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        change = np.linalg.norm(new - x)
        x, least = new, min(1.0, least * (alpha + beta * square) / (1 + c * square))
        if abs(1 - least) < 10 * EPS and change < np.cbrt(5 * EPS):
            return x
    return None


def split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span the eigenvectors above ``shift``,
    and how many they are; None if the shift does not part the spectrum cleanly."""
    n = len(a)
    sign = polar(a - shift * np.eye(n))
    if sign is None:
        return None
    projector = (sign + np.eye(n)) / 2
    above = int(round(np.trace(projector)))
    if not 0 < above < n:
        return None
    basis, _ = np.linalg.qr(projector @ rng.standard_normal((n, above)))
    for _ in range(2):  # subspace iteration: the projector has eigenvalues 0 and 1
        basis, _ = np.linalg.qr(projector @ basis)
    whole, _ = np.linalg.qr(basis, mode="complete")
    off = whole[:, above:].T @ a @ whole[:, :above]
    return (whole, above) if np.linalg.norm(off) <= 100 * n * EPS * np.linalg.norm(a) else None


def divide(a: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Eigenvectors, in columns, of a symmetric matrix."""
    n = len(a)
    off = a - np.diag(np.diag(a))
    if n == 1 or np.abs(off).max() <= EPS * scale:
        return np.eye(n)
    radius = np.abs(off).sum(axis=1)
    low, high = (np.diag(a) - radius).min(), (np.diag(a) + radius).max()
    middle = np.sort(np.diag(a))
    shifts = [np.median(middle), middle.mean(), *(middle[:-1] + middle[1:]) / 2]
    shifts += [low + (high - low) * t for t in rng.random(64)]
    for shift in shifts:
        found = split(a, float(shift), rng)
        if found:
            basis, above = found
            inner = basis.T @ a @ basis
            inner = (inner + inner.T) / 2
            upper = divide(inner[:above, :above], scale, rng)
            lower = divide(inner[above:, above:], scale, rng)
            return np.hstack([basis[:, :above] @ upper, basis[:, above:] @ lower])
    return np.eye(n)  # no shift parts it: all its eigenvalues are one, up to rounding


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns of a symmetric matrix."""
    scale = np.abs(a).max(initial=0.0)
    vectors = divide(a, scale, np.random.default_rng(0)) if len(a) else np.zeros((0, 0))
    for _ in range(2):  # first-order correction of what rounding has left between components
        inner = vectors.T @ a @ vectors
        values = np.diag(inner)
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > 1e-8 * scale
        turn = np.where(apart, inner / np.where(apart, gap, 1.0), 0.0)
        vectors = vectors + vectors @ turn
        vectors = vectors @ (3 * np.eye(len(a)) - vectors.T @ vectors) / 2
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- vectors ----------------------------------------------------------------------


def scaled(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of lists: the scaled integers of all entries, where each list begins,
    and which lists are usable (of ``dims`` entries, if given)."""
    n = len(column)
    lists = column.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)  # a null entry is a NaN
    offsets = offsets - offsets[0]
    bad = ~np.isfinite(flat)
    before = np.concatenate([[0], np.cumsum(bad)])
    usable = np.asarray(column.is_valid()) & (before[offsets[1:]] == before[offsets[:-1]])
    if dims is not None:
        usable &= np.diff(offsets) == dims
    large = np.abs(np.where(bad, 0, flat)) >= LARGEST / SCALE
    if large.any() and np.logical_or.reduceat(np.append(large, False), offsets[:-1])[usable & (np.diff(offsets) > 0)].any():
        raise ValueError(f"entries must be below {LARGEST // SCALE} in size")
    whole = np.floor(np.where(bad | large, 0.0, flat) * SCALE).astype(np.int64) + SHIFT
    return whole, offsets[:n], usable


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors as rows of scaled integers, and where they stand."""
    whole, begins, usable = scaled(column, dims)
    at = np.flatnonzero(usable)
    return whole[begins[at][:, None] + np.arange(dims)], at


def totals(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many usable vectors there are, and their exact sums by dimension.

    If vectors differ in length, those of the most frequent length are usable, the
    longer one on ties.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            column = batch.column(0)
            whole, begins, usable = scaled(column)
            sizes = np.append(begins[1:], len(whole)) - begins
            for dims in np.unique(sizes[usable]).tolist():
                at = begins[usable & (sizes == dims)]
                sums = whole[at[:, None] + np.arange(dims)].sum(axis=0).tolist()
                n, old = held.get(dims, (0, [0] * dims))
                held[dims] = n + len(at), [a + b for a, b in zip(old, sums, strict=True)]
        for dims, (n, sums) in held.items():
            rows = {"dims": [dims] * (dims + 1), "at": range(-1, dims), "total": [str(n), *map(str, sums)]}
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("dims", pa.int32()), ("at", pa.int32()), ("total", pa.string())]))

    parts = vectors.mapInArrow(add, "dims int, at int, total string")
    added = parts.groupBy("dims", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    counts = added.where("at = -1").orderBy(F.desc("total"), F.desc("dims")).limit(1).collect()
    if not counts:
        return 0, []
    dims, n = counts[0]["dims"], int(counts[0]["total"])
    found = {r["at"]: int(r["total"]) for r in added.where((F.col("dims") == dims) & (F.col("at") >= 0)).collect()}
    return n, [found[i] for i in range(dims)]


def added_rows(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums of the vectors ``row`` of each ``at``: one row per dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = row.values.to_numpy()
                held[at] = held[at] + row if at in held else row
        if held:
            yield pa.RecordBatch.from_pydict({"at": pa.array(list(held), pa.int32()), "row": pa.array([r.tolist() for r in held.values()], pa.list_(pa.float64()))})

    return {r["at"]: np.array(r["row"]) for r in parts.repartition("at").mapInArrow(add, PART).collect()}


PART = "at int, row array<double>"


def part_rows(gram: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """One task's products, a row per dimension, and its sums as row -1."""
    rows = [sums.tolist(), *gram.tolist()]
    return pa.RecordBatch.from_pydict({"at": pa.array(range(-1, len(gram)), pa.int32()), "row": pa.array(rows, pa.list_(pa.float64()))})


def centred_products(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor ``n``.

    Vectors are centred on the whole number nearest to the mean before they are
    multiplied. Products and sums are then whole numbers, exact in doubles up to 2^53
    and so the same in any order; what the true mean differs, a half at most, comes off
    at the end.
    """
    dims = len(sums)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, seen = np.zeros((dims, dims)), 0
        for batch in batches:
            x, _ = matrix(batch.column(0), dims)
            y = (x - centre).astype(float)
            gram += y.T @ y
            seen += len(y)
        if seen:
            yield part_rows(gram, np.zeros(dims))

    found = added_rows(vectors.mapInArrow(add, PART))
    rest = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre, strict=True)])
    covariance = np.array([found[i] for i in range(dims)]) / n - np.outer(rest, rest)
    return (covariance + covariance.T) / 2


# --- the model --------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]  # of scaled entries, by dimension
    values: np.ndarray  # eigenvalues kept, falling
    vectors: np.ndarray  # dimensions x components
    explained: np.ndarray
    identity_error: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as a whole number and what it lacks, by dimension."""
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = [(s - self.n * w) / self.n for s, w in zip(self.sums, whole, strict=True)]
        return np.array(whole, np.int64), np.array(rest)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.centre()
        return ((x - whole).astype(float) - rest) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n*x - S)^2, exact; null where a long cannot hold it."""
        whole, _ = self.centre()
        lack = np.array([s - self.n * int(w) for s, w in zip(self.sums, whole, strict=True)], np.int64)
        y = x - whole
        near = ((self.n * y.astype(float) - lack) ** 2).sum(axis=1)
        fits = near < 9.2e18  # surely below 2^63, as is every part of the sum
        out: list[int | None] = [None] * len(x)
        z = np.where(fits[:, None], y, 0) * self.n - lack
        exact = (z * z).sum(axis=1)
        for i in np.flatnonzero(fits):
            out[i] = int(exact[i])
        for i in np.flatnonzero(~fits & (near < 9.3e18)):
            value = sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(y[i], lack, strict=True))
            out[i] = value if value < 1 << 63 else None
        return pa.array(out, pa.int64())


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Eager: three passes over the vectors, for sums, products and the check of the
    result. None if there is no usable vector, or none that differs from another."""
    vectors = embeddings.select(embeddings[f"`{vector}`"])
    n, sums = totals(vectors)
    if not sums:
        return None
    covariance = centred_products(vectors, n, sums)
    values, basis = eigen(covariance)
    kept = int((values > NO_VARIANCE * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    kept = min(kept, components)
    if not kept:
        return None
    share = values[:kept] / np.trace(covariance)
    model = Whitening(n, sums, values[:kept], basis[:, :kept], share, 0.0)
    return Whitening(n, sums, values[:kept], basis[:, :kept], share, identity_error(vectors, model))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry, in size, of the whitened vectors' covariance minus the identity."""
    k, dims = len(model.values), len(model.sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, sums, seen = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            x, _ = matrix(batch.column(0), dims)
            w = model.whiten(x)  # centred on the exact mean already
            gram += w.T @ w
            sums += w.sum(axis=0)
            seen += len(w)
        if seen:
            yield part_rows(gram, sums)

    found = added_rows(vectors.mapInArrow(add, PART))
    mean = found[-1] / model.n
    covariance = np.array([found[i] for i in range(k)]) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(embeddings: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """The rows with a usable vector, with ``deviation`` and the vector ``whitened``.

    Rows whose vector is null, holds null or non-finite entries, or is of another
    length than the model's are dropped. Repeated rows and ids are rows of their own.
    Other columns stay, but a column named like a new one is replaced. No model, hence
    no component, gives no rows. A component without variance has no whitened values
    and is left out, so there may be fewer than asked for. Entries of 2^43 or more are
    refused.
    """
    keep = [c for c in embeddings.columns if c.lower() not in {"deviation", "whitened"}]
    dims = len(model.sums) if model else 0

    @F.arrow_udf("deviation long, whitened array<double>")
    def project(column: pa.Array) -> pa.Array:
        x, at = matrix(column, dims)
        place = np.full(len(column), -1)
        place[at] = np.arange(len(at))
        take = pa.array(place, pa.int64(), mask=place < 0)
        rows = model.whiten(x)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))
        return pa.StructArray.from_arrays([model.deviations(x).take(take), lists.take(take)], ["deviation", "whitened"])

    if model is None:
        none = F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")
        return embeddings.select(*[embeddings[f"`{c}`"] for c in keep], *none).where(F.lit(False))
    row = F.struct(*[embeddings[f"`{c}`"] for c in keep]).alias("row")
    out = embeddings.select(row, project(embeddings[f"`{vector}`"]).alias("answer"))
    return out.where("answer.whitened IS NOT NULL").select("row.*", "answer.deviation", "answer.whitened")


def components_of(embeddings: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation,
    whitened, explained, identity_error``. What ``whiten`` says of odd rows holds."""
    rows = embeddings.select(embeddings[f"`{vec_id}`"].alias("vec_id"), embeddings[f"`{vector}`"].alias("vector"))
    model = fit(rows, "vector", components)
    explained = F.array(*[F.lit(float(e)) for e in model.explained]) if model else F.array().cast("array<double>")
    long = whiten(rows, model, "vector").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, "at").alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
