"""Embedding whitening from an exact scatter matrix, computed in residues.

Entries become whole numbers x = floor(1024 c) + 100000. Every partition multiplies its rows, augmented by a column of
ones, modulo several primes just under 2^20 (residues are centred, so a block of `BLOCK` rows of double matrix products
stays under 2^53 and is exact). The residues of n, the sums S and the scatter are summed by Spark, reconstructed on the
driver by Chinese remaindering into whole numbers, and n G - S S' over n^2, the covariance, is rounded once per entry
before a double eigendecomposition. How many primes are needed follows from the number of rows and the largest entry,
which a first pass over the table finds. What reaches the driver grows with the square of the dimension, never with rows.

Cases: vectors that are null, empty, hold null or non-finite entries, or have another length than most vectors (of
equally frequent lengths the smallest) take no part and give no rows; an empty table gives none. An entry beyond a
quarter of the range of a long is set to that bound. Repeated rows and repeated ids each count and each give rows. A
component without variance (fewer independent vectors than components) has null `whitened` and takes no part in
`identity_error`. `deviation` is null where it exceeds a long. Vectors of fewer than 8 entries have as many components as
entries. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import discard, stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCK = 16_384  # rows of a product: BLOCK * (2^19)^2 is under 2^53
_FAR = 1 << 61


def vectors(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: lengths (-1 where a vector takes no part), the rows of length `dim` that do, and their entries (rows x dim, as doubles)."""
    flat = pc.list_flatten(column)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entry = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entry))])
    end = np.cumsum(size)
    good = (size > 0) & (bad[end] == bad[end - size])
    if dim is None:
        return np.where(good, size, -1), np.zeros(0, np.int64), np.zeros((0, 0))
    rows = np.flatnonzero(good & (size == dim))
    at = (end - size)[rows][:, None] + np.arange(dim)
    return np.where(good, size, -1), rows, entry[at] if len(rows) else np.zeros((0, dim))


def whole(entries: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as longs."""
    return np.clip(np.floor(entries * SCALE), -_FAR, _FAR).astype(np.int64) + SHIFT


def primes(bound: int) -> list[int]:
    """Primes from 2^20 downwards whose product exceeds twice the bound."""
    out, product, p = [], 1, (1 << 20) - 1
    while product <= 2 * bound:
        if all(p % q for q in range(3, isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def residue_products(x: np.ndarray, p: int) -> np.ndarray:
    """[1 x]' [1 x] modulo p, exact: blocks of rows whose double products can't round."""
    total = np.zeros((x.shape[1] + 1, x.shape[1] + 1), np.int64)
    for a in range(0, len(x), BLOCK):
        r = x[a : a + BLOCK] % p
        r = np.where(r > p // 2, r - p, r).astype(np.float64)
        r = np.concatenate([np.ones((len(r), 1)), r], axis=1)
        total = (total + (r.T @ r).astype(np.int64)) % p
    return total


def remainder(residues: list[int], moduli: list[int]) -> int:
    """The whole number of least absolute value with these residues."""
    value, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if value > product // 2 else value


@dataclass
class Whitening:
    """n, the exact sums and n^2 times the exact covariance, its eigenvalues (falling) and unit eigenvectors (columns)."""

    n: int
    sums: list[int]
    scatter: list[list[int]]
    values: np.ndarray
    axes: np.ndarray
    largest: int

    @property
    def trace(self) -> float:
        return sum(self.scatter[i][i] for i in range(len(self.sums))) / self.n**2

    def usable(self) -> np.ndarray:
        """Components with a variance that rounding can't have made."""
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps * 16

    def explained(self) -> np.ndarray:
        return np.clip(self.values, 0, None) / self.trace if self.trace > 0 else np.zeros(len(self.values))


def measure(frame: DataFrame, vector: str = "embedding") -> tuple[int, int, int]:
    """(dimension, vectors of it, largest absolute whole entry); zeros where there is no vector."""

    def run(batches):
        for batch in batches:
            size = vectors(batch.column(0))[0]
            for dim in np.unique(size[size > 0]).tolist():
                entries = vectors(batch.column(0), dim)[2]
                yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([len(entries)]), pa.array([int(np.abs(whole(entries)).max())])], names=["dim", "n", "largest"])

    found = frame.select(vector).mapInArrow(run, "dim long, n long, largest long").groupBy("dim").agg(F.sum("n").alias("n"), F.max("largest").alias("largest"))
    best = found.orderBy(F.desc("n"), "dim").first()
    return (best.dim, best.n, best.largest) if best else (0, 0, 0)


def fit(frame: DataFrame, vector: str = "embedding") -> Whitening | None:
    """Exact sums and covariance of all vectors, and its eigenvectors; None where there is no vector."""
    dim, n, largest = measure(frame, vector)
    if not n:
        return None
    moduli = primes(max(n, 1) * max(largest, 1) ** 2)
    upper = np.triu_indices(dim + 1)

    def run(batches):
        total = np.zeros((len(moduli), dim + 1, dim + 1), np.int64)
        for batch in batches:
            x = whole(vectors(batch.column(0), dim)[2])
            for k, p in enumerate(moduli):
                total[k] = (total[k] + residue_products(x, p)) % p
        for k in range(len(moduli)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), k)), pa.array(upper[0]), pa.array(upper[1]), pa.array(total[k][upper])], names=["k", "i", "j", "r"])

    sums = frame.select(vector).mapInArrow(run, "k long, i long, j long, r long").groupBy("i", "j", "k").agg(F.sum("r").alias("r"))
    residues: dict[tuple[int, int], list[int]] = {}
    for row in sums.collect():  # a row for each pair of dimensions and prime
        residues.setdefault((row.i, row.j), [0] * len(moduli))[row.k] = row.r
    exact = {at: remainder([r % p for r, p in zip(rs, moduli, strict=True)], moduli) for at, rs in residues.items()}
    s = [exact[0, i + 1] for i in range(dim)]
    scatter = [[exact[min(i, j) + 1, max(i, j) + 1] * n - s[i] * s[j] for j in range(dim)] for i in range(dim)]
    values, axes = np.linalg.eigh(np.array([[v / n**2 for v in row] for row in scatter]))
    return Whitening(n, s, scatter, values[::-1].copy(), axes[:, ::-1].copy(), largest)


def deviations(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """n x - S as doubles, and the sum of its squares by row: exact, None where it exceeds a long.

    Long products wrap modulo 2^64, so a sum that a double estimate shows to be under 2^63 comes out exact; sums that the
    estimate can't tell, and rows whose n x exceeds a long, are added as Python's whole numbers."""
    if model.n * model.largest + max(map(abs, model.sums)) < 1 << 62:
        d = x * model.n - np.array(model.sums)
        about = (d.astype(np.float64) ** 2).sum(axis=1)
        square: list[int | None] = [v if e < 2.0**63 else None for v, e in zip((d * d).sum(axis=1).tolist(), about.tolist(), strict=True)]
        for i in np.flatnonzero(np.abs(about / 2.0**63 - 1) < 1e-9).tolist():
            v = sum(w * w for w in d[i].tolist())
            square[i] = v if v < 1 << 63 else None
        return d.astype(np.float64), square
    d = x.astype(object) * model.n - np.array(model.sums, dtype=object)
    return d.astype(np.float64), [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def whiten(frame: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, deviation and the whitened coordinates (an array, null entries for components without variance) of every vector that takes part."""
    dim = len(model.sums)
    k = min(components, dim)
    usable = model.usable()[:k]
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        turn = model.axes[:, :k] / np.sqrt(np.where(usable, model.values[:k], 1.0))
        for batch in batches:
            _, rows, entries = vectors(batch.column(1), dim)
            if not len(rows):
                continue
            d, square = deviations(whole(entries), model)
            coordinates = (d / model.n) @ turn
            flat = pa.array(coordinates.ravel(), mask=np.tile(~usable, len(rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(square, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), flat)], names=[key, "deviation", "whitened"])

    kind = frame.schema[key].dataType.simpleString()
    return frame.select(key, vector).mapInArrow(run, f"`{key}` {kind}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, usable: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened coordinates' covariance minus the identity."""
    at = np.flatnonzero(usable).tolist()
    if not at:
        return None
    pairs = [(i, j) for i in at for j in at if i <= j]
    row = whitened.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(row, pairs, strict=True)) if row[0] is not None else None


def report(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    frame = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fit(frame)
    if model is None:
        return spark.createDataFrame([], schema)
    rows = stored(whiten(frame, model, components=components), "whitened")
    k = min(components, len(model.sums))
    error = identity_error(rows, model.usable()[:k])
    share = F.array(*[F.lit(float(v)) for v in model.explained()[:k]])
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("p", "whitened"))
    return each.select("vec_id", (F.col("p") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("p")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
