"""Embedding whitening: vectors are quantised to integers, their covariance is computed exactly by sliced matrix products,
and they are projected on its unit eigenvectors, each scaled to variance one.

Digit slices: with S the sums of the n vectors x, y = n*x - S is an integer matrix, the centred vectors times n. Each entry
is split into balanced digits ("limbs") of LIMB bits; the product of two limb matrices over BLOCK rows then stays below
2^53, so float64 BLAS gives it exactly. The products of limbs whose places add up to the same are summed as integers,
recombined as big integers by a task, and merged by Spark as decimals of 38 digits: the sum over all y*y' is exact,
whatever the order and the partitions, and a task that is run again gives the same. Divided by n^3 it is the covariance.

Passes: counts and sums; products; the covariance of the whitened vectors; the result. Each reads the vectors, groups by
dimension or pair of dimensions with partial sums, and brings no more to the driver than the square of the dimension.

Defined results: vectors that are null or hold a null, NaN or infinity are dropped, as are those of another length than
most have (the longer where equally many); null ids and repeated rows are rows of their own; components whose eigenvalue
is no larger than rounding (fewer rows than dimensions, equal rows) can't be scaled to variance one and are left out, so
one row, equal rows and an empty table give an empty result; other columns are ignored. Entries too large for 64-bit
arithmetic (|n*x - S| of 2^62 or more) are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import bounded

SCALE, SHIFT = 64, 1_000_000
LIMB, BLOCK = 20, 8192  # 2 * 19 bits of a product, 13 of rows: 51 bits
COMPONENTS = 32
BIG = "decimal(38,0)"


def quantised(c: np.ndarray) -> np.ndarray:
    if c.size and np.abs(c).max() >= (1 << 62) / SCALE:
        raise ValueError("these vectors' entries are too large for 64-bit arithmetic")
    return np.floor(SCALE * c.astype(np.float64)).astype(np.int64) + SHIFT


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Balanced digits of integers below 2^62, the least first, as float64: each in [-2^19, 2^19]."""
    out, half = [], 1 << (LIMB - 1)
    while True:
        low = ((y + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
        if not y.any():
            return out


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y'y of an integer matrix, as Python integers."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for at in range(0, len(y), BLOCK):
        parts = limbs(y[at : at + BLOCK])
        places = [np.zeros((d, d), np.int64) for _ in range(2 * len(parts) - 1)]  # at most 8 products each: 54 bits
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[i:], i):
                product = (a.T @ b).astype(np.int64)
                places[i + j] += product if i == j else product + product.T
        for k, place in enumerate(places):
            total += place.astype(object) << (LIMB * k)
    return total


# ---------------------------------------------------------------- reading


def _matrix(column: pa.Array, d: int | None = None) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Of a column of lists: the rows that are usable, and for each length (or the one asked for) its matrix; rows of a
    length are in order."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))  # a null entry is read as NaN
    fine = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    out = []
    for n in [d] if d is not None else np.unique(size[fine]).tolist():
        rows = np.flatnonzero(fine & (size == n))
        out.append((n, values[offsets[rows, None] + np.arange(n)] if n else np.empty((len(rows), 0))))
    return fine, out


@dataclass(frozen=True)
class Whitening:
    """The fit: n vectors with sums S; unit eigenvectors as columns, by falling eigenvalue; each one's share of the trace;
    and the largest deviation of the whitened vectors' covariance from the identity."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S as integers."""
        s, reach = np.array(self.sums, object), self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if reach < 1 << 62:
            return self.n * x - s.astype(np.int64)
        y = x.astype(object) * self.n - s
        if y.size and np.abs(y).max() >= 1 << 62:
            raise ValueError("these vectors' entries are too large for 64-bit arithmetic")
        return y.astype(np.int64)

    def whiten(self, y: np.ndarray) -> np.ndarray:
        return (y / float(self.n)) @ (self.vectors / np.sqrt(self.values))


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are of the commonest length, and their sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for d, m in _matrix(batch.column(0))[1]:
                x = quantised(m)
                top = int(np.abs(x).max(initial=0))
                step = max(1, min(len(x), (1 << 62) // max(1, top)))
                total = sum((x[i : i + step].sum(0).astype(object) for i in range(0, len(x), step)), np.zeros(d, object))
                n, s = held.get(d, (0, np.zeros(d, object)))
                held[d] = (n + len(x), s + total)
        rows = [(d, i, n, Decimal(int(v))) for d, (n, s) in held.items() for i, v in enumerate([*s, 0])]  # place d holds no sum
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0)))], ["d", "i", "n", "s"])

    parts = vectors.mapInArrow(bounded(run), f"d long, i long, n long, s {BIG}")
    by = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").cast(BIG).alias("s"))
    most = by.where("i = d").agg(F.max(F.struct("n", "d"))).first()[0]
    if most is None:
        return 0, []
    return most["n"], [int(r["s"]) for r in by.where((F.col("d") == most["d"]) & (F.col("i") < most["d"])).orderBy("i").collect()]


def _products(vectors: DataFrame, model: Whitening) -> list[list[int]]:
    """The exact sum of y*y' over all vectors."""
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            total += exact_gram(model.centred(quantised(_matrix(batch.column(0), d)[1][0][1])))
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "v"])

    merged = vectors.mapInArrow(bounded(run), f"i long, j long, v {BIG}").groupBy("i", "j").agg(F.sum("v").cast(BIG).alias("v"))
    out = [[0] * d for _ in range(d)]
    for i, j, v in merged.collect():  # d * (d + 1) / 2 rows
        out[i][j] = out[j][i] = int(v)
    return out


def _identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    d, k = len(model.sums), model.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = model.whiten(model.centred(quantised(_matrix(batch.column(0), d)[1][0][1])))  # centred, as y is
            total += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])

    merged = vectors.mapInArrow(bounded(run), "i long, j long, v double").groupBy("i", "j").agg((F.sum("v") / model.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("off"))
    return merged.agg(F.max(F.abs("off"))).first()[0]


def fit(df: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fitted on every usable vector; None if no component has a variance."""
    vectors = df.select(F.col(vector_col).alias("_vector"))
    n, sums = _sums(vectors)
    if not sums:
        return None
    blank = Whitening(n, tuple(sums), np.empty((len(sums), 0)), np.empty(0), np.empty(0), 0.0)
    exact = _products(vectors, blank)
    v = np.array([[float(Fraction(c, n**3)) for c in row] for row in exact])
    values, vectors_of = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > max(values.max(), 0) * len(sums) * np.finfo(float).eps][:components]
    if not len(order):
        return None
    u = vectors_of[:, order]
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(len(order))])  # one sign for all rows, the same in each run
    trace = float(Fraction(sum(exact[i][i] for i in range(len(sums))), n**3))
    model = replace(blank, vectors=u, values=values[order], explained=values[order] / trace)
    return replace(model, identity_error=_identity_error(vectors, model))


def whitened(df: DataFrame, model: Whitening | None, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, deviation, whitened) for each usable row: its squared distance from the mean times n^2, exactly, and its
    coordinates, component 1 first."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, deviation {BIG}, whitened array<double>"
    if model is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(model.sums)
        for batch in batches:
            column = batch.column(1)
            fine, ((_, m),) = _matrix(column, d)
            at = np.flatnonzero(fine & (np.diff(column.offsets.to_numpy()) == d))
            y = model.centred(quantised(m))
            small = int(np.abs(y).max(initial=0)) ** 2 * max(d, 1) < 1 << 63  # else beyond 64 bits
            squares = (y**2).sum(1).tolist() if small else (y.astype(object) ** 2).sum(1).tolist()
            w = model.whiten(y)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([Decimal(int(s)) for s in squares], pa.decimal128(38, 0)), lists], ["_id", "deviation", "whitened"])

    return rows.mapInArrow(bounded(run), schema).withColumnRenamed("_id", id_col)
