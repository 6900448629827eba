"""Whitening of vectors by mixed-precision eigenvectors.

Vectors become rows of whole numbers. Each distinct row counts once; numbers of
rows, sums and the covariance are gathered over these in two passes, centred on
the rounded mean before anything is multiplied. Sums of products of whole
numbers are exact, so the covariance does not depend on how rows lie on tasks;
its partial sums meet in a tree of bounded fan-in, and only one ``d x d`` matrix
reaches the driver.

There its eigenvectors are found in single precision and refined by the
iteration of Ogita and Aishima, matrix products in extended precision only.
Eigenvalues that the iteration can't tell apart form clusters; in a cluster's
subspace a small eigenproblem of the matrix shifted by the cluster's mean is
solved for itself, which brings out gaps that the whole matrix hides, and the
iteration goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.session import written

#: partial sums that one task adds up at each level of the tree
FAN = 32
#: a block's rows, so that sums of products of small whole numbers are exact doubles
BLOCK = 2048
_EXACT = 1 << 53
_LONG = 1 << 62
_PARTIAL = (["rows", "bytes"], "rows long, bytes binary")


# --- refinement of eigenvectors ---------------------------------------------------


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One iteration: better vectors, eigenvalues, and the gap under which two
    eigenvalues can't be told apart."""
    d = len(a)
    r = np.eye(d, dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # else rounding over a small gap costs orthogonality
    diagonal = np.diagonal(s) / (1 - np.diagonal(r))
    off = s - np.diag(diagonal)
    norm = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum()))
    delta = 2 * (norm(off) + norm(a) * norm(r))
    gap = diagonal[None, :] - diagonal[:, None]
    clear = np.abs(gap) > delta
    e = np.where(clear, (s + diagonal[None, :] * r) / np.where(clear, gap, 1), r / 2)
    np.fill_diagonal(e, np.diagonal(r) / 2)
    return x + x @ e, diagonal, delta


def _clusters(values: np.ndarray, delta: float) -> list[np.ndarray]:
    """Runs of eigenvalues, in rising order, with gaps of ``delta`` at most."""
    order = np.argsort(values)
    breaks = np.flatnonzero(np.diff(values[order]) > delta) + 1
    return [c for c in np.split(order, breaks) if len(c) > 1]


def refined_eigenvectors(a: np.ndarray, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and the eigenvectors (columns) of a symmetric matrix.

    Starts from single precision; each step multiplies matrices in the
    precision of ``numpy.longdouble``. Ends when the vectors' change is down to
    rounding or no longer gets less.
    """
    a = np.asarray(a, np.longdouble)
    d = len(a)
    scale = np.abs(a).max() if d else 0
    if not scale > 0:
        return np.zeros(d, np.longdouble), np.eye(d, dtype=np.longdouble)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eps, last, solved = float(np.finfo(np.longdouble).eps), np.inf, False
    for _ in range(steps):
        better, values, delta = _step(a, x)
        change = float(np.abs(better - x).max())
        x = better
        clusters = _clusters(values, delta)
        if clusters and not solved:
            for c in clusters:
                own = x[:, c]
                middle = values[c].mean()
                small = own.T @ (a @ own - middle * own)
                small = ((small + small.T) / 2).astype(np.float64)
                x[:, c] = own @ np.linalg.eigh(small)[1].astype(np.longdouble)
            # a sub-solve turns vectors within their space; more would do so again
            solved, last = change < 1e-12, np.inf
            continue
        if change <= 8 * eps * d or (change < 1e-15 and change >= last / 2):
            break
        last = change
    values = np.diagonal(x.T @ (a @ x)) / (x * x).sum(0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    return values[order] * scale, x


# --- rows of whole numbers ---------------------------------------------------------


def whole_numbers(vectors: Column, factor: int) -> Column:
    """``floor(factor * c)`` of each entry as long."""
    return F.transform(vectors, lambda c: F.floor(c.cast("double") * F.lit(float(factor))).cast("bigint"))


def usable(vectors: Column) -> Column:
    """Not null, and without null or non-finite entries."""
    number = lambda c: c.cast("double")
    bad = F.exists(vectors, lambda c: c.isNull() | F.isnan(number(c)) | (F.abs(number(c)) == float("inf")))
    return vectors.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _limbs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of whole numbers as two longs, of their upper and lower halves."""
    return (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        least, most = np.full(d, np.iinfo(np.int64).max), np.full(d, np.iinfo(np.int64).min)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            if not len(x):
                continue
            h, l = _limbs(x)
            n, high, low = n + len(x), high + h, low + l
            least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d)), pa.array(np.full(d, n)), *map(pa.array, (high, low, least, most))],
                names=["dim", "n", "high", "low", "least", "most"],
            )

    return run


def _products(d: int, centre: np.ndarray, exact: bool):
    """One row a task: the sums of products of centred entries, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((d, d), np.int64 if exact else np.float64), 0
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            for a in range(0, len(x), BLOCK):
                y = x[a : a + BLOCK] - centre if exact else x[a : a + BLOCK].astype(np.float64) - centre
                y = y.astype(np.float64)
                part = y.T @ y
                total += part.astype(np.int64) if exact else part
                seen += len(y)
        if seen:
            yield _one_row(total, seen)

    return run


def _moments(d: int, mean: np.ndarray, basis: np.ndarray):
    """One row a task: the sums of products of whitened entries, and their sums."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, k + 1)), 0
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            for a in range(0, len(x), BLOCK):
                z = (x[a : a + BLOCK] - mean) @ basis
                total += np.concatenate([z.T @ z, z.sum(0)[:, None]], 1)
                seen += len(z)
        if seen:
            yield _one_row(total, seen)

    return run


def _one_row(total: np.ndarray, seen: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([total.tobytes()], pa.binary())], names=_PARTIAL[0])


def _tree_sum(parts: DataFrame, shape: tuple[int, ...], kind: type) -> np.ndarray:
    """Add up matrices, ``FAN`` or so in a task at each level. Levels are stored,
    so a lost executor costs one level's share."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape, kind), 0
        for batch in batches:
            for rows, raw in zip(batch.column("rows").to_pylist(), batch.column("bytes"), strict=True):
                total += np.frombuffer(raw.as_buffer(), kind).reshape(shape)
                seen += rows
        if seen:
            yield _one_row(total, seen)

    parts = written(parts, "partial-sums")
    left = parts.count()
    while left > FAN:
        tasks = max(1, left // FAN)
        parts = written(parts.repartition(tasks).mapInArrow(add, _PARTIAL[1]), "partial-sums")
        left = parts.count()
    total = np.zeros(shape, kind)
    for row in parts.select("bytes").collect():
        total += np.frombuffer(bytes(row["bytes"]), kind).reshape(shape)
    return total


@dataclass(frozen=True)
class Whitening:
    """What is learned from the fit list: ``n`` rows, sums ``S``, eigenvalues and
    eigenvectors of the covariance, its trace, and how far from the identity
    the covariance of the whitened fit list is."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    largest: int  # absolute value of an entry

    @property
    def mean(self) -> np.ndarray:
        return np.array([np.longdouble(s) / np.longdouble(self.n) for s in self.sums]).astype(np.float64)

    @property
    def basis(self) -> np.ndarray:
        """Columns project a centred row to its whitened entries; a component
        without variance has zeros."""
        root = np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.inf)
        return (self.vectors / root).astype(np.float64)


def _without_variance(values: np.ndarray) -> np.ndarray:
    """Eigenvalues as they are, but zero where only rounding holds them up."""
    floor = len(values) * 1e-17 * max(float(values[0]), 0.0) if len(values) else 0.0
    return np.where(values > floor, values, 0)


def fit(rows: DataFrame, d: int, components: int) -> Whitening | None:
    """Learn from a table with a column ``x`` of ``d`` longs; None where it is empty."""
    listed = written(rows.select("x").distinct(), "fit-list")
    parts = listed.mapInArrow(_sums(d), "dim long, n long, high long, low long, least long, most long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = (
        parts.groupBy("dim")
        .agg(
            F.sum("n").alias("n"), whole("high").alias("high"), whole("low").alias("low"),
            F.min("least").alias("least"), F.max("most").alias("most"),
        )
        .orderBy("dim")
        .collect()
    )
    if not found:
        return None
    n = found[0]["n"]
    sums = tuple((int(r["high"]) << 32) + int(r["low"]) for r in found)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    reach = max(max(r["most"] - int(c), int(c) - r["least"]) for r, c in zip(found, centre, strict=True))
    exact = reach * reach * BLOCK < _EXACT and reach * reach * n < _LONG
    kind = np.int64 if exact else np.float64
    gathered = _tree_sum(listed.mapInArrow(_products(d, centre, exact), _PARTIAL[1]), (d, d), kind)
    rest = np.array([np.longdouble(s - n * int(c)) / np.longdouble(n) for s, c in zip(sums, centre, strict=True)])
    v = gathered.astype(np.longdouble) / n - np.outer(rest, rest)
    values, vectors = refined_eigenvectors(v)
    values, k = _without_variance(values), min(components, d)
    largest = max(max(abs(r["most"]), abs(r["least"])) for r in found)
    half = Whitening(n, sums, values[:k], vectors[:, :k], float(np.trace(v)), 0.0, largest)
    m = _tree_sum(listed.mapInArrow(_moments(d, half.mean, half.basis), _PARTIAL[1]), (k, k + 1), float)
    means = m[:, k] / n
    live = half.values > 0
    off = np.abs(m[:, :k] / n - np.outer(means, means) - np.eye(k))[np.ix_(live, live)]
    return Whitening(n, sums, half.values, half.vectors, half.trace, float(off.max()) if off.size else 0.0, largest)


# --- applying it -------------------------------------------------------------------


def _deviations(x: np.ndarray, w: Whitening) -> pa.Array:
    """``sum((n x - S)^2)`` of each row, exact. Where products can leave the
    range of a long, Python's whole numbers take over."""
    reach = w.n * w.largest + max(abs(s) for s in w.sums)
    kind = pa.decimal128(38, 0)
    if reach * reach * x.shape[1] < _LONG:
        e = x * w.n - np.array(w.sums, np.int64)
        return pa.array((e * e).sum(1)).cast(kind)
    rows = ((w.n * x.astype(object) - np.array(w.sums, object)) ** 2).sum(1)
    return pa.array([Decimal(int(r)) if abs(r) < 10**38 else None for r in rows], kind)


def _apply(w: Whitening, d: int):
    k = len(w.values)
    mean, basis, live = w.mean, w.basis, w.values > 0
    explained = (w.values / w.trace).astype(np.float64) if w.trace > 0 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = _matrix(part.column("x"), d)
                z = (x - mean) @ basis
                row = pa.array(np.repeat(np.arange(len(x)), k))
                none = pa.array(~np.tile(live, len(x)))
                number = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
                share = pa.nulls(len(row), pa.float64()) if explained is None else pa.array(np.tile(explained, len(x)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(row),
                        pa.array(number),
                        pa.array(np.full(len(row), w.n)),
                        _deviations(x, w).take(row),
                        pa.array(z.ravel(), mask=none.to_numpy(zero_copy_only=False)),
                        share,
                        pa.array(np.full(len(row), w.identity_error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    factor: int = 256,
    components: int = 4,
) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: one
    row for each usable row of ``table`` and component.

    Rows whose vector is null or has null or non-finite entries are dropped, as
    are rows with another number of entries than most rows have (of equally
    frequent numbers the largest). Entries become ``floor(factor * entry)``,
    each distinct vector counts once in what is learned, and every row, repeats
    and equal ids included, comes out for itself. Components are at most as many
    as entries. One without variance has a null ``whitened`` and explains
    nothing; where no component has any (a single distinct vector), ``explained``
    is null. ``deviation`` is exact; beyond 38 digits it is null. An empty table,
    or one without usable vectors of at least one entry, gives an empty one. Ids
    are passed on, null ones too; other columns, whatever their names, are not read.
    """
    spark = table.sparkSession
    good = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    rows = good.select("id", whole_numbers(F.col("v"), factor).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().where("d > 0")
    usual = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    kind = table.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, component int, n long, deviation decimal(38,0),"
        " whitened double, explained double, identity_error double"
    )
    if usual is None:
        return spark.createDataFrame([], schema)
    d = usual["d"]
    rows = rows.where(F.size("x") == d)
    learned = fit(rows, d, components)
    return rows.mapInArrow(_apply(learned, d), schema)
