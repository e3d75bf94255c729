"""Embedding whitening: principal components by matrix-free block Lanczos.

The covariance is never formed. A pass over the vectors multiplies it with a block: each
task adds up its rows' share of (x - mean)(x - mean)ᵀ V, Spark adds up the tasks' shares,
and the driver gets one row of BLOCK numbers for each dimension. The driver keeps the basis
(dimensions x basis vectors, whatever the number of vectors), orthogonalises each new block
against all of it, twice, and solves the small projected problem. Residuals of the wanted
pairs, taken from the products themselves, decide when to stop. A direction that the new
block adds nothing to (breakdown) is restarted with a random one, so that repeated
eigenvalues and data of low rank are no special cases; the basis is complete at the latest
when it has as many vectors as there are dimensions.

Entries are whole numbers, so n * x - S is exact before it is divided by n: vectors are
centred without loss before any multiplication. The trace comes from the deviations of all
vectors, not from eigenvalues.

Edge cases. Left out: rows whose vector is null, has a null or non-finite entry or one whose
whole number does not fit 62 bits, and rows whose length is not the table's most frequent one
(of equally frequent ones the longest). Equal vectors count once in the fit, and each has its
rows in the result. A null vec_id stays null. A deviation of over 38 digits is null. Components whose eigenvalue is zero, as far as
double precision can tell (ZERO of the largest), are left out: they cannot be scaled to one.
So an empty table, a single vector, or vectors that are all equal give no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.session import materialize, scratch

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Columns of a block of the iteration.
BLOCK = 16
#: Residual of a pair, as a share of the largest eigenvalue, at which it has converged; eigenvalues below ZERO of it are none.
TOLERANCE, ZERO = 1e-14, 1e-12
#: Rows that a task multiplies at once.
ROWS = 4096
SAFE = 1 << 62


def vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows that remain, their entries as whole numbers."""
    v = F.col(vector)
    whole = lambda c: F.floor(SCALE * c.cast("double"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(SCALE * c.cast("double")) < float(SAFE // 2)))
    rows = table.filter(v.isNotNull() & fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, lambda c: whole(c) + SHIFT).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("most")).first()
    return rows.filter(F.size("x") == (lengths["most"]["d"] if lengths["most"] else 0))


def _matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[np.ndarray]:
    """The vectors of a batch as rows, at most ROWS at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            lists = batch.slice(at, ROWS).column(column)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            yield flat.reshape(len(lists), -1)


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as int64 where all of it fits, else as Python integers."""
    most = int(np.abs(x).max(initial=0))
    if n * most + max(map(abs, sums), default=0) < SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(off: np.ndarray) -> list[int] | np.ndarray:
    """Sum of squares of each row, exact."""
    most = int(abs(off).max()) if off.size else 0
    if off.dtype != object and off.shape[1] * most * most < SAFE:
        return (off * off).sum(1)
    return [sum(int(v) ** 2 for v in row) for row in off.tolist()]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's number of vectors and, for each dimension, its sum."""
    n, total = 0, None
    for x in _matrices(batches):
        safe = int(np.abs(x).max(initial=0)) * len(x) < SAFE
        own = (x if safe else x.astype(object)).sum(0).astype(object)
        n, total = n + len(x), own if total is None else total + own
    if n:
        sums = [Decimal(int(s)) for s in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array(sums, pa.decimal128(38, 0))], names=["i", "n", "s"])


def _sums(rows: Callable[[np.ndarray], np.ndarray], width: int):
    """Tasks that add up rows(x), a matrix of the given width, over their vectors: (i, y0, y1, ...) for each of its rows."""
    names = ["i", *(f"y{k}" for k in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches):
            own = rows(x)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(total[:, k]) for k in range(width))], names=names)

    return run


def summed(fit: DataFrame, rows: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
    """The sum of rows(x) over all vectors; height x width numbers reach the driver."""
    names = [f"y{k}" for k in range(width)]
    parts = fit.select("x").mapInArrow(_sums(rows, width), ", ".join(["i int", *(f"{c} double" for c in names)]))
    out = np.zeros((height, width))
    for r in parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).collect():
        out[r["i"]] = [r[c] for c in names]
    return out


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric d x d operator, falling, and their unit eigenvectors as columns.

    multiply: its product with a d x b matrix. Signs are such that the largest entry of each vector is positive.
    """
    wanted, random = min(wanted, d), np.random.default_rng(seed)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    new, scale = random.standard_normal((d, min(block, d))), 1.0
    while True:
        basis, added = _extended(basis, new, scale, random)
        images = np.c_[images, multiply(basis[:, -added:])]
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1][:wanted], turns[:, ::-1][:, :wanted]
        found = basis @ turns
        scale = max(float(np.abs(values).max()), np.finfo(float).tiny)
        residuals = np.linalg.norm(images @ turns - found * values, axis=0)
        if basis.shape[1] == d or (len(values) == wanted and (residuals <= tolerance * scale).all()):
            break
        new = images[:, -added:]
    found /= np.linalg.norm(found, axis=0)
    return values, found * np.sign(found[np.abs(found).argmax(0), range(found.shape[1])])


def _extended(basis: np.ndarray, new: np.ndarray, scale: float, random: np.random.Generator) -> tuple[np.ndarray, int]:
    """The basis with orthonormal columns for what new adds to it, and their number; what adds nothing is restarted at random."""
    d, before = basis.shape
    for column in new.T[: d - before]:
        floor = 1e-13 * scale
        while True:
            for _ in range(2):
                column = column - basis @ (basis.T @ column)
            size = np.linalg.norm(column)
            if size > floor:
                break
            column, floor = random.standard_normal(d), 1e-8
        column = column / size
        column -= basis @ (basis.T @ column)
        basis = np.c_[basis, column / np.linalg.norm(column)]
    return basis, basis.shape[1] - before


def _whitened(n: int, sums: list[int], vectors_: np.ndarray, values: np.ndarray, explained: list[float], error: float):
    """(vec_id, x) -> a row for each vector and component."""
    k = len(values)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = part.num_rows
                off = offsets(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(rows, -1), n, sums)
                dev = deviations(off)
                dev = pa.array(dev, pa.int64()).cast(pa.decimal128(38, 0)) if isinstance(dev, np.ndarray) else pa.array([Decimal(v) if v < 10**38 else None for v in dev], pa.decimal128(38, 0))
                white = (off / n).astype(np.float64) @ (vectors_ / np.sqrt(values))
                again = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays([part.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)), dev.take(again), pa.array(white.reshape(-1)), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))], names=names)

    return run


RESULT = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each remaining row and component: vec_id, component, n (distinct vectors), deviation (exact), whitened, explained, identity_error."""
    spark, rows = table.sparkSession, vectors(table, vector)
    with scratch(spark):
        fit = materialize(rows.select("x").distinct(), "whiten-fit")
        moments = fit.mapInArrow(_moments, "i int, n bigint, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
        if not moments:
            return spark.createDataFrame([], RESULT)
        n, d, sums = moments[0]["n"], len(moments), [int(r["s"]) for r in moments]
        centred = lambda x: (offsets(x, n, sums) / n).astype(np.float64)

        def multiply(v: np.ndarray) -> np.ndarray:
            return summed(fit, lambda x: (c := centred(x)).T @ (c @ v), d, v.shape[1]) / n

        trace = summed(fit, lambda x: np.array([[sum(int(v) / n / n for v in deviations(offsets(x, n, sums)))]]), 1, 1)[0, 0] / n
        values, found = lanczos(multiply, d, components)
        real = values > ZERO * values.max() if trace > 0 else np.zeros(len(values), bool)
        values, found = values[real], found[:, real]
        k = len(values)
        if not k:
            return spark.createDataFrame([], RESULT)
        scaled = found / np.sqrt(values)

        def squares(x: np.ndarray) -> np.ndarray:
            w = centred(x) @ scaled
            return np.r_[w.T @ w, w.sum(0)[None, :]]

        totals = summed(fit, squares, k + 1, k) / n
        error = float(np.abs(totals[:k] - np.outer(totals[k], totals[k]) - np.eye(k)).max())
    return rows.mapInArrow(_whitened(n, sums, found, values, (values / trace).tolist(), error), RESULT)


def op13_whiten(spark, sf_dir):
    """Deviations beyond 64 bits are null in the query; the operator has them whole."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
