"""Embedding whitening by shifted CholeskyQR (operator 12).

Vectors become whole numbers x = floor(scale * c). The fit list holds each
distinct x once; its rows, centred by the exact mean, form a tall matrix A. Every
pass sums the Gram matrix of A's rows, after the triangular solves of the passes
before, over all partitions; its Cholesky factor (shifted in the first pass, so
that it exists for ill-conditioned data) is the next solve. The passes end when
the rows are orthonormal to rounding. The last Gram matrix gives a symmetric
square root instead of a Cholesky factor, so dimensions without variance of
their own (constant, or sums of others) stay exactly null. The composed factors
are R with A = QR, and the SVD of R holds the components (right singular vectors)
and the eigenvalues (squares over n); the covariance itself is never formed.

Only d x d sums leave the executors: every task sums its rows, the tasks' sums
are added in ``SLOTS`` groups, and the driver adds those. d is the dimension of
the vectors, not a number that grows with the rows.

Defined results: rows whose vector is null or holds null or non-finite entries
are left out, as are rows whose dimension isn't the most frequent one (the
longest of several). Copies count once in the fit and have a result row each.
Components without variance (eigenvalue at rounding level) are not returned, so
a table whose vectors are all equal, an empty one and vectors of dimension 0 give
no rows. x saturates at the range of a long; a deviation beyond it is null.
Extra columns are ignored; vec_id may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import stored

SCALE = 256
COMPONENTS = 4
MAX_PASSES = 8
#: Groups in which the tasks' sums are added before the driver adds them.
SLOTS = 16
#: Rows unpacked at a time.
ROWS = 4096
LIMIT = 2.0**63


def packed(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, width, x): whole-number vectors as big-endian longs, of rows with finite entries only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            ids, widths, data = [], [], []
            for start in range(0, batch.num_rows, ROWS):
                some = vectors.slice(start, ROWS)
                for key, vector in zip(batch.column("vec_id").slice(start, ROWS).to_pylist(), some, strict=True):
                    values = vector.values if vector.is_valid else None
                    if values is None or values.null_count:
                        continue
                    row = values.to_numpy(zero_copy_only=False)
                    if not np.isfinite(row).all():
                        continue
                    with np.errstate(over="ignore"):
                        scaled = np.floor(row * float(scale))
                    whole = np.where(scaled >= LIMIT, 2**63 - 1, np.where(scaled <= -LIMIT, -(2**63), 0)).astype(np.int64)
                    inside = np.abs(scaled) < LIMIT
                    whole[inside] = scaled[inside].astype(np.int64)
                    ids.append(key)
                    widths.append(len(row))
                    data.append(whole.astype(">i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(widths, pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "width", "x"])

    rows = docs.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "vec_id long, width int, x binary")


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">i8").astype(np.int64).reshape(-1, width)


@dataclass
class Model:
    """What turns whole numbers into whitened components."""

    n: int
    sums: list[int]  # exact
    factors: list[np.ndarray] = field(default_factory=list)  # each pass's triangular factor
    axes: np.ndarray | None = None  # d x k, unit eigenvectors
    values: np.ndarray | None = None  # k eigenvalues
    total: float = 0.0  # the trace of the covariance

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; whole parts are subtracted first, so large means cost no digits."""
        whole = np.array([s // self.n for s in self.sums], dtype=object)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        if max((abs(int(w)) for w in whole), default=0) < 2**61 and (not x.size or np.abs(x.astype(float)).max() < 2**61):
            return (x - whole.astype(np.int64)) - rest
        return (x.astype(object) - whole).astype(np.float64) - rest

    def solved(self, x: np.ndarray) -> np.ndarray:
        """Centred rows after the triangular solves of the passes so far."""
        rows = self.centred(x)
        for r in self.factors:
            rows = np.linalg.solve(r.T, rows.T).T
        return rows

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) ** 2, exact; null beyond a long."""
        most = max((abs(s) for s in self.sums), default=0) + self.n * (int(np.abs(x.astype(float)).max()) + 1 if x.size else 0)
        if most * most * max(1, x.shape[1]) < 2**63:
            return ((x * self.n - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        found = ((x.astype(object) * self.n - np.array(self.sums, dtype=object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in found]


def gram_sums(fit: DataFrame, width: int, rows_of: Callable[[Model, np.ndarray], np.ndarray], model: Model) -> np.ndarray:
    """Sum over all rows of rows' outer products, of what ``rows_of`` makes of them, with a row of plain sums below."""
    spread = fit.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = rows_of(spread.value, unpacked(batch.column("x").slice(start, ROWS), width))
                own = np.vstack([rows.T @ rows, rows.sum(axis=0)])
                total = own if total is None else total + own
        if total is not None:
            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])

    def added(sums: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(cell.as_py()) for cell in sums.column("sums")], axis=0)
        return pa.table([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = fit.select("x").mapInArrow(part, "slot int, sums binary").groupBy("slot").applyInArrow(added, "sums binary")
    found = [np.frombuffer(bytes(r["sums"])) for r in parts.collect()]  # SLOTS matrices at most
    total = np.sum(found, axis=0)
    return total.reshape(-1, round((np.sqrt(1 + 4 * total.size) - 1) / 2))  # (k + 1) rows of k


def fitted(fit: DataFrame, width: int, components: int = COMPONENTS) -> Model | None:
    """The model of distinct packed vectors, or None if they hold no variance."""
    n = fit.count()
    if not n or not width:
        return None

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=object)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                total = total + unpacked(batch.column("x").slice(start, ROWS), width).astype(object).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(v) for v in total], pa.string())], names=["dim", "total"])

    sums = fit.select("x").mapInArrow(exact, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["dim"]: int(r["total"]) for r in sums.collect()}  # one number a dimension
    model = Model(n, [found[k] for k in range(width)])
    unit, eye = np.finfo(float).eps / 2, np.eye(width)
    for step in range(MAX_PASSES):
        gram = gram_sums(fit, width, Model.solved, model)[:-1]
        gram = (gram + gram.T) / 2
        if step == 0:
            model.total = float(np.trace(gram)) / n
            if not model.total > 0:
                return None
            shift = min(11 * (width * n + width * (width + 1)) * unit, 1e-8) * np.linalg.norm(gram, 2)
            model.factors.append(np.linalg.cholesky(gram + shift * eye).T)
            continue
        values, vectors = np.linalg.eigh(gram)
        null = values < 0.5  # directions without rows come out near 0, all others near 1 in the end
        if step == MAX_PASSES - 1 or np.abs(values[~null] - 1).max(initial=0) < 64 * width * unit and values[null].max(initial=0) < 1e-6:
            break
        model.factors.append(np.linalg.cholesky(gram + max(0.0, unit * width - values.min()) * eye).T)
    root = (vectors * np.sqrt(np.where(null, 0, values))) @ vectors.T
    r = root
    for factor in reversed(model.factors):
        r = r @ factor
    _, singular, right = np.linalg.svd(r)
    eigen = singular**2 / n
    kept = int((eigen[:components] > eigen[0] * width * unit * 64).sum())
    model.axes, model.values = right[:kept].T.copy(), eigen[:kept]
    return model


def whiten(docs: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and component."""
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = docs.sparkSession
    rows = stored(packed(docs, scale), "packed")
    widths = rows.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if widths is None:
        return spark.createDataFrame([], kinds)
    width = widths["width"]
    rows = rows.where(F.col("width") == width)
    fit = stored(rows.select("x").distinct(), "fit")
    model = fitted(fit, width, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], kinds)
    moments = gram_sums(fit, width, Model.whitened, model) / model.n
    covariance = moments[:-1] - np.outer(moments[-1], moments[-1])
    error = float(np.abs(covariance - np.eye(len(covariance))).max())
    spread, number = spark.sparkContext.broadcast(model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        share = m.values / m.total
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x = unpacked(batch.column("x").slice(start, ROWS), width)
                ids = batch.column("vec_id").slice(start, ROWS).to_pylist()
                deviations = m.deviations(x)
                yield pa.RecordBatch.from_arrays([
                    pa.array([v for v in ids for _ in range(number)], pa.int64()),
                    pa.array(np.tile(np.arange(1, number + 1), len(ids)), pa.int32()),
                    pa.array(np.full(len(ids) * number, m.n), pa.int64()),
                    pa.array([v for v in deviations for _ in range(number)], pa.int64()),
                    pa.array(m.whitened(x).ravel(), pa.float64()),
                    pa.array(np.tile(share, len(ids)), pa.float64()),
                    pa.array(np.full(len(ids) * number, error), pa.float64()),
                ], names=[k.split()[0] for k in kinds.split(", ")])

    return rows.mapInArrow(run, kinds)
