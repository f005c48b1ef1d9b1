"""Whitening of embeddings by polarisation of variances.

Vectors become whole numbers x = floor(256 c).  The fit list holds every distinct
x once: n vectors with the sums S.  Cross-covariances come from variances only:
2 cov(i, j) = var(x_i + x_j) - var(x_i) - var(x_j).  So what is gathered is, for
each dimension and each sum of two dimensions, the sum of squares of n x - S,
exact whole numbers.  Tasks add squares of y = x - m, with m the whole part of
the mean, as these are small; with r = S - n m = sum of y, the sum of
(n y - r)^2 is n^2 sum(y^2) - n r^2, and the same holds for sums of two
dimensions.  d (d + 1) / 2 numbers reach the driver, whatever the number of
rows; the covariance is assembled there from whole numbers, each entry rounded
once, for ``eigh``.  The error of the whitened covariance is measured over the
whole fit list in a pass of its own.

Cases: vectors that are null, empty, or hold a component that is null, not
finite or, scaled, beyond the range of long are dropped, and vectors whose
length is not the most frequent one (ties to the shorter).  Repeated rows and
rows without id stay, each with its results; equal vectors count once in the
fit list.  Components whose eigenvalue is zero within double precision (at most
d 2^-52 times the trace) cannot be scaled to variance one and are not returned:
one distinct vector, or an empty table, gives no rows.  ``deviation`` is null
where no long holds it; ``deviation_text`` holds the exact number in any case.
Of each eigenvector's two signs that with a positive largest entry is taken.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import stored
from panelscope.llm.vectors import EXACT, LONG, integers, matrix, whole_vectors

COMPONENTS = 4
#: Rows whose squares are added at once.
RUN = 4096


class Fit(NamedTuple):
    """n, the sums S (whole), eigenvalues, falling, eigenvectors as columns, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def exact_sum(x: np.ndarray) -> list[int]:
    """Column sums of a matrix of whole doubles."""
    return x.sum(axis=0).astype(np.int64).tolist() if float(np.abs(x).max(initial=0)) * len(x) < EXACT else integers(x).sum(axis=0).tolist()


def square_sums(y: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, i, sum of y_i^2) and (i, j, sum of (y_i + y_j)^2) for i < j, exact, of whole doubles."""
    large = 4 * float(np.abs(y).max(initial=0)) ** 2 * len(y) >= EXACT
    y = integers(y) if large else y
    out = []
    for i in range(y.shape[1]):
        pairs = y[:, i + 1 :] + y[:, i : i + 1]
        sums = [(y[:, i] * y[:, i]).sum(), *(pairs * pairs).sum(axis=0)]
        out += [(i, i + at, int(s)) for at, s in enumerate(sums)]
    return out


def gathered(fit: DataFrame, of: Callable[[np.ndarray], list[tuple[int, int, int]]]) -> dict[tuple[int, int], int]:
    """Sums over all rows of what ``of`` gives for runs of rows of v, by its first two numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.column(0).slice(at, RUN)
                for i, j, s in of(matrix(part, len(part))):
                    total[i, j] = total.get((i, j), 0) + s
        # whole numbers of any size in limbs of 40 bits, whose sums fit a long
        rows = [(i, j, at, s >> 40 * at & (1 << 40) - 1 if at < 4 else s >> 160) for (i, j), s in total.items() for at in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["i", "j", "limb", "s"])

    limbs = fit.select("v").mapInArrow(run, "i bigint, j bigint, limb bigint, s bigint").groupBy("i", "j", "limb").agg(F.sum("s").alias("s"))
    out: dict[tuple[int, int], int] = {}
    for i, j, limb, s in limbs.collect():
        out[i, j] = out.get((i, j), 0) + (s << 40 * limb)
    return out


def fit_whitening(distinct: DataFrame) -> Fit | None:
    """Of the fit list ``distinct`` (v); None if it is empty."""
    got = gathered(distinct, lambda x: [(0, 0, len(x))] + [(1, i, s) for i, s in enumerate(exact_sum(x))])
    if not got:
        return None
    n, d = got[0, 0], len(got) - 1
    sums = [got[1, i] for i in range(d)]
    mean = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, mean)]
    centre = np.array(mean, np.float64)

    def centred(x: np.ndarray) -> list[tuple[int, int, int]]:
        if max(float(np.abs(x).max(initial=0)), float(np.abs(centre).max())) < EXACT >> 1:
            return square_sums(x - centre)
        y = integers(x) - np.array(mean, dtype=object)
        return [(i, j, int(((y[:, i] + y[:, j]) ** 2).sum()) if i < j else int((y[:, i] ** 2).sum())) for i in range(d) for j in range(i, d)]

    squares = gathered(distinct, centred)
    # n^2 times the sum of squares of x - S / n, of every dimension and sum of two
    spread = {(i, j): n * n * s - n * (rest[i] + (rest[j] if i < j else 0)) ** 2 for (i, j), s in squares.items()}
    v = np.empty((d, d))
    for (i, j), s in spread.items():
        v[i, j] = v[j, i] = s / n**3 if i == j else (s - spread[i, i] - spread[j, j]) / (2 * n**3)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(d)] < 0, -1.0, 1.0)
    return Fit(n, sums, values, vectors, sum(spread[i, i] for i in range(d)) / n**3)


def deviations(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, list[int]]:
    """n x - S as doubles (rounded once), and the exact sums of its squares."""
    if (fit.n * float(np.abs(x).max(initial=0)) + max(map(abs, fit.sums))) < EXACT >> 1:
        t = fit.n * x - np.array(fit.sums, np.float64)
        if float(np.abs(t).max(initial=0)) ** 2 * t.shape[1] < 1 << 62:
            return t, (t.astype(np.int64) ** 2).sum(axis=1).tolist()
        exact = integers(t)
    else:
        exact = fit.n * integers(x) - np.array(fit.sums, dtype=object)
        t = exact.astype(np.float64)
    return t, (exact * exact).sum(axis=1).tolist()


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text: a row per usable row and component."""
    rows = stored(whole_vectors(vectors, F.col("vec_id").cast("long").alias("vec_id")), "vectors")
    distinct = stored(rows.select("v").distinct(), "fit-list")
    fit = fit_whitening(distinct)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_text string"
    positive = 0 if fit is None else int((fit.values > fit.trace * len(fit.values) * 2.0**-52).sum())
    many = min(components, positive)
    if not many:
        return rows.sparkSession.createDataFrame([], schema)
    scale = fit.vectors[:, :many] / np.sqrt(fit.values[:many])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(many), np.zeros((many, many))
        for batch in batches:
            w = deviations(matrix(batch.column(0), batch.num_rows), fit)[0] / fit.n @ scale if batch.num_rows else np.zeros((0, many))
            first, second = first + w.sum(axis=0), second + w.T @ w
        yield pa.RecordBatch.from_pylist([{"at": i, "s": float(s)} for i, s in enumerate([*first, *second.ravel()])], pa.schema([("at", pa.int64()), ("s", pa.float64())]))

    got = dict(distinct.select("v").mapInArrow(moments, "at bigint, s double").groupBy("at").agg(F.sum("s")).collect())
    mean = np.array([got[i] for i in range(many)]) / fit.n
    spread = np.array([got[many + i] for i in range(many * many)]).reshape(many, many) / fit.n - np.outer(mean, mean)
    error = float(np.abs(spread - np.eye(many)).max())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t, squares = deviations(matrix(batch.column(1), batch.num_rows), fit)
            per = np.repeat(np.arange(batch.num_rows), many)
            each = [squares[i] for i in per]
            columns = [
                batch.column(0).take(pa.array(per)), pa.array(np.tile(np.arange(1, many + 1), batch.num_rows), pa.int32()), pa.array([fit.n] * len(per), pa.int64()),
                pa.array([s if s <= LONG else None for s in each], pa.int64()), pa.array((t / fit.n @ scale).ravel()),
                pa.array(np.tile(fit.values[:many] / fit.trace, batch.num_rows)), pa.array([error] * len(per), pa.float64()), pa.array([str(s) for s in each], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return rows.select("vec_id", "v").mapInArrow(apply, schema)
