"""Embedding whitening with eigenvalues found by spectrum slicing.

Vectors become whole numbers, and each distinct one enters the fit once. Sums are exact; the covariance is
summed from centred rows, task by task, and only its d x d entries reach the driver. There the
inertia of the shifted covariance, from an LDL' factorisation with 1 x 1 and 2 x 2 pivots, counts the
eigenvalues below any shift. Bisection on these counts isolates each leading eigenvalue, Rayleigh quotient
iteration, which converges cubically, finishes it, and counts on both sides certify its number. Eigenvalues
that no shift separates at working precision are taken together from their common subspace.

Defined cases. Vectors that are null, empty, hold a null or non-finite entry, or an entry beyond
2 ** 46 in size take no part, nor do vectors of another length than the most frequent one.
Repeated rows are all returned, but fitted once. Components of no variance to working precision are left out, so
fewer than ``k`` come of few distinct rows, and none of one. ``deviation`` is null where it does not
fit a long. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

EPS = float(np.finfo(float).eps)
MOST = float(1 << 46)


def inertia(matrix: np.ndarray) -> int:
    """Number of negative eigenvalues of a symmetric matrix, by LDL' with complete pivoting."""
    a = matrix.copy()
    limit = (1 + 17**0.5) / 8  # keeps the growth of entries bounded
    tiny = EPS * max(float(np.abs(a).max(initial=0.0)), np.finfo(float).tiny)
    negative = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        r = int(np.argmax(diagonal))
        off = np.abs(a - np.diag(np.diagonal(a)))
        most = float(off.max(initial=0.0))
        if diagonal[r] >= limit * most:
            order = [r, *[i for i in range(len(a)) if i != r]]
            a = a[np.ix_(order, order)]
            pivot = a[0, 0] if abs(a[0, 0]) > tiny else tiny
            negative += pivot < 0
            a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0]) / pivot
        else:
            p, q = divmod(int(np.argmax(off)), len(a))
            order = [p, q, *[i for i in range(len(a)) if i not in (p, q)]]
            a = a[np.ix_(order, order)]
            block, side = a[:2, :2], a[2:, :2]
            # Such a block has one eigenvalue of each sign.
            negative += 1
            a = a[2:, 2:] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return negative


def above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above a shift."""
    return len(v) - inertia(v - shift * np.eye(len(v)))


def isolated(v: np.ndarray, k: int) -> list[tuple[float, float, int, int]]:
    """Intervals (low, high, first number, how many) of the k largest eigenvalues, largest first."""
    reach = float(np.abs(v).sum(1).max())
    least = 4 * len(v) * EPS * reach
    todo, done = [(-reach - least, reach + least, len(v), 0)], []
    while todo:
        low, high, over_low, over_high = todo.pop()
        if over_low == over_high or over_high >= k:
            continue
        if over_low - over_high == 1 or high - low <= least:
            done.append((low, high, over_high, over_low - over_high))
            continue
        middle = (low + high) / 2
        over = above(v, middle)
        todo += [(low, middle, over_low, over), (middle, high, over, over_high)]
    return sorted(done, key=lambda x: x[2])


def refined(v: np.ndarray, low: float, high: float, first: int, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """Eigenvalue and vector of an interval that holds one eigenvalue: the (first + 1)-th largest."""
    one, d = np.eye(len(v)), len(v)
    scale = max(float(np.abs(v).max()), np.finfo(float).tiny)
    start = np.random.default_rng(first).standard_normal(d)
    while True:
        shift, x = (low + high) / 2, start
        for turn in range(40):
            for other in found:
                x = x - other * (other @ x)
            x = x / np.linalg.norm(x)
            if turn > 1:
                shift = float(x @ v @ x)
            if turn > 2 and np.linalg.norm(v @ x - shift * x) <= 4 * d * EPS * scale:
                break
            try:
                x = np.linalg.solve(v - shift * one, x)
            except np.linalg.LinAlgError:
                x = np.linalg.solve(v - (shift + EPS * scale) * one, x)
        if low - 8 * d * EPS * scale <= shift <= high + 8 * d * EPS * scale:
            return shift, x
        # The iteration went to another eigenvalue: halve the interval and begin again.
        middle = (low + high) / 2
        low, high = (middle, high) if above(v, middle) > first else (low, middle)


def common_space(v: np.ndarray, shift: float, first: int, many: int, found: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Vectors of eigenvalues that lie together: inverse iteration on a block, then Rayleigh-Ritz."""
    scale = max(float(np.abs(v).max()), np.finfo(float).tiny)
    x = np.random.default_rng(first).standard_normal((len(v), many))
    for _ in range(4):
        for other in found:
            x = x - np.outer(other, other @ x)
        x = np.linalg.qr(x)[0]
        x = np.linalg.solve(v - (shift + 4 * len(v) * EPS * scale) * np.eye(len(v)), x)
    for other in found:
        x = x - np.outer(other, other @ x)
    x = np.linalg.qr(x)[0]
    values, turn = np.linalg.eigh(x.T @ v @ x)
    return [(float(values[i]), x @ turn[:, i]) for i in reversed(range(many))]


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric positive matrix, falling, and their vectors as columns.

    Values that are zero to working precision are left out.
    """
    if not len(v) or not np.abs(v).max() > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    values: list[float] = []
    vectors: list[np.ndarray] = []
    for low, high, first, many in isolated(v, k):
        if many == 1:
            made = [refined(v, low, high, first, vectors)]
        else:
            made = common_space(v, (low + high) / 2, first, many, vectors)
        for value, vector in made[:k - len(values)]:
            values.append(value)
            vectors.append(vector)
    kept = [i for i, e in enumerate(values) if e > 16 * len(v) * EPS * values[0]]
    values, vectors = [values[i] for i in kept], [vectors[i] for i in kept]
    certify(v, values)
    return np.array(values), np.array(vectors).reshape(len(values), len(v)).T


def certify(v: np.ndarray, values: list[float]) -> None:
    """Counts just above and below each value must agree with its number among all."""
    slack = 64 * len(v) * EPS * float(np.abs(v).sum(1).max())
    for i, e in enumerate(values):
        if above(v, e + slack) > i or above(v, e - slack) < i + 1:
            raise ArithmeticError(f"eigenvalue {i + 1} is not the one of that number")


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str, scale: int, offset: int) -> DataFrame:
    """(id, x): the rows that take part, x = floor(scale c) + offset."""
    vec = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    fine = vectors.select(F.col(f"`{id_col}`").alias("id"), vec.alias("vec")).where(
        F.coalesce(F.size("vec") > 0, F.lit(False))
        & F.forall("vec", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= MOST), F.lit(False))))
    return fine.select("id", F.transform("vec", lambda c: F.floor(c * scale).cast("long") + offset).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed_products(rows: DataFrame, made, d: int, *values) -> np.ndarray:
    """Sum over all rows of the outer product of ``made(x)`` with itself; d x d numbers reach the driver."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                y = made(matrix(batch["x"]), *values)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(total))], names=["i", "row"])

    parts = rows.select("x").mapInArrow(gather, "i long, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((d, d))
    for i, j, v in cells:
        out[i, j] = v
    return (out + out.T) / 2


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, from the whole numbers n x - sums where these fit."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62:
        return (n * x - sums) / n
    whole, part = sums // n, (sums % n).astype(float) / n
    return (x - whole) - part


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - sums) ** 2 by row; None beyond a long."""
    exact = n * x.astype(object) - sums.astype(object)
    out = (exact * exact).sum(1)
    return [int(v) if v < 1 << 63 else None for v in out]


def fast_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """deviations() in machine numbers where none can overflow."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62:
        whole = n * x - sums
        if int(np.abs(whole).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (whole * whole).sum(1).tolist()
    return deviations(x, n, sums)


class Whitening:
    """The fit: number of distinct rows, exact sums, eigenvalues, vectors, trace, and the measured error."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace, self.error = n, sums, values, vectors, trace, 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, k: int) -> Whitening | None:
    """Whitening of the distinct ``x`` of the rows; None without rows."""
    distinct = checkpointed(rows.select("x").distinct())
    n = distinct.count()
    if not n:
        return None
    sums_of = distinct.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    sums = np.array([int(s) for _, s in sorted(sums_of)], object)
    sums = sums.astype(np.int64) if max(map(abs, sums)) < 1 << 62 else sums
    d = len(sums)
    v = summed_products(distinct, centred, d, n, sums) / n
    values, vectors = leading(v, k)
    made = Whitening(n, sums, values, vectors, float(np.trace(v)))
    if len(values):
        again = summed_products(distinct, made, len(values)) / n
        made.error = float(np.abs(again - np.eye(len(values))).max())
    return made


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, scale: int = 64,
           offset: int = 1_000_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    fine = checkpointed(whole_numbers(vectors, id_col, vec_col, scale, offset))
    common = fine.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = fine.where(F.size("x") == (common[0]["d"] if common else 0))
    made = fit(rows, k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or made is None:
                continue
            x = matrix(batch["x"])
            m = len(made.values)
            yield pa.RecordBatch.from_arrays([
                batch["id"].take(pa.array(np.repeat(np.arange(len(x)), m))),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * m, made.n)),
                pa.array(fast_deviations(x, made.n, made.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), m))),
                pa.array(made(x).ravel()),
                pa.array(np.tile(made.values / made.trace if m else made.values, len(x))),
                pa.array(np.full(len(x) * m, made.error)),
            ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = dict(fine.dtypes)["id"]
    out = rows.mapInArrow(project, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
