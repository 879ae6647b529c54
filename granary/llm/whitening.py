"""Embedding whitening by spectrum slicing.

Each entry c of a vector becomes the whole number x = floor(SCALE * c) + OFFSET, so counts and sums are exact. The tasks
give sums of x, then, with the mean known, sums of products of centred vectors; Spark adds them up, and the driver gets
one row per dimension and one per pair of dimensions, however many vectors there are.

The leading eigenpairs of that covariance V come from slicing: the inertia of V - s*I, read from an LDL' factorisation
with symmetric pivoting, counts the eigenvalues above s. Bisection by counts isolates each leading eigenvalue in an
interval of its own, Rayleigh quotient iteration converges there cubically, and the counts on either side of
the result certify its number. Eigenvalues that no shift can part in double precision form a cluster, solved
together by inverse iteration on a block; any orthonormal basis of its space is right.

A vector is left out if it is null or holds null or non-finite entries. Vectors of different length are fitted apart,
each length with its own n. Entries beyond ``LARGEST`` in x are held at that bound, so that sums of any number of rows
stay exact. Components without variance (rounding error only) have no whitened value (null) and no part in the identity error. Fewer
than ``components`` dimensions give as many components; an empty vector none. Rows with equal id are separate.
Other columns are ignored. The matrix of one length is held on the driver: its size does not depend on the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
OFFSET = 100_000
LARGEST = 1 << 31
ROWS = 2048
EPS = float(np.finfo(float).eps)
#: Pivots under this share of their column are not used alone (Bunch and Kaufman).
PIVOT = (1 + 17**0.5) / 8


def inertia(matrix: np.ndarray) -> int:
    """Number of positive eigenvalues, from the blocks of LDL'."""
    a = np.array(matrix, dtype=float)
    n, k, positive = len(a), 0, 0
    while k < n:
        size = 1
        if k + 1 < n:
            r = k + 1 + int(np.abs(a[k + 1 :, k]).argmax())
            below = abs(a[r, k])
            if below > 0 and abs(a[k, k]) < PIVOT * below:
                side = np.abs(a[k:, r])
                side[r - k] = 0
                most = side.max()
                if abs(a[k, k]) * most < PIVOT * below**2:
                    size = 1 if abs(a[r, r]) >= PIVOT * most else 2
                    to = k + size - 1
                    a[[to, r]] = a[[r, to]]
                    a[:, [to, r]] = a[:, [r, to]]
        rest = a[k + size :, k : k + size]
        if size == 1:
            d = a[k, k]
            positive += d > 0
            if d != 0:
                a[k + 1 :, k + 1 :] -= (rest / d) * rest.T
        else:
            block = a[k : k + 2, k : k + 2]
            positive += int((np.linalg.eigvalsh(block) > 0).sum())
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
        k += size
    return int(positive)


class Slices:
    """Counts of eigenvalues above shifts, remembered."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.size = float(np.abs(matrix).sum(axis=1).max())
        #: No two shifts nearer than this are told apart.
        self.least = 4 * EPS * self.size * max(len(matrix), 8)
        self.counts = {-self.size - self.least: len(matrix), self.size + self.least: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = inertia(self.matrix - shift * np.eye(len(self.matrix)))
        return self.counts[shift]

    def bracket(self, k: int) -> tuple[float, float]:
        """Shifts with k or more, and less than k eigenvalues above."""
        return max(s for s, c in self.counts.items() if c >= k), min(s for s, c in self.counts.items() if c < k)

    def isolate(self, k: int) -> tuple[float, float]:
        """The bracket that holds eigenvalue k alone, or one that cannot be parted further."""
        low, high = self.bracket(k)
        while (self.above(low) != k or self.above(high) != k - 1) and high - low > self.least:
            self.above((low + high) / 2)
            low, high = self.bracket(k)
        return low, high


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """A step of inverse iteration, columns orthonormal."""
    for nudge in (0.0, least, -2 * least, 8 * least):
        try:
            found = np.linalg.solve(matrix - (shift + nudge) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return np.linalg.qr(found)[0]
    raise ArithmeticError("no shift near the eigenvalue can be solved")


def _single(slices: Slices, k: int, start: np.ndarray) -> tuple[float, np.ndarray]:
    """Eigenvalue k, alone in its bracket, by Rayleigh quotient iteration."""
    v = slices.matrix
    while True:
        low, high = slices.isolate(k)
        x = _solve(v, (low + high) / 2, _solve(v, (low + high) / 2, start[:, None], slices.least), slices.least)
        value, best = float((x.T @ v @ x)[0, 0]), np.inf
        for _ in range(20):
            error = float(np.linalg.norm(v @ x - value * x))
            if error >= best / 2 or not low - slices.least <= value <= high + slices.least:
                break
            best = error
            x = _solve(v, value, x, slices.least)
            value = float((x.T @ v @ x)[0, 0])
        if low - slices.least <= value <= high + slices.least and best <= 16 * slices.least:
            return value, x[:, 0]
        if high - low <= slices.least:  # as near to its neighbours as to itself
            values, x = _cluster(slices, low, high, 1, start[:, None])
            return float(values[0]), x[:, 0]
        slices.above((low + high) / 2)  # a narrower bracket starts the iteration nearer


def _cluster(slices: Slices, low: float, high: float, size: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of a bracket that no shift can part."""
    x = start[:, :size]
    for _ in range(6):
        x = _solve(slices.matrix, (low + high) / 2, x, slices.least)
    inner = x.T @ slices.matrix @ x
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], (x @ turn)[:, ::-1]


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns, each numbered by counts."""
    k = min(k, len(matrix))
    if not k:
        return np.zeros(0), np.zeros((len(matrix), 0))
    if not np.abs(matrix).any():
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    slices = Slices(matrix)
    starts = np.random.default_rng(11).standard_normal((len(matrix), len(matrix)))
    values: list[float] = []
    vectors = np.zeros((len(matrix), 0))
    while len(values) < k:
        number = len(values) + 1
        low, high = slices.isolate(number)
        size = slices.above(low) - slices.above(high)
        if slices.above(low) == number and size == 1:
            value, x = _single(slices, number, starts[:, number - 1])
            found, x = np.array([value]), x[:, None]
        else:
            size = slices.above(low) - len(values)
            found, x = _cluster(slices, low, high, size, starts)
        for _ in range(2):
            x = x - vectors @ (vectors.T @ x)
        vectors = np.hstack([vectors, np.linalg.qr(x)[0]])
        values += found.tolist()
    slack = 64 * slices.least
    for number, value in enumerate(values[:k], 1):
        if not slices.above(value - slack) >= number > slices.above(value + slack):
            raise ArithmeticError(f"eigenvalue {number} is misnumbered")
    return np.array(values[:k]), vectors[:, :k]


@dataclass
class Fit:
    """What one vector length has learnt; ``weights`` project a centred vector on components of unit variance."""

    n: int
    sums: list[int]
    weights: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    @property
    def live(self) -> np.ndarray:
        return np.isfinite(self.weights).all(axis=0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sum)^2, exact."""
        wide = max(self.n * LARGEST, max(map(abs, self.sums), default=0)) >= 1 << 61
        apart = x.astype(object) * self.n - np.array(self.sums, dtype=object) if wide else x * self.n - np.array(self.sums, dtype=np.int64)
        most = max(abs(int(apart.max(initial=0))), abs(int(apart.min(initial=0))))
        if wide or most**2 * x.shape[1] >= 1 << 63:
            apart = apart.astype(object)
        return (apart * apart).sum(axis=1).tolist()


def whole_numbers(column: pa.Array):
    """(length, rows, x) for each length of the usable vectors in a list column."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1].astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for length in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        c = values[starts[rows][:, None] + np.arange(length)]
        fine = np.isfinite(c).all(axis=1)
        if fine.any():
            x = np.clip(np.floor(SCALE * c[fine]) + OFFSET, -LARGEST, LARGEST)
            yield length, rows[fine], x.astype(np.int64)


def _parts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _sums(batches):
    """(length, at, n, s): rows and sums of each dimension, one set per task. The empty vector counts at -1."""
    held: dict[int, list] = {}
    for part in _parts(batches):
        for length, rows, x in whole_numbers(part.column("vector")):
            own = held.setdefault(length, [0, np.zeros(length, dtype=np.int64)])
            own[0] += len(rows)
            own[1] += x.sum(axis=0)
    for length, (n, s) in held.items():
        yield pa.record_batch(
            [pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()), pa.array(s, pa.int64())],
            names=["length", "at", "n", "s"],
        )


def _products(fits: dict[int, Fit], projected: bool):
    """(length, i, j, v): sums of products of centred entries, or of projected ones, one set per task."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for part in _parts(batches):
            for length, _, x in whole_numbers(part.column("vector")):
                if length in fits:
                    d = fits[length].centred(x)
                    if projected:
                        d = d @ fits[length].weights[:, fits[length].live]
                    held[length] = held.get(length, 0) + d.T @ d
        for length, total in held.items():
            i, j = np.triu_indices(len(total))
            yield pa.record_batch(
                [pa.array(np.full(len(i), length, dtype=np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                names=["length", "i", "j", "v"],
            )

    return run


def _matrices(base: DataFrame, fits: dict[int, Fit], sizes: dict[int, int], projected: bool) -> dict[int, np.ndarray]:
    """Sums of products over all rows, divided by their number."""
    rows = base.mapInArrow(_products(fits, projected), "length int, i int, j int, v double").groupBy("length", "i", "j").agg(F.sum("v").alias("v"))
    out = {length: np.zeros((size, size)) for length, size in sizes.items()}
    found = rows.toArrow()
    columns = [found.column(c).to_numpy() for c in ("length", "i", "j", "v")]
    for length, matrix in out.items():
        own = columns[0] == length
        i, j, v = (c[own] for c in columns[1:])
        matrix[i, j] = matrix[j, i] = v / fits[length].n
    return out


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 8) -> dict[int, Fit]:
    """What all usable vectors say, by length."""
    base = vectors.select(F.col(vector_col).cast("array<double>").alias("vector"))
    sums = base.mapInArrow(_sums, "length int, at int, n long, s long").groupBy("length", "at")
    fits: dict[int, Fit] = {}
    for row in sums.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("length", "at").collect():
        fits.setdefault(row.length, Fit(row.n, [], np.zeros((0, 0)), [])).sums.append(int(row.s))
    covariances = _matrices(base, fits, {length: length for length in fits}, projected=False) if fits else {}
    for length, own in fits.items():
        v = covariances[length]
        values, directions = leading(v, components)
        total = float(np.trace(v))
        live = values > 8 * length * EPS * total
        own.weights = np.where(live, directions / np.sqrt(np.where(live, values, 1)), np.nan)
        own.explained = [max(e, 0.0) / total if total > 0 else None for e in values.tolist()]
    whitened = _matrices(base, fits, {length: int(own.live.sum()) for length, own in fits.items()}, projected=True) if fits else {}
    for length, own in fits.items():
        apart = np.abs(whitened[length] - np.eye(len(whitened[length])))
        own.identity_error = float(apart.max()) if apart.size else None
    return fits


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """id_col, n, deviation (decimal, exact), whitened and explained (arrays, one entry per component), identity_error."""
    fits = fit(vectors, vector_col, components)
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))

    def run(batches):
        for part in _parts(batches):
            for length, rows, x in whole_numbers(part.column("vector")):
                own = fits.get(length)
                k = own.weights.shape[1] if own else 0
                w = own.centred(x) @ own.weights if k else np.zeros((len(rows), 0))
                flat = pa.array(w.reshape(-1), mask=np.isnan(w.reshape(-1)))
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k)
                shares = pa.array((own.explained if own else []) * len(rows), pa.float64())
                yield pa.record_batch(
                    [
                        part.column("id").take(pa.array(rows)),
                        pa.array([own.n if own else None] * len(rows), pa.int64()),
                        pa.array(own.deviations(x) if own else [0] * len(rows), pa.decimal128(38, 0)),
                        pa.ListArray.from_arrays(ends, flat),
                        pa.ListArray.from_arrays(ends, shares),
                        pa.array([own.identity_error if own else None] * len(rows), pa.float64()),
                    ],
                    names=["id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = base.schema["id"].dataType.simpleString()
    out = base.mapInArrow(run, f"id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    return out.withColumnRenamed("id", id_col)
