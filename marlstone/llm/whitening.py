"""Embedding whitening: an incremental eigendecomposition.

Each partition keeps the spectrum of its scatter matrix and applies one centred rank-one update for each vector: the
secular equation gives the new eigenvalues, after deflation of what the vector does not touch. Spectra of partitions
are combined in rounds by successive rank-one updates, one for each eigenpair and one for the difference of the
means. Rounding of that many updates is then taken out by one distributed Rayleigh-Ritz step: all rows are projected on the
basis found, the scatter matrix of the projections is summed, and its eigenvectors turn the basis.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, worker_task

#: An entry c becomes the integer floor(SCALE * c) + OFFSET; |SCALE * c| stops at LARGEST.
SCALE, OFFSET, LARGEST = 64, 1_000_000, float(1 << 52)
#: Components that come out.
COMPONENTS = 32
#: States of partitions that one task combines.
FAN_IN = 16
#: Steps of the secular equation's solver, each of which halves the bracket at least every second time.
MOST_STEPS = 120
#: A step of this share of a root's distance from its pole is the last.
NEAR = 1e-9

_EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, zz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(zz / (d - x)) for ascending, distinct d and positive zz: the pole next to each root, and
    the root's distance from it."""
    k = len(d)
    at = np.arange(k)
    upper = np.append(d[1:], d[-1] + zz.sum())
    gap = upper - d
    after = np.append(zz[1:], 0.0)
    below, ones = np.tri(k), np.ones(k)
    rest = 1 + (zz / ((d - d[:, None]) - gap[:, None] / 2)) @ ones
    left = (rest >= 0) | (at == k - 1)
    origin = np.where(left, d, upper)
    low = np.where(left, np.where(rest >= 0, 0.0, gap / 2), -gap / 2)
    high = np.where(left, np.where(rest >= 0, gap / 2, gap), 0.0)
    # First guess: the two poles beside the root as they are, all others as they stand half way.
    c = rest + 2 * (zz - after) / gap
    mu = _small_root(np.where(left, c, -c) * gap + zz + after, np.where(left, zz, -after) * gap, c)
    mu = np.where((mu > low) & (mu < high), mu, (low + high) / 2)
    out = mu.copy()
    # A line for each root that is still open.
    poles, first, second, open_ = d - origin[:, None], d - origin, upper - origin, at
    for _ in range(MOST_STEPS):
        t = poles - mu[:, None]
        r = zz / t
        before = np.einsum("ij,ij->i", r, below)
        beyond = r @ ones - before
        w = 1 + before + beyond
        low, high = np.where(w < 0, mu, low), np.where(w < 0, high, mu)
        keep = (np.abs(w) > 4 * _EPS * (1 - before + beyond)) & (high - low > 2 * _EPS * np.maximum(np.abs(low), np.abs(high)))
        out[open_] = mu
        if not keep.any():
            break
        if not keep.all():
            poles, first, second, open_, below, t, r, mu, w, low, high = (x[keep] for x in (poles, first, second, open_, below, t, r, mu, w, low, high))
        slope = r / t
        psi = np.einsum("ij,ij->i", slope, below)
        phi = slope @ ones - psi
        one, two = first - mu, second - mu
        new = mu + _small_root((one + two) * w - one * two * (psi + phi), one * two * w, w - one * psi - two * phi)
        inside = (new > low) & (new < high)
        last, mu = mu, np.where(inside, new, (low + high) / 2)
        # Steps shrink quadratically: after one this small there is nothing left to gain.
        settled = inside & (np.abs(mu - last) <= NEAR * np.abs(mu))
        if settled.any():
            out[open_] = mu
            if settled.all():
                break
            poles, first, second, open_, below, mu, low, high = (x[~settled] for x in (poles, first, second, open_, below, mu, low, high))
    return origin, out


def _small_root(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The root of c * x * x - a * x + b that is the smaller one for positive a."""
    root = np.sqrt(np.abs(a * a - 4 * b * c))
    return np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) after vector * vector' is added to a matrix that has those given."""
    z = vector @ basis
    length = float(np.sqrt(z @ z))
    if not length > 0:
        return values, basis
    small = 8 * _EPS * max(float(values[-1]), length * length)
    close = np.diff(values) <= small
    if close.any():
        z, basis = _gathered(values, z, basis, close, small)
    live = np.abs(z) * length > small
    if not live.any():
        return values, basis
    every = bool(live.all())
    d, own = (values, z) if every else (values[live], z[live])
    origin, mu = secular_roots(d, own * own)
    t = (d[:, None] - origin) - mu
    # Weights for which the roots found are exact, so that the vectors come out orthogonal.
    apart = d[:, None] - d
    np.fill_diagonal(apart, 1.0)
    weight = np.sqrt(np.abs(np.prod(t / apart, axis=1)))
    turn = np.copysign(weight, own)[:, None] / t
    turn /= np.sqrt((turn * turn).sum(0))
    if every:
        return origin + mu, basis @ turn
    new, held = origin + mu, basis.copy()
    held[:, live] = basis[:, live] @ turn
    found = values.copy()
    found[live] = new
    order = np.argsort(found, kind="stable")
    return found[order], held[:, order]


def _gathered(values: np.ndarray, z: np.ndarray, basis: np.ndarray, close: np.ndarray, small: float) -> tuple[np.ndarray, np.ndarray]:
    """Deflation of equal eigenvalues: a reflection of their vectors after which one of them has all of the weight."""
    z, basis = z.copy(), basis.copy()
    i = 0
    while i < len(values) - 1:
        j = i + 1
        while j < len(values) and close[j - 1] and values[j] - values[i] <= small:
            j += 1
        if j - i > 1 and np.abs(z[i : j - 1]).max() > 0:
            w = z[i:j].copy()
            norm = np.copysign(np.sqrt(w @ w), w[-1])
            w[-1] += norm
            basis[:, i:j] -= np.outer(basis[:, i:j] @ w, w * (2 / (w @ w)))
            z[i:j] = 0.0
            z[j - 1] = -norm
        i = max(j, i + 1)
    return z, basis


@dataclass
class Spectrum:
    """n rows, their exact sums by dimension, their mean, and the eigenpairs of their scatter matrix."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, [0] * d, np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, x: np.ndarray) -> None:
        """One update for each row of x."""
        self.sums = [s + int(y) for s, y in zip(self.sums, _exact_sums(x), strict=True)]
        with np.errstate(all="ignore"):
            for row in x.astype(float):
                apart = row - self.mean
                self.mean = self.mean + apart / (self.n + 1)
                if self.n:
                    self.values, self.basis = rank_one(self.values, self.basis, apart * np.sqrt(self.n / (self.n + 1)))
                self.n += 1

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        if not self.n:
            self.n, self.sums, self.mean, self.values, self.basis = other.n, other.sums, other.mean, other.values, other.basis
            return
        n, apart = self.n + other.n, other.mean - self.mean
        pairs = [vector * np.sqrt(value) for value, vector in zip(other.values, other.basis.T, strict=True) if value > 0]
        with np.errstate(all="ignore"):
            for vector in [*pairs, apart * np.sqrt(self.n / n * other.n)]:
                self.values, self.basis = rank_one(self.values, self.basis, vector)
        self.mean = self.mean + apart * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    def packed(self) -> bytes:
        whole = b"".join(int(s).to_bytes(16, "little", signed=True) for s in [self.n, *self.sums])
        return whole + self.mean.tobytes() + self.values.tobytes() + np.ascontiguousarray(self.basis).tobytes()

    @classmethod
    def unpacked(cls, data: bytes, d: int) -> Spectrum:
        cut = 16 * (d + 1)
        n, *sums = (int.from_bytes(data[i : i + 16], "little", signed=True) for i in range(0, cut, 16))
        rest = np.frombuffer(data, float, offset=cut)
        return cls(n, sums, rest[:d].copy(), rest[d : 2 * d].copy(), rest[2 * d :].reshape(d, d).copy())


@dataclass
class Whitening:
    """What whitening needs: n, sums by dimension, unit components (columns) with falling eigenvalues, the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        base = np.array([s // self.n for s in self.sums], np.int64)
        return (x - base) - np.array([s % self.n / self.n for s in self.sums])

    def sound(self) -> np.ndarray:
        """Which eigenvalues are above rounding."""
        return self.values > len(self.sums) * _EPS * (self.values[0] if len(self.values) else 0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; not a number where an eigenvalue is zero."""
        sound = self.sound()
        out = self.centred(x) @ self.components
        out[:, ~sound] = np.nan
        out[:, sound] /= np.sqrt(self.values[sound])
        return out

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sums of squares of n * x - sums, exact."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        more = [s % self.n for s in self.sums]
        apart = x - base
        if not len(apart):
            return []
        most = (int(np.abs(apart).max()) + 1) * self.n
        if most * most * len(more) < 1 << 63:
            whole = apart * self.n - np.array(more, np.int64)
            return (whole * whole).sum(1).tolist()
        return [sum((int(a) * self.n - m) ** 2 for a, m in zip(row, more, strict=True)) for row in apart]


def _exact_sums(x: np.ndarray) -> list[int]:
    if not len(x):
        return [0] * x.shape[1]
    if int(np.abs(x).max()) * len(x) < 1 << 62:
        return x.sum(0).tolist()
    return [sum(map(int, column)) for column in x.T]


def _integers(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(np.clip(SCALE * flat, -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def usable(rows: DataFrame, vector: str = "embedding", id_: str = "vec_id") -> tuple[DataFrame, int]:
    """The rows (id, vector) whose vectors are whole and finite, of the commonest length (of equally common ones the smallest),
    and that length; 0 without rows."""
    whole = rows.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = whole.filter(F.col("vector").isNotNull() & ~bad)
    best = whole.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = best["d"] if best else 0
    return whole.filter(F.size("vector") == d), d


def _combined(states: DataFrame, merge, tag: str) -> bytes | None:
    """One state from those of all partitions (part, state), FAN_IN of them at a time and in order of part."""
    level = materialize(states, tag)
    n = level.count()
    while n > 1:
        width = FAN_IN

        def joined(table: pa.Table) -> pa.Table:
            table = table.sort_by("part")
            found = merge(table["state"].to_pylist())
            return pa.table({"part": pa.array([table["part"][0].as_py() // width], pa.int64()), "state": pa.array([found], pa.binary())})  # noqa: B023

        numbered = level.selectExpr("part", "state", f"part div {width} as place")
        level = materialize(numbered.groupBy("place").applyInArrow(joined, "part bigint, state binary"), tag)
        n = level.count()
    row = level.first()
    return row["state"] if row else None


def _per_partition(rows: DataFrame, fold) -> DataFrame:
    """(part, state) of each partition with rows; fold takes the batches' vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = fold(batch["vector"] for batch in batches if batch.num_rows)
        if state is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([state], pa.binary())], names=["part", "state"])

    return rows.select("vector").mapInArrow(worker_task(run), "part bigint, state binary")


def _added(states: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(s) for s in states], axis=0).tobytes()


def fit(rows: DataFrame, d: int) -> Whitening | None:
    """The spectrum of all rows (vector) of length d; nothing without rows or dimensions. Only states of d * d numbers go to the driver."""
    if not d:
        return None

    def updates(vectors) -> bytes | None:
        state = Spectrum.empty(d)
        for column in vectors:
            state.add(_integers(column, d) - OFFSET)
        return state.packed() if state.n else None

    def merged(states: list[bytes]) -> bytes:
        state = Spectrum.unpacked(states[0], d)
        for other in states[1:]:
            state.merge(Spectrum.unpacked(other, d))
        return state.packed()

    found = _combined(_per_partition(rows, updates), merged, "spectra")
    if found is None:
        return None
    whole = Spectrum.unpacked(found, d)
    sums = [s + OFFSET * whole.n for s in whole.sums]
    basis, _ = np.linalg.qr(whole.basis[:, ::-1])
    model = Whitening(whole.n, sums, basis, whole.values[::-1].copy(), 0.0)

    def scatter(vectors) -> bytes | None:
        total = None
        for column in vectors:
            y = model.centred(_integers(column, d)) @ basis
            total = y.T @ y if total is None else total + y.T @ y
        return None if total is None else total.tobytes()

    turned = np.frombuffer(_combined(_per_partition(rows, scatter), _added, "scatter")).reshape(d, d) / whole.n
    values, turn = np.linalg.eigh((turned + turned.T) / 2)
    values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
    return Whitening(whole.n, sums, basis @ turn, values, float(np.trace(turned)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components with an eigenvalue above zero."""
    d, sound = len(model.sums), model.sound()

    def squares(vectors) -> bytes | None:
        total = None
        for column in vectors:
            y = model.project(_integers(column, d))[:, sound]
            held = np.vstack((y.T @ y, y.sum(0)))
            total = held if total is None else total + held
        return None if total is None else total.tobytes()

    k = int(sound.sum())
    if not k:
        return 0.0
    total = np.frombuffer(_combined(_per_partition(rows, squares), _added, "whitened")).reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, vector: str = "embedding", id_: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """For each usable row of rows and each component (from 1 by falling eigenvalue): the id, component, n, deviation, whitened, explained,
    identity_error.

    The vectors of all usable rows are fitted: those without null or non-finite entries. Vectors of another length than the commonest
    are left out, too. An entry beyond 2 ** 52 / 64 counts as that. whitened is null where the eigenvalue is zero to rounding (fewer
    distinct vectors than components), explained where all vectors are equal, deviation where it doesn't fit a long. Null and repeated
    ids are rows like others. Further columns are not read. An empty table gives no rows.
    """
    kind = rows.schema[id_].dataType.simpleString()
    schema = f"`{id_}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    usable_rows, d = usable(rows, vector, id_)
    model = fit(usable_rows, d)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = min(components, d)
    model = Whitening(model.n, model.sums, model.components[:, :k], model.values[:k], model.trace)
    error = identity_error(usable_rows, model)
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _integers(batch["vector"], d)
            white = model.project(x).reshape(-1)
            deviation = [y if y < 1 << 63 else None for y in model.deviation(x)]
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(deviation, pa.int64()).take(each), pa.array(white, mask=np.isnan(white)), pa.array(explained * m, pa.float64()), pa.array(np.full(m * k, error)),
                ],
                names=[id_, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable_rows.mapInArrow(worker_task(out), schema)
