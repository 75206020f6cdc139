"""Whitening of embeddings by incremental eigendecomposition.

A partition keeps the spectrum of the scatter of the vectors that it has read, and each vector is a centred rank-one
update of it: the secular equation gives the new eigenvalues, after deflation of the directions that the update leaves
alone.  Spectra of partitions are combined in rounds of small groups, again by rank-one updates (one for each
eigenvector of the other, one for the distance of the means).  One pass over the rows projects their covariance on the
basis so found (Rayleigh-Ritz), which takes away the rounding of many updates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage, table

#: Components that a row is projected on.
COMPONENTS = 32
#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Spectra that one task of a round combines.
FAN_IN = 16
#: Eigenvalues up to this part of the largest count as zero.
ZERO = 1e-12

_EPS = np.finfo(float).eps
_SPECTRUM = "part int, n long, sums array<long>, values array<double>, basis array<double>"


def _rotate(d: np.ndarray, z: np.ndarray, basis: np.ndarray, tol: float) -> None:
    """Turn neighbours of (nearly) one eigenvalue so that the update meets only the last of them, in place."""
    last = None
    for j in np.flatnonzero(z):
        if last is not None:
            r = np.hypot(z[last], z[j])
            c, s = z[j] / r, z[last] / r
            if (d[j] - d[last]) * c * s <= tol and (d[j] - d[last]) * c * s >= -tol:
                d[last], d[j] = d[last] * c * c + d[j] * s * s, d[last] * s * s + d[j] * c * c
                z[last], z[j] = 0.0, r
                left, right = basis[:, last].copy(), basis[:, j].copy()
                basis[:, last], basis[:, j] = c * left - s * right, s * left + c * right
        last = j


def secular_roots(d: np.ndarray, z: np.ndarray) -> np.ndarray:
    """gap[i, j] = d[j] - root i of 1 + sum z^2 / (d - x) = 0, for rising d and z without zeros.

    Root i lies between d[i] and d[i + 1] (the last one below d[-1] + |z|^2).  It is kept as its distance from the nearer
    end, so that the gaps are exact to the last digits, and found by interpolation with both neighbouring poles,
    inside a bracket that is halved when a step would leave it.  Steps shrink quadratically, so a small one is the last.
    """
    k = len(d)
    z2 = z * z
    lower = np.tri(k) * z2  # [i, j]: the weights of the poles at or below root i
    upper = np.append(d[1:], d[-1] + z2.sum())
    half = (upper - d) / 2
    left = 1 + (1 / (d - (d + half)[:, None])) @ z2 >= 0
    origin = np.where(left, d, upper)
    tau, low, high = np.where(left, half, -half), np.where(left, 0.0, -half), np.where(left, half, 0.0)
    poles, start, end = d - origin[:, None], d - origin, upper - origin
    live, mine, below = np.arange(k), poles, lower
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(80):
            t = tau[live]
            inverse = 1 / (mine - t[:, None])
            f = 1 + inverse @ z2
            inverse *= inverse
            slope, slope_below = inverse @ z2, np.einsum("ij,ij->i", inverse, below)
            low[live], high[live] = np.where(f < 0, t, low[live]), np.where(f > 0, t, high[live])
            p, q = start[live] - t, end[live] - t
            c, a, b = f - p * slope_below - q * (slope - slope_below), (p + q) * f - p * q * slope, p * q * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            new = t + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            inside = (new > low[live]) & (new < high[live])  # false for what is not a number
            small = np.abs(new - t) <= 1e-9 * np.abs(t)
            new = np.where(inside, new, np.where(small | (f == 0), t, (low[live] + high[live]) / 2))
            done = small | (np.abs(new - t) <= 2 * _EPS * np.abs(t))
            tau[live] = new
            if done.any():
                live = live[~done]
                if not len(live):
                    break
                mine, below = poles[live], lower[live]
    return poles - tau[:, None]


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of basis diag(values) basis' + weight v v'."""
    z = np.sqrt(weight) * (v @ basis)
    size = np.sqrt(z @ z)
    tol = 8 * _EPS * max(values[-1], size * size)
    if size * size <= tol * _EPS:
        return values, basis
    z[np.abs(z) * size <= tol] = 0.0
    if (np.abs(np.diff(values) * z[:-1] * z[1:]) <= tol * (z[:-1] ** 2 + z[1:] ** 2)).any():
        values, basis = values.copy(), basis.copy()
        _rotate(values, z, basis, tol)
    live = np.flatnonzero(z)
    if not len(live):
        return values, basis
    live = live[np.argsort(values[live], kind="stable")]
    d, z = values[live], z[live]
    gap = secular_roots(d, z)
    # the weights of which the roots are exact; vectors from these are orthogonal to working precision
    between = d - d[:, None]
    np.fill_diagonal(between, -1.0)
    exact = np.copysign(np.sqrt(np.abs(np.prod(gap / between, axis=0))), z)
    turn = exact / gap
    turn /= np.sqrt(np.einsum("ij,ij->i", turn, turn))[:, None]
    new = d - np.diagonal(gap)
    if len(live) == len(values):
        out, vectors = new, basis[:, live] @ turn.T
    else:
        out, vectors = values.copy(), basis.copy()
        out[live], vectors[:, live] = new, basis[:, live] @ turn.T
    if (np.diff(out) < 0).any():
        order = np.argsort(out, kind="stable")
        out, vectors = out[order], vectors[:, order]
    return out, vectors


class Spectrum:
    """n, exact sums, and the eigenvalues and eigenvectors of the scatter of integer vectors around their mean."""

    def __init__(self, dims: int):
        self.n, self.sums, self.values, self.basis = 0, np.zeros(dims, np.int64), np.zeros(dims), np.eye(dims)

    def add(self, x: np.ndarray, times: int = 1) -> None:
        """``times`` vectors x."""
        if self.n:
            v = x - self.sums / self.n
            self.values, self.basis = rank_one(self.values, self.basis, v, self.n * times / (self.n + times))
        self.n += times
        self.sums += times * x

    def merge(self, other: Spectrum) -> None:
        """The vectors of ``other`` too."""
        if not other.n:
            return
        if not self.n:
            self.n, self.sums, self.values, self.basis = other.n, other.sums, other.values, other.basis
            return
        for e, u in zip(other.values, other.basis.T, strict=True):
            if e > 0:
                self.values, self.basis = rank_one(self.values, self.basis, u, e)
        self.values, self.basis = rank_one(self.values, self.basis, other.sums / other.n - self.sums / self.n, self.n / (self.n + other.n) * other.n)
        self.n += other.n
        self.sums = self.sums + other.sums

    def row(self, part: int) -> dict:
        return {"part": [part], "n": [self.n], "sums": [self.sums], "values": [self.values], "basis": [self.basis.ravel()]}

    @classmethod
    def of(cls, r) -> Spectrum:
        out = cls(len(r["values"]))
        out.n, out.sums, out.values = int(r["n"]), np.array(r["sums"], np.int64), np.array(r["values"], float)
        out.basis = np.array(r["basis"], float).reshape(len(out.values), -1)
        return out


def _matrix(column, dims: int) -> np.ndarray:
    """A batch's vectors as whole numbers around zero (SHIFT is left out)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dims)


def _by_rounds(parts: DataFrame, merge: Callable[[list[pd.Series]], pd.DataFrame], schema: str, name: str) -> pd.Series | None:
    """One row of a table of a row a partition: rounds in which a task merges the rows of ``FAN_IN`` neighbours."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return merge([r for _, r in pdf.sort_values("part").iterrows()])

    staged = stage(parts, name)
    while (top := staged.agg(F.max("part").alias("top")).first()["top"]) is not None and top > 0:
        step = staged.groupBy(F.floor(F.col("part") / FAN_IN).alias("of")).applyInPandas(run, schema)
        new = stage(step, name)
        drop_stage(staged)
        staged = new
    rows = staged.collect()  # one
    drop_stage(staged)
    return rows[0] if rows else None


def _spectrum(rows: DataFrame, dims: int) -> Spectrum | None:
    """The spectrum of all rows."""

    def partial(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        held = Spectrum(dims)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), dims)
            kinds, first, times = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * dims))).ravel(), return_index=True, return_counts=True)
            for i, n in zip(first.tolist(), times.tolist(), strict=True):
                held.add(x[i], n)
        if held.n:
            made = pd.DataFrame(held.row(TaskContext.get().partitionId()))
            yield pa.RecordBatch.from_pydict({"part": pa.array(made["part"], pa.int32()), "n": pa.array(made["n"], pa.int64()), **{c: pa.array(list(made[c])) for c in ("sums", "values", "basis")}})

    def merge(found: list[pd.Series]) -> pd.DataFrame:
        out = Spectrum.of(found[0])
        for r in found[1:]:
            out.merge(Spectrum.of(r))
        return pd.DataFrame(out.row(int(found[0]["part"]) // FAN_IN))

    got = _by_rounds(rows.mapInArrow(partial, _SPECTRUM), merge, _SPECTRUM, "spectra")
    return None if got is None else Spectrum.of(got)


def _scatter(rows: DataFrame, dims: int, project: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of y y' over the rows' projections y, by partial matrices."""
    schema = "part int, cells array<double>"

    def partial(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                y = project(_matrix(batch.column(0), dims))
                total += y.T @ y
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "cells": pa.array([total.ravel()])})

    def merge(found: list[pd.Series]) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(found[0]["part"]) // FAN_IN], "cells": [sum(np.asarray(r["cells"]) for r in found)]})

    got = _by_rounds(rows.mapInArrow(partial, schema), merge, schema, "scatter")
    return np.zeros((size, size)) if got is None else np.array(got["cells"]).reshape(size, size)


class Whitening:
    """n, sums (of x, SHIFT included), eigenvalues of the covariance by falling size, components as columns, identity_error."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, components: np.ndarray):
        self.n, self.sums, self.values, self.components, self.identity_error = n, sums, values, components, 0.0

    @property
    def explained(self) -> np.ndarray:
        total = self.values.sum()
        return self.values / total if total > 0 else np.zeros(len(self.values))

    def scale(self, k: int) -> np.ndarray:
        """Components over the roots of their eigenvalues; not a number where an eigenvalue counts as zero."""
        held = self.values[:k] > ZERO * max(self.values[0], 0) if len(self.values) else np.empty(0, bool)
        return self.components[:, :k] / np.sqrt(np.where(held, self.values[:k], np.nan))


def usable(vectors: DataFrame, key: str, vec: str) -> tuple[DataFrame, int]:
    """(rows (vec, key) whose vector has no null and no non-finite entry, their length).

    Of vectors of several lengths, those of the most frequent one stay (of equally frequent ones, the longest).
    """
    rows = vectors.select(F.col(vec).cast("array<double>").alias("vec"), F.col(key).cast("long").alias("vec_id"))
    rows = rows.where(F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    sizes = rows.groupBy(F.size("vec").alias("dims")).count().where("dims > 0").orderBy(F.desc("count"), F.desc("dims")).first()
    dims = sizes["dims"] if sizes else 0
    return rows.where(F.size("vec") == dims), dims


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of ``usable``; None if there are none."""
    found = _spectrum(rows.select("vec"), dims) if dims else None
    if found is None:
        return None
    n, sums, basis = found.n, found.sums, found.basis
    mean = sums / n
    ritz = _scatter(rows.select("vec"), dims, lambda x: (x - mean) @ basis, dims) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    vectors = (basis @ turn)[:, ::-1]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    vectors *= np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0) < 0, -1.0, 1.0)  # one sign for all rows and runs
    made = Whitening(n, [int(s) + n * SHIFT for s in sums], np.maximum(values[::-1], 0.0), np.ascontiguousarray(vectors))
    k = min(components, dims)
    scale = made.scale(k)
    held = np.isfinite(scale).all(0)
    scale = scale[:, held]
    if held.any():
        cov = _scatter(rows.select("vec"), dims, lambda x: (x - mean) @ scale, scale.shape[1]) / n
        made.identity_error = float(np.abs(cov - np.eye(len(cov))).max())
    return made


def whiten(rows: DataFrame, dims: int, made: Whitening, components: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation, whitened (array<double>, a null where an eigenvalue counts as zero) of each row."""
    n, sums = made.n, np.array([s - made.n * SHIFT for s in made.sums], np.int64)
    mean, scale = sums / n, made.scale(min(components, dims))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), dims)
            far = float(np.abs(x - mean).max()) * n + 1
            if far * far * dims < 2.0**62:
                deviation = ((n * x - sums) ** 2).sum(1).tolist()
            else:  # whole numbers of any size; what a long cannot hold is null
                deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
                deviation = [d if d < 1 << 63 else None for d in deviation]
            w = (x - mean) @ scale
            cells = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(1), "deviation": pa.array(deviation, pa.int64()), "whitened": pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), cells)})

    return rows.select("vec", "vec_id").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whitened(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row a vector and component.

    Vectors that are null, empty or hold null or non-finite entries are left out, and those of another length than most.
    Repeated rows are rows of their own.  Fewer dimensions give fewer components; where an eigenvalue counts as zero
    (fewer different vectors than components) whitened is null.  deviation is null where it is beyond a long.  A table
    without a usable vector gives no rows.  Other columns are not read.
    """
    rows, dims = usable(vectors, key, vec)
    made = fit(rows, dims, components)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    wide = whiten(rows, dims, made, components)
    shares = F.array(*[F.lit(float(x)) for x in made.explained[: min(components, dims)]])
    long = wide.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(made.identity_error).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """All usable vectors of ``embeddings`` on the components of their whitening."""
    return whitened(table(spark, sf_dir, "embeddings"))
