"""Whitening of embedding vectors by the principal components of all of them.

Vectors become integers, so their number, sums and centred products are exact sums of small
terms that any partitioning gives. Blocks of vectors are centred before they are multiplied;
tasks send one d x d scatter each, which Spark adds up entry by entry. The d x d problem is
solved once on the driver: a Cholesky factor of the scatter with pivots, then one-sided
Jacobi rotations of the factor's columns until these are orthogonal. Their squared norms are
the eigenvalues and the columns, normalised, the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c is taken as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Scaled entries from here on count as not finite: they would leave the exact range of a double.
LARGEST = float(1 << 52)
#: Vectors that a task holds as numbers at a time.
ROWS = 4096


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """F (d x rank) with F F' = a, for a positive semi-definite matrix: column by column, the largest remaining diagonal entry first.

    Rows are in their own order, i.e. F is the triangular factor with its rows put back.
    """
    d = len(a)
    rest, rows, factor = np.diag(a).astype(float).copy(), np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(d):
        at = k + int(rest[rows[k:]].argmax())
        rows[[k, at]] = rows[[at, k]]
        p, below = rows[k], rows[k + 1 :]
        if rest[p] <= least:
            return factor[:, :k]
        factor[p, k] = np.sqrt(rest[p])
        factor[below, k] = (a[below, p] - factor[below, :k] @ factor[p, :k]) / factor[p, k]
        rest[below] -= factor[below, k] ** 2
    return factor


def rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of pairs that share no column (a round robin)."""
    seats = np.arange(n + n % 2)
    half = len(seats) // 2
    for _ in range(len(seats) - 1):
        a, b = seats[:half], seats[half:][::-1]
        both = (a < n) & (b < n)
        yield np.minimum(a, b)[both], np.maximum(a, b)[both]
        seats[1:] = np.roll(seats[1:], 1)


def jacobi_columns(factor: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated in pairs until all are orthogonal, largest first; products F F' stay."""
    f = np.array(factor, float)
    for _ in range(sweeps):
        turned = False
        for i, j in rounds(f.shape[1]):
            x, y = f[:, i], f[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            todo = np.abs(xy) > tolerance * np.sqrt(xx * yy)
            if not todo.any():
                continue
            turned = True
            xy = np.where(todo, xy, 1.0)
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = np.where(todo, 1 / np.hypot(1.0, t), 1.0)
            s = np.where(todo, c * t, 0.0)
            f[:, i], f[:, j] = c * x - s * y, s * x + c * y
        if not turned:
            break
    return f[:, np.argsort(-(f * f).sum(0), kind="stable")]


@dataclass
class Whitening:
    """n vectors of ``dims`` entries with exact ``sums``; components (dims x k) and their eigenvalues, largest first; the trace of the covariance."""

    n: int
    dims: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, taken apart so that no digit is lost: an integer part, then the rest."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - part

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - sums)^2, exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        off = [s % self.n for s in self.sums]
        z = x - whole  # n x - sums = n z - off
        if self.n * (int(np.abs(z).max(initial=0)) + 1) < 2**31 / max(self.dims, 1) ** 0.5:
            y = self.n * z - np.array(off, np.int64)
            return (y * y).sum(1).tolist()
        y = z.astype(object) * self.n - np.array(off, object)
        return (y * y).sum(1).tolist()


def _integers(column: pa.Array, dims: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x) of the vectors of an Arrow column that take part, by their length."""
    lengths = np.diff(column.offsets.to_numpy())
    valid = np.asarray(column.is_valid()) & (lengths > 0)
    for d in np.unique(lengths[valid]) if dims is None else [dims]:
        at = np.flatnonzero(valid & (lengths == d))
        if not len(at):
            continue
        flat = column.take(pa.array(at)).flatten()
        c = np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))).reshape(-1, d) * SCALE
        good = (np.abs(c) < LARGEST).all(1)  # false for NaN
        yield at[good], np.floor(c[good]).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], dims: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            for places, x in _integers(part.column(0), dims):
                yield part, places, x


def _total(partial: DataFrame, kind: str) -> DataFrame:
    """(dims, i, v): arrays of the same length, one a task and length of vectors, added up entry by entry."""
    return partial.select("dims", F.posexplode("v").alias("i", "v")).groupBy("dims", "i").agg(F.sum(F.col("v").cast(kind)).alias("v"))


def fit(vectors: DataFrame, k: int | None = None, vec_col: str = "embedding") -> Whitening | None:
    """Components of all vectors that take part, by falling eigenvalue; at most ``k``.

    Vectors that are null or empty or hold null, non-finite or huge entries take no part.
    Of vectors of several lengths those of the most frequent one do (the longer, if tied).
    Directions without variance are no components. None if no vector takes part.
    """
    src = vectors.select(F.col(vec_col).alias("_v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for _, _, x in _blocks(batches):
            new = [len(x), *x.sum(0).tolist()]
            held[x.shape[1]] = [a + b for a, b in zip(held.get(x.shape[1], [0] * len(new)), new, strict=True)]
        yield pa.RecordBatch.from_pydict({"dims": list(held), "v": [[str(s) for s in v] for v in held.values()]}, schema=pa.schema([("dims", pa.int32()), ("v", pa.list_(pa.string()))]))

    totals = _total(src.mapInArrow(sums, "dims int, v array<string>"), "decimal(38,0)").collect()  # a row a dimension
    if not totals:
        return None
    count = {r["dims"]: int(r["v"]) for r in totals if r["i"] == 0}
    dims = max(count, key=lambda d: (count[d], d))
    found = {r["i"]: int(r["v"]) for r in totals if r["dims"] == dims}
    model = Whitening(found[0], dims, [found[i + 1] for i in range(dims)], np.zeros((dims, 0)), np.zeros(0), 0.0)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((dims, dims))
        for _, _, x in _blocks(batches, dims):
            y = model.centred(x)
            held += y.T @ y
        yield pa.RecordBatch.from_pydict({"dims": [dims], "v": [held.ravel()]}, schema=pa.schema([("dims", pa.int32()), ("v", pa.list_(pa.float64()))]))

    entries = _total(src.mapInArrow(scatter, "dims int, v array<double>"), "double").select("i", "v").toPandas()  # dims * dims rows
    v = np.zeros(dims * dims)
    v[entries["i"]] = entries["v"]
    covariance = v.reshape(dims, dims) / model.n
    rotated = jacobi_columns(pivoted_cholesky((covariance + covariance.T) / 2))
    values = (rotated * rotated).sum(0)
    model.components, model.values, model.trace = rotated[:, :k] / np.sqrt(values[:k]), values[:k], float(np.trace(covariance))
    return model


def identity_error(vectors: DataFrame, model: Whitening, vec_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity; 0 without components."""
    k = model.components.shape[1]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for _, _, x in _blocks(batches, model.dims):
            w = model.project(x)  # centred already
            first += w.sum(0)
            second += w.T @ w
        yield pa.RecordBatch.from_pydict({"dims": [0], "v": [np.concatenate((first, second.ravel()))]}, schema=pa.schema([("dims", pa.int32()), ("v", pa.list_(pa.float64()))]))

    entries = _total(vectors.select(F.col(vec_col).alias("_v")).mapInArrow(moments, "dims int, v array<double>"), "double").toPandas()  # k + k * k rows
    v = np.zeros(k + k * k)
    v[entries["i"]] = entries["v"]
    mean = v[:k] / model.n
    return float(np.abs(v[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component from 1, n, deviation, whitened, explained) for each vector that takes part and each component.

    Ids may be null or repeat; each row counts. ``deviation`` is a decimal, as the exact sum
    outgrows a long with many vectors. Without vectors or components there are no rows.
    """
    src = vectors.select(F.col(vec_col).alias("_v"), F.col(id_col).alias("_id"))
    if model is None or not len(model.values):
        none = src.where("false").select("_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"), F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"))
        return none.withColumnRenamed("_id", id_col)
    k = len(model.values)
    schema = pa.schema([("deviation", pa.string()), ("w", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, places, x in _blocks(batches, model.dims):
            ids = part.column(1).take(pa.array(places))
            cols = [pa.array([str(d) for d in model.deviation(x)]), pa.array(list(model.project(x)), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([ids, *cols], schema=schema.insert(0, pa.field("_id", ids.type)))

    kind = src.schema["_id"].dataType.simpleString()
    rows = src.mapInArrow(run, f"_id {kind}, deviation string, w array<double>")
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = rows.select("_id", "deviation", F.posexplode("w").alias("_at", "whitened"))
    return each.select(
        F.col("_id").alias(id_col), (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", share[F.col("_at")].alias("explained"),
    )
