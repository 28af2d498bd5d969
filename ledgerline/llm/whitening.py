"""Whitening of embeddings from the singular values of their centred rows.

Vectors are rounded to whole numbers, and the directions are fitted to each
distinct vector once.  Tasks reduce the centred rows block by block, each block
under the triangle so far, to triangular factors (QR), and a tree of tasks joins
the factors to one of dimension times dimension: the covariance is never formed.
Householder reflections make that triangle bidiagonal, the differential quotient
difference transform with shifts (dqds) finds the singular values, and twisted
factorisations of the bidiagonal's own product recover the directions.

The last three work on one triangle for each vector length, on the driver: its
size depends on the dimension, not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize

#: Components of a row.
COMPONENTS = 16
#: Entries c become floor(SCALE * c) + SHIFT.
SCALE = 64
SHIFT = 1_000_000
#: Rows of a block, at least twice the dimension, and triangles that a task joins.
BLOCK = 4096
FAN = 16
#: Singular values below this share of the largest, times the dimension, are zero.
ZERO = 8 * np.finfo(float).eps
#: Neighbouring eigenvalues closer than this, relatively, are a cluster.
CLUSTER = 1e-3

_EPS = np.finfo(float).eps


# --- the triangle's singular values and directions ---------------------------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and V with r = U B V': reflections from the left and the right in turn."""
    x = np.array(r, float)
    d = x.shape[1]
    v = np.eye(d)

    def reflection(y: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(y)
        if size == 0 or not np.any(y[1:]):
            return None
        w = y / size
        w[0] += np.copysign(1.0, w[0])
        return w * np.sqrt(2) / np.linalg.norm(w)

    for i in range(d):
        w = reflection(x[i:, i].copy())
        if w is not None:
            x[i:, i:] -= np.outer(w, w @ x[i:, i:])
        if i < d - 2:
            w = reflection(x[i, i + 1:].copy())
            if w is not None:
                x[i:, i + 1:] -= np.outer(x[i:, i + 1:] @ w, w)
                v[:, i + 1:] -= np.outer(v[:, i + 1:] @ w, w)
    return np.diag(x).copy(), np.diag(x, 1).copy(), v


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds step; None where the shift is beyond the least value. The third list holds the step's d."""
    n = len(q)
    new_q, new_e, ds = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        ds[i] = d
        new_q[i] = d + e[i]
        if new_q[i] == 0:  # d and e are zero: what follows stands alone
            new_e[i], d = 0.0, q[i + 1] - shift
        else:
            t = q[i + 1] / new_q[i]
            new_e[i], d = e[i] * t, d * t - shift
    if d < 0:
        return None
    ds[-1] = new_q[-1] = d
    return new_q, new_e, ds


def qd_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal (a, b), falling."""
    found: list[float] = []
    left = [([x * x for x in a.tolist()], [x * x for x in b.tolist()], 0.0)]
    while left:
        q, e, total = left.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(total + q[0])
                break
            small = (10 * _EPS) ** 2
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= small * (total + q[i]) or e[i] <= small * (total + q[i + 1])),
                       None)
            if cut is not None:
                if cut < n - 2:
                    left.append((q[:cut + 1], e[:cut], total))
                    q, e = q[cut + 1:], e[cut + 1:]
                else:
                    found.append(total + q[-1])
                    q, e = q[:-1], e[:-1]
                continue
            if q[0] < q[-1]:  # values come out at the end, so the small ones should stand there
                q, e = _flipped(q, e)
            # the d of an unshifted step are the reciprocals of the inverse's diagonal: its trace bounds the least value
            step = _transform(q, e, 0.0)
            ds = step[2]
            below = 0.0 if min(ds) <= 0 else 1 / sum(1 / d for d in ds)
            for shift in (min(ds) * (1 - 2 * e[-1] / q[-1]) if e[-1] < 0.1 * q[-1] else below, below * (1 - 8 * _EPS), 0.0):
                if shift >= below * (1 - 8 * _EPS) or shift == 0.0:
                    done = _transform(q, e, max(shift, 0.0))
                    if done is not None:
                        q, e, total = done[0], done[1], total + max(shift, 0.0)
                        break
    return np.array(sorted(found, reverse=True))


def _flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The same bidiagonal read from its other end."""
    return q[::-1], e[::-1]


def _factors(a2: np.ndarray, ab: np.ndarray, b2: np.ndarray, lam: float):
    """LDL' - lam from the top and UDU' from the bottom, for D = a², L = b / a."""
    n, tiny = len(a2), np.finfo(float).tiny * 1e16
    s, p = np.empty(n), np.empty(n)
    lower, upper = np.empty(n - 1), np.empty(n - 1)
    s[0] = -lam
    for i in range(n - 1):
        d = s[i] + a2[i]
        d = d if abs(d) > tiny else -tiny
        lower[i] = ab[i] / d
        s[i + 1] = b2[i] * (s[i] / d) - lam
    p[-1] = a2[-1] - lam
    for i in range(n - 2, -1, -1):
        d = b2[i] + p[i + 1]
        d = d if abs(d) > tiny else -tiny
        upper[i] = ab[i] / d
        p[i] = a2[i] * (p[i + 1] / d) - lam
    return lower, upper, s + p + lam


def twisted(a: np.ndarray, b: np.ndarray, lam: float) -> tuple[np.ndarray, float]:
    """A unit eigenvector of B'B for the eigenvalue near ``lam``, and that eigenvalue, from the twisted factorisation
    whose middle is least."""
    a2, ab, b2 = a * a, a[:-1] * b, b * b
    for _ in range(4):
        lower, upper, gamma = _factors(a2, ab, b2, lam)
        r = int(np.argmin(np.abs(gamma)))
        z = np.zeros(len(a))
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
        for i in range(r, len(a) - 1):
            z[i + 1] = -upper[i] * z[i]
        size = z @ z
        change = gamma[r] / size  # the Rayleigh quotient's
        if not np.isfinite(change) or abs(change) <= 2 * _EPS * abs(lam):
            break
        lam += change
    return z / np.sqrt(size), lam


def _separated(a: np.ndarray, b: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Orthogonal eigenvectors of a cluster, from ``z`` whose columns may be nearly the same."""
    t = np.diag(a * a) + np.diag(np.append(0.0, b * b)[:len(a)])
    t += np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    rng = np.random.default_rng(0)
    centre = np.mean([x @ t @ x for x in z.T])
    shifted = t - (centre + 4 * _EPS * abs(centre)) * np.eye(len(a))
    for _ in range(3):  # inverse iteration of the whole cluster
        for j in range(z.shape[1]):
            x = z[:, j] - z[:, :j] @ (z[:, :j].T @ z[:, j])
            if np.linalg.norm(x) < 0.1:
                x = rng.standard_normal(len(a))
                x -= z[:, :j] @ (z[:, :j].T @ x)
            z[:, j] = x / np.linalg.norm(x)
        try:
            y = np.linalg.solve(shifted, z)
        except np.linalg.LinAlgError:
            break
        z = np.linalg.qr(y / np.linalg.norm(y, axis=0))[0]
    z = np.linalg.qr(z)[0]
    m = z.T @ t @ z
    return z @ np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]  # as many columns as the cluster has values


def singular_directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest squared singular values of the triangle ``r`` and their right singular vectors, as columns.

    Values that are zero to working precision are left out.
    """
    a, b, v = bidiagonal(r)
    b = b[:len(a) - 1]
    size = np.abs(np.concatenate([a, b])).max(initial=0.0)
    if size == 0:
        return np.zeros(0), np.zeros((len(a), 0))
    a, b = a / size, b / size
    # entries that are nothing beside the largest part the bidiagonal
    a = np.where(np.abs(a) < _EPS * 1e-3, 0.0, a)
    cuts = [0, *(np.flatnonzero((np.abs(b) <= _EPS * 1e-2)) + 1), len(a)]
    pairs = []
    for lo, hi in zip(cuts, cuts[1:]):
        own_a, own_b = a[lo:hi], b[lo:hi - 1]
        own = [x for x in qd_values(own_a, own_b) if x > (ZERO * len(a)) ** 2]
        if not own:
            continue
        told = [twisted(own_a, own_b, x) for x in own] if hi - lo > 1 else [(np.ones(1), own[0])]
        z, lams = np.stack([t[0] for t in told], axis=1), np.array([t[1] for t in told])
        start = 0
        for i in range(1, len(own) + 1):
            if i == len(own) or own[i - 1] - own[i] > CLUSTER * own[i - 1]:
                if i - start > 1:
                    z[:, start:i] = _separated(own_a, own_b, z[:, start:i].copy())
                    lams[start:i] = own[start:i]
                start = i
        full = np.zeros((len(a), len(own)))
        full[lo:hi] = z
        pairs += [(lam, full[:, j]) for j, lam in enumerate(lams)]
    pairs.sort(key=lambda x: -x[0])
    pairs = pairs[:k]
    if not pairs:
        return np.zeros(0), np.zeros((len(a), 0))
    return np.array([lam for lam, _ in pairs]) * size * size, v @ np.stack([x for _, x in pairs], axis=1)


# --- over the rows -----------------------------------------------------------------------------------------------

_ROWS = "id long, width int, x binary"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rounded vectors as bytes; rows that are null, or hold what is null or not finite, go."""
    for batch in batches:
        ids, widths, out = [], [], []
        for i, v in zip(batch.column("id").to_pylist(), batch.column("v")):
            if not v.is_valid or v.values.null_count:
                continue
            c = np.floor(SCALE * v.values.to_numpy(zero_copy_only=False).astype("f8"))
            if np.all(np.abs(c) < 2.0 ** 52):  # nan and infinities are not
                ids.append(i)
                widths.append(len(c))
                out.append((c.astype("<i8") + SHIFT).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(widths, pa.int32()), pa.array(out, pa.binary())],
                                         names=["id", "width", "x"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(width, rows, matrix) of blocks of rows of one width."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            widths = part.column("width").to_numpy()
            for width in np.unique(widths):
                own = part.filter(pa.array(widths == width)) if len(np.unique(widths)) > 1 else part
                x = np.frombuffer(b"".join(own.column("x").to_pylist()), "<i8").reshape(own.num_rows, width)
                yield int(width), own, x


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple[int, np.ndarray]] = {}
    for width, own, x in _matrices(batches):
        n, s = total.get(width, (0, 0))
        total[width] = n + own.num_rows, s + x.sum(axis=0)
    for width, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([width] * (width + 1), pa.int32()), pa.array(range(-1, width), pa.int32()),
             pa.array([n, *s.tolist()], pa.int64())], names=["width", "place", "s"])


@dataclass
class Model:
    """Of vectors of one width: how many were fitted, their sums, directions by column and scales."""

    n: int
    sums: np.ndarray
    trace: float = 0.0
    values: np.ndarray = None
    directions: np.ndarray = None
    centre: np.ndarray = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x * self.n - self.sums) / self.n  # exact up to the division

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.directions) / np.sqrt(self.values)


def _triangle(rows: list[np.ndarray]) -> np.ndarray:
    r = np.linalg.qr(np.concatenate(rows), mode="r")
    d = r.shape[1]
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def _triangles(models: dict[int, Model]):
    """One triangle for each task and width, of all its centred rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}
        for width, _, x in _matrices(batches):
            if width:
                rows = waiting.setdefault(width, [])
                rows.append(models[width].centred(x))
                if sum(map(len, rows)) >= max(BLOCK, 2 * width):
                    waiting[width] = [_triangle(rows)]
        yield from _triangle_rows((width, _triangle(rows)) for width, rows in waiting.items())

    return run


def _triangle_rows(found) -> Iterator[pa.RecordBatch]:
    for width, r in found:
        yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([r.astype("<f8").tobytes()], pa.binary())],
                                         names=["width", "r"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            width = row["width"]
            yield from _triangle_rows([(width, _triangle([np.frombuffer(r, "<f8").reshape(width, width) for r in row["rs"]]))])


def _reduced(triangles: DataFrame) -> dict[int, np.ndarray]:
    """One triangle for each width: ``FAN`` are joined in a task until one is left."""
    while True:
        triangles = materialize(triangles, "triangles")
        most = triangles.groupBy("width").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return {r["width"]: np.frombuffer(r["r"], "<f8").reshape(r["width"], r["width"]) for r in triangles.collect()}
        # a group's number follows from its rows' bytes, so a task that runs again builds the same group
        groups = -(-most // FAN)
        triangles = (triangles.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(groups)))
                     .groupBy("width", "g").agg(F.sort_array(F.collect_list("r")).alias("rs")).select("width", "rs")
                     .mapInArrow(_joined, "width int, r binary"))


def _moments(models: dict[int, Model], squares: bool):
    """A task's sums of the whitened rows or, about their mean, of the products of their components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for width, _, x in _matrices(batches):
            model = models[width]
            w = model.whitened(x)
            if squares:
                w = w - model.centre
                total[width] = total.get(width, 0.0) + w.T @ w
            else:
                total[width] = total.get(width, 0.0) + w.sum(axis=0)
        for width, s in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * s.size, pa.int32()), pa.array(range(s.size), pa.int32()), pa.array(s.ravel())],
                names=["width", "place", "s"])

    return run


def _totals(df: DataFrame) -> dict[int, dict[int, float]]:
    """Sums by width and place: as many rows as a model has numbers."""
    out: dict[int, dict] = {}
    for r in df.groupBy("width", "place").agg(F.sum("s").alias("s")).collect():
        out.setdefault(r["width"], {})[r["place"]] = r["s"]
    return out


def _array(found: dict[int, float], size: int) -> np.ndarray:
    return np.array([found[i] for i in range(size)])


def fit(rows: DataFrame, k: int = COMPONENTS) -> tuple[dict[int, Model], float | None]:
    """A model for each width of the vectors in ``rows``, and the largest departure of the fitted vectors' whitened
    covariance from the identity."""
    distinct = materialize(rows.select("width", "x").distinct(), "fit_list")
    models = {width: Model(n=int(s[-1]), sums=np.array([s[i] for i in range(width)], "i8"))
              for width, s in _totals(distinct.mapInArrow(_sums, "width int, place int, s long")).items()}
    triangles = _reduced(distinct.mapInArrow(_triangles(models), "width int, r binary"))
    for width, model in models.items():
        r = triangles.get(width, np.zeros((0, 0)))
        model.trace = float((r * r).sum()) / model.n
        values, model.directions = singular_directions(r, k) if width else (np.zeros(0), np.zeros((0, 0)))
        model.values = values / model.n
    with_values = {w: m for w, m in models.items() if len(m.values)}
    if not with_values:
        return models, None
    fitted = distinct.where(F.col("width").isin(list(with_values)))
    schema = "width int, place int, s double"
    for width, s in _totals(fitted.mapInArrow(_moments(models, False), schema)).items():
        models[width].centre = _array(s, len(models[width].values)) / models[width].n
    error = 0.0
    for width, s in _totals(fitted.mapInArrow(_moments(models, True), schema)).items():
        size = len(models[width].values)
        error = max(error, float(np.abs(_array(s, size * size).reshape(size, size) / models[width].n - np.eye(size)).max()))
    return models, error


def _projected(models: dict[int, Model], error: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, own, x in _matrices(batches):
            model, size = models[width], len(models[width].values)
            if not size:
                continue
            off = x * model.n - model.sums
            reach = float(np.abs(off).max(initial=0)) ** 2 * width
            deviation = (off * off).sum(axis=1) if reach < 2.0 ** 62 else [sum(int(y) ** 2 for y in row) for row in off]
            deviation = [y if y < 2 ** 63 else None for y in map(int, deviation)]
            rows = own.num_rows * size
            yield pa.RecordBatch.from_arrays(
                [own.column("id").take(pa.array(np.repeat(np.arange(own.num_rows), size))),
                 pa.array(np.tile(np.arange(1, size + 1, dtype="i4"), own.num_rows)), pa.array([model.n] * rows, pa.int64()),
                 pa.array([y for y in deviation for _ in range(size)], pa.int64()), pa.array(model.whitened(x).ravel()),
                 pa.array(np.tile(model.values / model.trace, own.num_rows)), pa.array([error] * rows, pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """For each row and component: vec_id, component (from 1, by falling eigenvalue), n (distinct vectors fitted),
    deviation, whitened, explained, identity_error.

    ``deviation`` is the exact sum of (n * x - S)² over the dimensions, null
    beyond a long; ``explained`` the eigenvalue's share of the covariance's
    trace.  Rows whose vector is null, or holds an entry that is null, not
    finite or beyond 2**46, have no rows.  Vectors of each length have a model of
    their own.  Components whose eigenvalue is zero to working precision have no
    rows (fewer vectors than dimensions, constant entries, all vectors equal), nor has an
    empty table.  Repeated rows count once in the fit and stand each in the
    result; null ids stay null.
    """
    rows = materialize(vectors.select(F.col(id_col).cast("long").alias("id"), vector(vector_col).alias("v"))
                       .mapInArrow(_whole, _ROWS), "vectors")
    models, error = fit(rows, k)
    return rows.mapInArrow(_projected(models, error), "vec_id long, component int, n long, deviation long, whitened double, "
                           "explained double, identity_error double")


def vector(name: str) -> Column:
    return F.col(name).cast("array<double>")
