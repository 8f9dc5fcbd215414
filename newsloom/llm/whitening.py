"""Embedding whitening (13): blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations.

Entries c become integers x = floor(scale * c) + offset. One pass sums them exactly. In a second one every task reduces its centred
rows block by block to a triangle R by QR; triangles are merged in a tree. On the driver lies one triangle of the vectors' width,
never rows: Householder reflections make it bidiagonal (R = U B P'), dqds finds the squared singular values of B, each to
high relative accuracy, and for each wanted one the twisted factorisation of B'B - s at the index of the smallest pivot
gives its eigenvector; P takes it back. Vectors of clustered values are made orthogonal, by inverse iteration with the
same factors where two start alike. A third pass measures the covariance of what was whitened, merged in the same tree.

Rows whose vector is null or empty, or holds null or non-finite entries, are dropped; of several lengths the commonest stays
(of equally common ones the longest). Products scale * c beyond +-2^62 count as that. A deviation that no long holds is null. Directions
without variance (up to rounding: constant or dependent dimensions, fewer rows than dimensions) have no component. Repeated rows and null
ids count and return like others. An empty table, or one vector, gives no row. Other columns are ignored.
"""

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsloom.llm.common import ship, staged, table

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
BLOCK = 4096
#: Doubles that one merge, or the driver, holds.
HELD = 1 << 22
EPS = np.finfo(float).eps


# ---- the small dense problem: singular values and right vectors of one triangle

def _reflector(x):
    """v with (I - 2vv') x = -+|x| e1, unit length; None if x is zero below its head."""
    if not np.any(x[1:]):
        return None
    top = np.abs(x).max()
    v = x / top
    v[0] += math.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def bidiagonal(r):
    """Diagonal, superdiagonal and P of R = U B P'."""
    a = np.array(r, float)
    n = a.shape[1]
    p = np.eye(n)
    for k in range(n):
        v = _reflector(a[k:, k].copy())
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = _reflector(a[k, k + 1:].copy())
            if v is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
                p[:, k + 1:] -= 2 * np.outer(p[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _sweep(q, e, shift):
    """One differential step with a shift; None if it goes below zero, when the shift was too large."""
    new_q, new_e = [0.0] * len(q), [0.0] * len(e)
    d = q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return None
        new_q[k] = d + e[k]
        ratio = q[k + 1] / new_q[k] if new_q[k] else 1.0
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e


def dqds(q, e, sigma=0.0):
    """Eigenvalues of the matrix with the qd rows q and e, falling; each is raised by ``sigma``."""
    q, e, found = list(map(float, q)), list(map(float, e)), []
    small, floor = (10 * EPS) ** 2, EPS ** 2 * 1e-3 * max([0.0, *q, *e])
    while q:
        n = len(q)
        if n == 1 or e[-1] <= small * (sigma + q[-1]) or e[-1] <= floor:
            found.append(sigma + q.pop())
            if n > 1:
                e.pop()
            continue
        cut = next((k for k in range(n - 2) if e[k] <= small * (sigma + min(q[k], q[k + 1])) or e[k] <= floor), None)
        if cut is not None:
            found += dqds(q[:cut + 1], e[:cut], sigma) + dqds(q[cut + 1:], e[cut + 1:], sigma)
            break
        if 1.5 * q[0] < q[-1]:  # small values leave at the end
            q.reverse()
            e.reverse()
        # the smaller eigenvalue of the last two rows, less what joins them to the others
        a, b, c = q[-2] + e[-1], q[-1], q[-1] * e[-1]
        low = (a * b - c) / ((a + b) / 2 + math.hypot((a - b) / 2, math.sqrt(c)))
        shift = max(0.0, low - (math.sqrt(e[-2] * q[-2]) if n > 2 else 4 * EPS * low))
        step = _sweep(q, e, shift)
        while step is None:
            shift = shift / 4 if shift > 1e-3 * low else 0.0
            step = _sweep(q, e, shift)
        q, e = step
        sigma += shift
    return sorted(found, reverse=True)


class Twisted:
    """N D N' = B'B - value, with unit N that runs down to row ``at`` and up to it from below."""

    def __init__(self, d, f, value):
        n = len(d)
        dd, ell = d * d, f / d[:-1]
        tiny = 1e-40 * dd.max()
        safe = lambda x: x if abs(x) > tiny else tiny
        down, low, s = np.zeros(n), np.zeros(n - 1), np.zeros(n)
        s[0] = -value
        for k in range(n - 1):
            down[k] = safe(s[k] + dd[k])
            low[k] = dd[k] * ell[k] / down[k]
            s[k + 1] = low[k] * ell[k] * s[k] - value
        down[-1] = safe(s[-1] + dd[-1])
        up, high, p = np.zeros(n), np.zeros(n - 1), np.zeros(n)
        p[-1] = dd[-1] - value
        for k in range(n - 2, -1, -1):
            up[k + 1] = safe(dd[k] * ell[k] * ell[k] + p[k + 1])
            t = dd[k] / up[k + 1]
            high[k] = ell[k] * t
            p[k] = p[k + 1] * t - value
        pivots = s + p + value
        self.at = int(np.argmin(np.abs(pivots)))
        self.pivot, self.low, self.high = safe(pivots[self.at]), low, high
        self.middle = np.concatenate([down[:self.at], [self.pivot], up[self.at + 1:]])

    def outward(self, u):
        """z of N' z = u."""
        z = u.copy()
        for k in range(self.at - 1, -1, -1):
            z[k] -= self.low[k] * z[k + 1]
        for k in range(self.at, len(z) - 1):
            z[k + 1] -= self.high[k] * z[k]
        return z

    def vector(self):
        start = np.zeros(len(self.middle))
        start[self.at] = 1.0
        z = self.outward(start)
        return z / np.linalg.norm(z)

    def solved(self, b):
        u = b.copy()
        for k in range(self.at):
            u[k + 1] -= self.low[k] * u[k]
        for k in range(len(u) - 2, self.at - 1, -1):
            u[k] -= self.high[k] * u[k + 1]
        z = self.outward(u / self.middle)
        return z / np.linalg.norm(z)


def spectrum(r, wanted):
    """Squared singular values of the triangle, falling, and the right vectors (columns) of the first ``wanted`` that are not zero."""
    n = r.shape[1]
    r = np.vstack([r, np.zeros((max(0, n - len(r)), n))])
    top = np.abs(r).max() if r.size else 0.0
    if not top:
        return np.zeros(n), np.zeros((n, 0))
    d, f, p = bidiagonal(r / top)
    size = max(np.abs(d).max(), np.abs(f).max(initial=0.0))
    d = np.where(np.abs(d) < 1e-2 * EPS * size, 1e-2 * EPS * size, d)  # less than what the reflections round
    cuts = [0, *(np.flatnonzero(np.abs(f) < 4 * EPS * size) + 1).tolist(), n]
    blocks = [(d[a:b], f[a:b - 1], a) for a, b in zip(cuts, cuts[1:])]
    values = [(value, k) for k, (dd, ff, _) in enumerate(blocks) for value in dqds(dd * dd, ff * ff)]
    values.sort(key=lambda x: (-x[0], x[1]))
    found, done = [], [[] for _ in blocks]
    for value, k in values[:wanted]:
        if value <= (n * EPS) ** 2 * values[0][0]:
            break
        z = _right_vector(*blocks[k][:2], value, [v for x, v in done[k] if x - value < 1e-3 * x])
        done[k].append((value, z))
        found.append(np.concatenate([np.zeros(blocks[k][2]), z, np.zeros(n - blocks[k][2] - len(z))]))
    vectors = p @ np.column_stack(found) if found else np.zeros((n, 0))
    return np.array([x for x, _ in values]) * top * top, vectors


def _right_vector(d, f, value, near):
    """Unit eigenvector of B'B for ``value``, orthogonal to the vectors ``near`` of the same cluster."""
    factors = Twisted(d, f, value)
    z = factors.vector()
    rng = np.random.default_rng(0)

    def apart(z):
        """What of z is orthogonal to ``near``, and how much that is."""
        for _ in range(2):
            for other in near:
                z = z - (other @ z) * other
        size = np.linalg.norm(z)
        return (z / size, size) if size > 1e-12 else (z, 0.0)

    def error(z):
        y = d * z + np.append(f * z[1:], 0.0)
        y = d * y + np.insert(f * y[:-1], 0, 0.0)
        return np.linalg.norm(y - value * z)

    z, size = apart(z)
    best = (error(z) if size else math.inf, z)
    bound = 8 * EPS * math.sqrt(len(d)) * max(np.abs(d).max(), np.abs(f).max(initial=0.0)) ** 2
    for _ in range(20):  # where it was the same vector as before: another one of the cluster, by inverse iteration
        if not near or best[0] <= bound:
            break
        z, size = apart(rng.standard_normal(len(d)))
        for _ in range(2):
            z, size = apart(factors.solved(z))
            if not size:
                break
            best = min(best, (error(z), z), key=lambda x: x[0])
    return best[1]


# ---- passes over the rows

def _matrix(column, width):
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), float).reshape(-1, width)


def _whole(c, scale, offset):
    scaled = np.floor(scale * c)
    bound = 2.0 ** 62
    return np.where(scaled >= bound, 2 ** 62, np.where(scaled <= -bound, -2 ** 62, np.clip(scaled, -bound, bound).astype(np.int64))) + offset


def _rows(batches, width, scale, offset):
    for batch in batches:
        for part in (batch.slice(k, BLOCK) for k in range(0, batch.num_rows, BLOCK)):
            yield part, _whole(_matrix(part.column("v"), width), scale, offset)


def _packed(*arrays):
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _unpacked(blob):
    with np.load(io.BytesIO(blob)) as z:
        return [z[k] for k in z.files]


def reduced(parts, merge, fan, name):
    """One value of the packed rows in ``parts`` (column blob), merged ``fan`` at a time in a tree; None without rows."""
    parts = staged(parts.select(F.monotonically_increasing_id().alias("k"), "blob"), name)

    def group(t: pa.Table) -> pa.Table:
        return pa.table({"k": t.column("k")[:1], "blob": pa.array([_packed(*merge(map(_unpacked, t.column("blob").to_pylist())))], pa.binary())})

    while (count := parts.count()) > fan:
        bins = -(-count // fan)
        parts = staged(parts.groupBy(F.pmod(F.xxhash64("k"), F.lit(bins)).alias("bin")).applyInArrow(group, "k long, blob binary"), name)
    rows = [r["blob"] for r in parts.select("blob").collect()]
    return merge(map(_unpacked, map(bytes, rows))) if rows else None


def column_sums(rows, width, scale, offset):
    """Number of rows, and the exact sum of every dimension as Python integers."""
    def run(batches):
        count, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for _, x in _rows(batches, width, scale, offset):
            count += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if count:
            yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array(high), pa.array(low), pa.array([count] * width, pa.int64())],
                                  names=["dim", "high", "low", "rows"])
    found = rows.mapInArrow(run, "dim int, high long, low long, rows long").groupBy("dim").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "rows")]).orderBy("dim").collect()
    if not found:
        return 0, []
    return int(found[0]["rows"]), [(int(r["high"]) << 32) + int(r["low"]) for r in found]


def whiten(vectors, id_column="vec_id", column="embedding", components=COMPONENTS, scale=SCALE, offset=OFFSET):
    """Rows id, component, n, deviation, whitened, explained, identity_error; ``components`` None takes all."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_column).alias("id"), v.alias("v")).filter(F.col(column).isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width = lengths["width"]
    rows = rows.filter(F.size("v") == width)
    n, sums = column_sums(rows, width, scale, offset)
    base = np.array([s // n for s in sums], dtype=np.int64)  # S/n in whole and broken parts: centred rows keep all digits
    rest = np.array([s % n for s in sums], dtype=np.int64)

    def centred(x):
        return (x - base).astype(float) - rest / n

    def triangles(batches):
        r = np.zeros((0, width))
        for _, x in _rows(batches, width, scale, offset):
            r = np.linalg.qr(np.vstack([r, centred(x)]), mode="r")
        if len(r):
            yield pa.record_batch([pa.array([_packed(r)], pa.binary())], names=["blob"])

    def one_triangle(some):
        r = np.zeros((0, width))
        for (other,) in some:
            r = np.linalg.qr(np.vstack([r, other]), mode="r")
        return [r]

    fan = max(2, HELD // (width * width))
    r, = reduced(rows.mapInArrow(triangles, "blob binary"), one_triangle, fan, "white-r")
    values, directions = spectrum(r, width if components is None else components)
    found = directions.shape[1]
    if not found:
        return vectors.sparkSession.createDataFrame([], schema)
    share = values[:found] / values.sum()
    weights = directions / np.sqrt(values[:found] / n)

    def moments(batches):
        held = (0, np.zeros(found), np.zeros((found, found)))
        for _, x in _rows(batches, width, scale, offset):
            w = centred(x) @ weights
            mean = w.mean(axis=0)
            held = _joined([held, (len(w), mean, (w - mean).T @ (w - mean))])
        if held[0]:
            yield pa.record_batch([pa.array([_packed(*held)], pa.binary())], names=["blob"])

    _, _, square = reduced(rows.mapInArrow(moments, "blob binary"), _joined, fan, "white-cov")
    error = float(np.abs(square / n - np.eye(found)).max())

    def project(batches):
        for part, x in _rows(batches, width, scale, offset):
            k = len(x)
            away = x - base
            size = float(np.abs(away.astype(float)).max()) * n + n if k else 0.0
            if size * size * width < 2.0 ** 62:
                deviation = pa.array(np.square(away * n - rest).sum(axis=1))
            else:
                exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist())) for row in away.tolist()]
                deviation = pa.array([y if y < 2 ** 63 else None for y in exact], pa.int64())
            at = pa.array(np.repeat(np.arange(k), found))
            yield pa.record_batch(
                [part.column("id").take(at), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), k)), pa.array(np.full(k * found, n)),
                 deviation.take(at), pa.array((centred(x) @ weights).ravel()), pa.array(np.tile(share, k)), pa.array(np.full(k * found, error))],
                names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def _joined(some):
    """Count, mean and centred products of all, by pairwise merging."""
    total = None
    for k, mean, square in some:
        if total is None or not total[0]:
            total = (int(k), mean, square)
        elif k:
            n = total[0] + int(k)
            gap = mean - total[1]
            total = (n, total[1] + gap * (int(k) / n), total[2] + square + np.outer(gap, gap) * (total[0] * (int(k) / n)))
    return total


def op13_whitening(spark, folder):
    ship(spark)
    return whiten(table(spark, folder, "embeddings"))
