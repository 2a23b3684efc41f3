"""Whitening of vectors by the leading components of their covariance, found with LOBPCG.

The distinct vectors are written once, centred in the tasks that read them. A step
multiplies the covariance with a block of directions over all of them, in matrices
inside tasks, and sums the parts by dimension on Spark; what comes to the driver is
one block, dimensions by directions, whatever the number of rows. Rayleigh-Ritz on
the iterate, residual and previous direction blocks gives the next block. The
product with the iterate follows from the last step's, so that only what is new in
the basis is multiplied; near the end, where rounding would add up, it is taken anew,
and so it is for the residuals that certify the components.

Rows whose vector is null or has components that are null or not finite are left
out; their ids may be null or repeat. Shorter vectors end in zeros, an empty one is
zeros. Components without variance (a part of 1e-12 of the trace at most) can't be
scaled to one and are left out, so one vector alone, or an empty table, gives no
rows. `deviation` is null where a long can't hold it. Further columns do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import written
from docloom.llm.vectors import matrix, packed, unpacked, usable, whole

#: Directions beyond the wanted ones, which hasten convergence; steps at most; residual over the largest eigenvalue at the end.
GUARD, STEPS, TOLERANCE = 12, 200, 2e-14
#: Vectors of a packed matrix.
ROWS = 2048
LONG_MAX = np.iinfo(np.int64).max


class Centred:
    """Vectors minus their mean, from exact whole numbers: (n * x - S) / n."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.width = len(sums)

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs if they hold it, else as Python's numbers."""
        most = max(map(abs, (int(x.min()), int(x.max())))) if x.size else 0
        if most * self.n + max(map(abs, self.sums), default=0) <= LONG_MAX:
            return x.astype(np.int64) * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.times_n(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of squares of n * x - S, exact."""
        d = self.times_n(x)
        if d.dtype != object and d.size and max(-int(d.min()), int(d.max())) ** 2 * self.width > LONG_MAX:
            d = d.astype(object)
        return [int(v) for v in (d * d).sum(1)]


def summed(df: DataFrame, part, width: int, columns: int, rows: int) -> np.ndarray:
    """The sum over all packed matrices of part(matrix), a matrix of rows by columns."""

    def sums(batches):
        total = np.zeros((rows, columns))
        for batch in batches:
            for data in batch.column(0):
                total += part(unpacked(data.as_py(), width))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), *[pa.array(total[:, j]) for j in range(columns)]], ["i", *[f"v{j}" for j in range(columns)]])

    schema = "i long, " + ", ".join(f"v{j} double" for j in range(columns))
    got = df.select("x").mapInArrow(sums, schema).groupBy("i").agg(*[F.sum(f"v{j}") for j in range(columns)]).collect()
    out = np.zeros((rows, columns))
    for r in got:
        out[r[0]] = r[1:]
    return out


def covariance_block(fit: DataFrame, centred: Centred, block: np.ndarray) -> np.ndarray:
    """The covariance of the fit list times a block of directions."""
    width, n = centred.width, centred.n

    def part(x):
        c = centred(x)
        return c.T @ (c @ block)

    return summed(fit, part, width, block.shape[1], width) / n


def basis(*blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the blocks span, the first block's part first; directions that hardly differ from earlier ones are left out."""
    out = np.zeros((blocks[0].shape[0], 0))
    for b in blocks:
        size = np.linalg.norm(b, axis=0)
        b = b[:, size > 0] / size[size > 0]
        for _ in range(2):
            b = b - out @ (out.T @ b)
        if b.shape[1]:
            u, s, _ = np.linalg.svd(b, full_matrices=False)
            u = u[:, s > 1e-10]
            u = u - out @ (out.T @ u)
            out = np.column_stack([out, np.linalg.qr(u)[0]])[:, : out.shape[0]]
    return out


def lobpcg(product, width: int, wanted: int, guard: int = GUARD, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, their unit vectors and their residuals' norms. product(block) is the matrix times a block.

    Ends when the wanted residuals are below tolerance times the largest eigenvalue, or
    no longer fall, which in doubles they do at about that size.
    """
    m = min(width, wanted + guard)
    x = np.linalg.qr(np.random.default_rng(17).standard_normal((width, m)))[0]
    p = np.zeros((width, 0))
    best, stale = np.inf, 0
    ax = product(x)
    values, inner = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
    x, ax, values = x @ inner[:, ::-1], ax @ inner[:, ::-1], values[::-1]
    kept = (x, values, ax)
    for _ in range(steps):
        r = ax - x * values
        size = np.linalg.norm(r[:, :wanted], axis=0).max(initial=0)
        if size < best * 0.7:
            best, stale = size, 0
        else:
            stale += 1
        if size <= np.linalg.norm(kept[2][:, :wanted] - (kept[0] * kept[1])[:, :wanted], axis=0).max(initial=0):
            kept = (x, values, ax)
        if size <= tolerance * max(values[0], 0) or stale >= 4 or m == width:
            break
        s = basis(x, r, p)
        new = s[:, m:]
        # the basis keeps the span of x first, so its product is known; only new directions are multiplied
        a_s = np.column_stack([ax @ (x.T @ s[:, :m]), product(new)]) if new.shape[1] else ax @ (x.T @ s[:, :m])
        gram = s.T @ a_s
        w, v = np.linalg.eigh((gram + gram.T) / 2)
        v = v[:, ::-1][:, :m]
        values = w[::-1][:m]
        p = new @ v[m:] if new.shape[1] else np.zeros((width, 0))
        x, ax = s @ v, a_s @ v
        if stale == 0 and size < 1e-9 * max(values[0], 0):  # products carried along drift; near the end they are taken anew
            x = np.linalg.qr(x)[0]
            ax = product(x)
            values, inner = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
            x, ax, values = x @ inner[:, ::-1], ax @ inner[:, ::-1], values[::-1]
    x, values, ax = kept
    x = x[:, :wanted] / np.linalg.norm(x[:, :wanted], axis=0)
    ax = product(x)
    values = (x * ax).sum(0)
    return values, x, np.linalg.norm(ax - x * values, axis=0)


def whiten(rows: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", certified: float = 1e-9) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual.

    A row of rows gives one for each of the first components. Vectors are
    floor(256 * component); the covariance is of the distinct ones. residual: norm of
    covariance times component minus eigenvalue times component, over the largest
    eigenvalue; above `certified` the job ends with an error.
    """
    own = rows.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), whole(F.col(vector_col)).alias("x"))
    width = own.agg(F.max(F.size("x"))).first()[0] or 0

    def pack(batches):
        held, n = [], 0

        def cut():
            x = np.concatenate(held)
            sums = [int(v) for v in (x.astype(object) if x.size and max(-int(x.min()), int(x.max())) > LONG_MAX // (2 * ROWS) else x).sum(0)]
            return pa.RecordBatch.from_pylist([{"n": len(x), "sums": [str(v) for v in sums], "x": packed(x)}], pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string())), ("x", pa.binary())]))

        for batch in batches:
            x = matrix(batch.column(0), width)
            for i in range(0, len(x), ROWS):
                held.append(x[i : i + ROWS])
                n += len(held[-1])
                if n >= ROWS:
                    yield cut()
                    held, n = [], 0
        if n:
            yield cut()

    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    fit = written(own.select(padded.alias("x")).distinct().mapInArrow(pack, "n long, sums array<string>, x binary"))
    totals = fit.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    out_schema = own.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("deviation"), *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error", "residual")]).schema
    if not totals:
        return own.sparkSession.createDataFrame([], out_schema)
    centred = Centred(totals[0]["n"], [int(t["s"]) for t in totals])
    n = centred.n
    trace = summed(fit, lambda x: np.array([[(centred(x) ** 2).sum()]]), width, 1, 1)[0, 0] / n
    values, vectors, residuals = lobpcg(lambda block: covariance_block(fit, centred, block), width, min(components, width))
    some = values > 1e-12 * trace
    values, vectors, residuals = values[some], vectors[:, some], residuals[some]
    if not len(values):
        return own.sparkSession.createDataFrame([], out_schema)
    if residuals.max() > certified * values[0]:
        raise ArithmeticError(f"components not certified: residual {residuals.max() / values[0]:.1e}")
    scaled = vectors / np.sqrt(values)

    def spread(x):
        w = centred(x) @ scaled
        return np.vstack([w.T @ w, w.sum(0)])

    k = len(values)
    got = summed(fit, spread, width, k, k + 1) / n
    error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())
    shares, rests = values / trace, residuals / values[0]

    def project(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = matrix(part.column(1), width)
                w, d = centred(x) @ scaled, centred.deviations(x)
                times = lambda v: pa.array(np.tile(v, len(x)))  # noqa: E731, B023
                at = pa.array(np.repeat(np.arange(len(x)), k))
                deviation = pa.array([v if v <= LONG_MAX else None for v in d], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), times(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(len(at), n)), deviation.take(at), pa.array(w.ravel()), times(shares), pa.array(np.full(len(at), error)), times(rests)],
                    names=out_schema.names,
                )

    return own.mapInArrow(project, out_schema)
