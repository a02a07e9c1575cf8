"""Whitening of embeddings by the leading components of their covariance, found with LOBPCG.

Entries become whole numbers x, so that counts, sums and deviations are exact. The covariance V is never built: a pass over
the rows takes each task's centred rows C to the block product C'(C B), and the tasks' products are summed. An iteration
multiplies V with the block of residuals, and Rayleigh-Ritz on the span of iterate, residuals and previous directions gives the
next iterate and its directions; all matrices of the driver have as many rows as a vector has entries and three blocks of columns at
most. Once the residuals look small, the iterate is multiplied anew and the residuals are certified by that product: each of
the wanted components must have |V v - e v| of at most TOLERANCE times the largest eigenvalue, or iterations go on. More than PASSES
iterations are an error.

Then rows are whitened, and one more pass sums the products of whitened values, whose covariance is held against the identity.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped; so are those of another length than the
commonest (of equal counts the smallest), as they are no vectors of the same space. Components without variance, such as of constant
entries or of fewer rows than entries, can't be whitened and aren't returned, so one row, or equal rows, or an empty table
give no rows. Of components with equal eigenvalues any orthonormal choice is right. Repeated rows count as often as they come, and
a null vec_id is kept. Extra columns are dropped. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import Scratch, map_rows

COMPONENTS, GUARD, PASSES = 32, 8, 400
#: Residuals as shares of the largest eigenvalue: what iterations aim at, and what must be certified.
AIM, TOLERANCE = 1e-13, 1e-12
#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Of the largest eigenvalue; less is no variance but rounding.
LEAST = 1e-12


def whole_numbers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x (array of long) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fit = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.where(fit).select("vec_id", F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), np.int64).reshape(-1, d)


def _summed(rows: DataFrame, shape: tuple[int, int], product) -> np.ndarray:
    """The sum over all tasks of product(x), a matrix of this shape for each batch of rows."""

    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += product(_matrix(b, "x", product.d))
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.select("x").mapInArrow(run, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros(shape)
    for i, j, value in sums.collect():  # as many as the matrix has entries
        out[i, j] = value
    return out


class Covariance:
    """Products of the covariance of rows (x) with blocks of columns, a pass over the rows each."""

    def __init__(self, rows: DataFrame, n: int, sums: np.ndarray) -> None:
        self.rows, self.n, self.mean, self.d, self.passes = rows, n, sums / n, len(sums), 0

    def times(self, block: np.ndarray) -> np.ndarray:
        mean, own = self.mean, np.ascontiguousarray(block)

        def product(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ own)

        product.d = self.d
        self.passes += 1
        return _summed(self.rows, block.shape, product) / self.n

    def trace(self) -> float:
        mean = self.mean

        def product(x: np.ndarray) -> np.ndarray:
            return np.array([[np.square(x - mean).sum()]])

        product.d = self.d
        return float(_summed(self.rows, (1, 1), product)[0, 0]) / self.n


def orthonormal(block: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what a block's columns add to the span of others, which are orthonormal; what is only rounding is left out."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        for o in others:
            block = block - o @ (o.T @ block)
        if not block.size:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(s[0], 1)]
    return block


def lobpcg(v, d: int, k: int, guard: int = GUARD, aim: float = AIM, tolerance: float = TOLERANCE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of v (times(block) multiplies), their eigenvectors as columns, and the certified residuals' norms.

    Iterate x, residuals w and directions p are an orthonormal basis together. Images of x and p are combined from known ones by
    orthonormal coefficients, so rounding errors don't grow; only w is multiplied.
    """
    m = min(d, k + guard)
    x = np.linalg.qr(np.random.default_rng(0).normal(size=(d, m)))[0]
    vx, p, vp, best, stuck = v.times(x), np.zeros((d, 0)), np.zeros((d, 0)), np.inf, 0
    worst = np.inf
    for _ in range(passes):
        values = (x * vx).sum(0)
        r = vx - x * values
        worst = np.linalg.norm(r[:, :k], axis=0).max()
        best, stuck = (worst, 0) if worst < 0.9 * best else (best, stuck + 1)
        if worst <= aim * values[0] or stuck >= 5 and worst <= tolerance * values[0]:
            x = np.linalg.qr(x)[0]
            vx = v.times(x)
            values, turn = np.linalg.eigh(x.T @ vx)
            values, x, vx = values[::-1], x @ turn[:, ::-1], vx @ turn[:, ::-1]
            norms = np.linalg.norm(vx - x * values, axis=0)[:k]
            if norms.max() <= tolerance * values[0]:
                return values[:k], x[:, :k], norms
            p, vp, best, stuck = p[:, :0], vp[:, :0], np.inf, 0
            r = vx - x * values
        w = orthonormal(r, x, p)
        s = np.hstack([x, w, p])
        vs = np.hstack([vx, v.times(w), vp]) if w.size else np.hstack([vx, vp])
        inner = s.T @ vs
        turn = np.linalg.eigh((inner + inner.T) / 2)[1][:, ::-1][:, :m]
        rest = turn.copy()
        rest[: x.shape[1]] = 0
        onward = orthonormal(rest, turn)
        x, vx, p, vp = s @ turn, vs @ turn, s @ onward, vs @ onward
    raise RuntimeError(f"residuals of {worst:.3g} after {passes} passes, wanted {tolerance:.3g} of the largest eigenvalue")


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scratch: Scratch | None = None, vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained and identity_error."""
    spark = embeddings.sparkSession
    scratch = scratch or Scratch(spark)
    id_kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = scratch.save(whole_numbers(embeddings, vector), "x")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d, n = lengths.d, lengths.n
    rows = rows.where(F.size("x") == d)
    exact = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = [int(s) for _, s in sorted(map(tuple, exact.collect()))]
    v = Covariance(rows, n, np.array(sums, np.float64))
    trace = v.trace()
    if trace <= 0:
        return spark.createDataFrame([], schema)
    k = min(components, d)
    values, vectors, _ = lobpcg(v, d, k)
    own = values > LEAST * values[0]
    values, vectors = values[own], vectors[:, own]
    k, mean, turn = len(values), v.mean, vectors / np.sqrt(values)

    def product(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn
        return np.vstack([w.T @ w, w.sum(0)])

    product.d = d
    moments = _summed(rows, (k + 1, k), product) / n
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())
    explained = (values / trace).tolist()

    def make():
        whole = np.array(sums, object)

        def one(c):
            x = np.array(c["x"], np.int64).reshape(-1, d)
            far = np.array([[n]], object) * x.astype(object) - whole if n * max(abs(int(x.max())), 1) > 1 << 52 else None
            if far is None:
                y = n * x - np.array(sums, np.int64)
                exact = (y.astype(object) ** 2).sum(1) if float(np.abs(y).max()) ** 2 * d > 1 << 62 else np.square(y).sum(1)
            else:
                exact = (far**2).sum(1)
            return {"vec_id": c["vec_id"], "deviation": [int(s) if s < 1 << 63 else None for s in exact], "values": ((x - mean) @ turn).tolist()}

        return one

    found = map_rows(rows, f"vec_id {id_kind}, deviation long, values array<double>", make)
    out = found.select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
    shares = F.array(*[F.lit(e) for e in explained])
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
