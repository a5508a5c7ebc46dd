"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

X has one row for each distinct vector, centred. Starting from a unit v, the method alternates
u = Xv - beta u', r = X'u - alpha v, each made orthogonal to all before it, and thereby finds
orthonormal U and V with XV = UB for a small upper bidiagonal B. The singular values of B and
its right vectors, turned by V, are X's own; the bound on their error is known at each step.

One Spark job does a step: each task multiplies its rows by v, and what comes back is a sum of
three short lists: X'p for p = Xv - beta u', U'p, and p'p. Everything else follows from these,
since X'u is known for each u before: p made orthogonal is p - Uc with c = U'p, its product with
X' is X'p - (X'U)c. The columns of U, as long as the table, are never stored or sent; a task makes
those of its rows from the coordinates W, by U = XW. Sums are made by Spark, per place of a list.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.frames import fresh, kept_in_table, quoted

#: Vectors that a task multiplies at a time.
BLOCK_ROWS = 8192
#: Error that a singular value may still have, against the largest, when the steps end.
TOLERANCE = 2e-15
_LARGEST = (1 << 63) - 1


def _fine(vector):
    return F.size(vector).cast("boolean") & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def numbered(embeddings: DataFrame, vector: str, steps: int, x: str) -> DataFrame:
    """The rows whose vector is usable, with long entries `x` = floor(steps * entry).

    Vectors that are null, empty, or hold a null or non-finite entry are left out, and so are those
    whose length is not the one that most usable rows have (of equally many, the shorter).
    """
    doubles = embeddings.withColumn(x, quoted(vector).cast("array<double>")).filter(_fine(quoted(x)))
    whole = doubles.withColumn(x, F.transform(quoted(x), lambda c: F.floor(c * steps).cast("long")))
    usual = doubles.groupBy(F.size(quoted(x)).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return whole.filter(F.size(quoted(x)) == (usual[0] if usual else 0))


@dataclass(frozen=True)
class Fit:
    """Distinct vectors: how many, the sum of each dimension, and the sum of all squares."""

    n: int
    sums: list[int]
    squares: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, rounded once where the integers allow it."""
        largest = int(np.abs(x).max(initial=0))
        if self.n * largest + max(map(abs, self.sums), default=0) <= 1 << 53:
            return (self.n * x - np.array(self.sums, np.int64)) / self.n
        return x - np.array([s / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sum)^2, exact; null beyond 64 bits."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if x.shape[1] * reach * reach <= _LARGEST:
            gaps = self.n * x - np.array(self.sums, np.int64)
            return (gaps * gaps).sum(axis=1).tolist()
        exact = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist())
        return [value if value <= _LARGEST else None for value in exact]

    @property
    def scatter(self) -> float:
        """Squared length of all centred rows together: n times the trace of the covariance, rounded once."""
        exact = self.n * self.squares - sum(s * s for s in self.sums)
        return exact / self.n if self.n else 0.0


def fit(distinct: DataFrame, dimension: int) -> Fit:
    """Sums over the rows of `distinct` (x), exact for every size that 38 digits hold."""
    wide = F.posexplode("x").alias("place", "c")
    value = F.col("c").cast("decimal(38,0)")
    sums = distinct.select(wide).groupBy("place").agg(F.sum(value).alias("s"), F.sum(value * value).alias("q"), F.count(F.lit(1)).alias("n"))
    found = {row["place"]: row for row in sums.collect()}  # one row per dimension
    n = int(found[0]["n"]) if found else 0
    return Fit(n, [int(found[i]["s"]) for i in range(dimension)] if found else [], sum(int(row["q"]) for row in found.values()))


def _rows_of(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(distinct: DataFrame, lists: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what `lists` makes of blocks of them: a task sends one short list, Spark adds per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                one = lists(_rows_of(batch.column("x").slice(at, BLOCK_ROWS)))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])

    parts = distinct.mapInArrow(run, "place int, value double")
    found = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()
    return np.array([row["value"] for row in sorted(found, key=lambda row: row["place"])])


@dataclass(frozen=True)
class Components:
    """Unit vectors (one per row) by falling singular value of the centred rows."""

    vectors: np.ndarray
    values: np.ndarray


def _orthogonal(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What is left of `vector` outside the rows of `basis`; twice is enough."""
    for _ in range(2):
        vector = vector - basis.T @ (basis @ vector)
    return vector


def components(distinct: DataFrame, fitted: Fit, count: int, seed: int = 0) -> Components:
    """The first `count` singular vectors and values of the centred rows, fewer where the rows span less."""
    d, random = len(fitted.sums), np.random.default_rng(seed)
    most, whole = min(d, fitted.n), fitted.scatter
    if not whole > 0:
        return Components(np.zeros((0, d)), np.zeros(0))
    v = np.zeros((0, d))  # rows: v_1, v_2, ..
    w = np.zeros((0, d))  # rows: coordinates of u_1, u_2, .. , u = X w
    back = np.zeros((0, d))  # rows: X'u_1, X'u_2, ..
    alphas: list[float] = []
    betas: list[float] = []
    following, beta, broken = random.normal(size=d), 0.0, True
    while True:
        new = _orthogonal(following, v)
        new /= np.linalg.norm(new)
        v = np.vstack([v, new])
        # p = X (new - beta w'), as coordinates, so that a task needs its rows and these lists only.
        ahead = new - (beta * w[-1] if len(w) else 0.0)

        def lists(x: np.ndarray, ahead=ahead, w=w) -> np.ndarray:
            rows = fitted.centred(x)
            p = rows @ ahead
            return np.concatenate([rows.T @ p, (rows @ w.T).T @ p if len(w) else np.zeros(0), [p @ p]])

        told = _summed(distinct, lists)
        onto = told[d : d + len(w)]
        alpha = float(np.sqrt(max(0.0, told[-1] - onto @ onto)))
        small = 4e-16 * np.sqrt(whole) * max(1, len(alphas))
        if alpha > small:
            w = np.vstack([w, (ahead - onto @ w) / alpha])
            back = np.vstack([back, (told[:d] - onto @ back) / alpha])
        else:  # new leads nowhere new: a column of zeros
            alpha, w, back = 0.0, np.vstack([w, np.zeros(d)]), np.vstack([back, np.zeros(d)])
        alphas.append(alpha)
        following = _orthogonal(back[-1] - alpha * new, v)
        beta = float(np.linalg.norm(following))
        b = np.diag(alphas) + np.diag(betas, 1)
        left, values, right = np.linalg.svd(b)
        errors = beta * np.abs(left[-1, :count])
        broken = beta <= small
        if len(alphas) >= most or len(alphas) >= d:
            break
        if broken:  # the vectors so far are exact; others, equally long ones too, lie outside
            if whole - float((values**2).sum()) <= 1e-13 * whole:
                break
            beta, following = 0.0, random.normal(size=d)
        elif len(alphas) > count and errors.max() <= TOLERANCE * values[0]:
            break
        betas.append(beta)
    kept = int((values[:count] > 1e-12 * values[0]).sum())
    return Components(right[:kept] @ v, values[:kept])


def whiten(
    embeddings: DataFrame, count: int = 4, steps: int = 256, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 0,
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component up to `count`.

    Rows that are not usable (see `numbered`) are left out; null ids and repeated rows stay. The fit
    takes each distinct vector once. Components whose deviation is zero are not given, so equal
    vectors only, or an empty table, give no rows. A deviation beyond 64 bits is null.
    """
    (x,) = fresh(embeddings, "x")
    rows = numbered(embeddings.select(quoted(vec_id).alias("vec_id"), quoted(vector).alias(x)), x, steps, "x")
    # Copies of a vector are dropped within each task before the rows move.
    distinct = kept_in_table(rows.select("x").distinct(), "whitening-vectors")
    first = distinct.first()
    fitted = fit(distinct, len(first[0]) if first else 0)
    found = components(distinct, fitted, count, seed)
    spread = found.values / np.sqrt(max(1, fitted.n))
    explained = found.values**2 / (fitted.scatter or 1.0)
    k = len(spread)

    def project(x: np.ndarray) -> np.ndarray:
        return fitted.centred(x) @ found.vectors.T / spread

    error = 0.0
    if k:
        means = _summed(distinct, lambda x: project(x).sum(axis=0)) / fitted.n

        def products(x: np.ndarray) -> np.ndarray:
            centred = project(x) - means
            return (centred.T @ centred).ravel()

        covariance = _summed(distinct, products).reshape(k, k) / fitted.n
        error = float(np.abs(covariance - np.eye(k)).max())
    id_kind = rows.schema["vec_id"].dataType
    kind = T.StructType(
        [T.StructField("vec_id", id_kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
         T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
         T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                values, m = _rows_of(part.column("x")), part.num_rows
                place = np.repeat(np.arange(m), k)
                told = fitted.deviations(values)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(place)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, fitted.n)), pa.array([t for t in told for _ in range(k)], pa.int64()),
                     pa.array(project(values).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    kind.names,
                )

    return rows.select("vec_id", "x").mapInArrow(run, kind)
