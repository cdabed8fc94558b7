"""Whitened principal components of a vector table by Chebyshev-filtered subspace iteration.

The vectors become whole numbers and are stored once in small packed blocks.
Every step of the iteration is one Spark job over these blocks that returns
XᵀXQ for centred X: tasks multiply their blocks, cells are summed by a shuffle,
and the driver holds matrices of dimension x block width only.  A Chebyshev
polynomial damps the spectrum below the block, QR and Rayleigh-Ritz follow, and
rounds go on until the residual of every wanted pair certifies it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.arrow import lists, matrix
from clickloom.llm.common import materialize, ship_package, table
from clickloom.plans.registry import Query

#: A vector entry c becomes the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Vectors iterated beyond the wanted ones; the filter damps what lies below all of them.
GUARD = 16
#: Entries of a packed block.
BLOCK_CELLS = 1 << 18
#: Residual norm of a certified pair, in parts of its eigenvalue; once rounding stops progress, of the largest one.
TOLERANCE = 2e-14
#: A round's polynomial raises the largest pair over the end of the block by this at most: beyond, rounding drowns the block.
SPREAD = 1e10
ROUNDS = 100
#: Components below this part of the largest eigenvalue are taken as zero: nothing to divide by.
RANK = 1e-9
#: Largest entry that leaves its whole number inside a long.
LARGEST = float(1 << 56)

_PACKED = "vec_ids array<long>, n long, width int, payload binary, sums array<decimal(38,0)>"
_PACKED_ARROW = pa.schema([
    ("vec_ids", pa.list_(pa.int64())), ("n", pa.int64()), ("width", pa.int32()), ("payload", pa.binary()), ("sums", pa.list_(pa.decimal128(38, 0))),
])


@dataclass(frozen=True)
class Centre:
    """Number of vectors and the exact sums of their whole numbers."""

    n: int
    sums: list[int]

    def moved(self, x: np.ndarray) -> np.ndarray:
        """n * x - S of every entry, exactly: as longs where they fit, as Python numbers otherwise."""
        largest = max(int(np.abs(x).max(initial=0)), 1) * self.n + max(map(abs, self.sums))
        if largest < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.moved(x) / self.n).astype(np.float64)


def _pack(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, BLOCK_CELLS // width)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.floor(matrix(batch["vector"], width) * SCALE).astype(np.int64)
            for at in range(0, len(x), rows):
                part = x[at : at + rows]
                low, high = int(part.min()), int(part.max())
                size = next(s for s in (1, 2, 4, 8) if -(1 << 8 * s - 1) <= low and high < 1 << 8 * s - 1)
                if max(-low, high, 1) < (1 << 62) // len(part):
                    sums = part.sum(axis=0).tolist()
                else:
                    sums = part.astype(object).sum(axis=0).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch["vec_id"].slice(at, rows).to_pylist()], pa.list_(pa.int64())),
                    pa.array([len(part)], pa.int64()),
                    pa.array([size], pa.int32()),
                    pa.array([part.astype(f"<i{size}").tobytes()], pa.binary()),
                    pa.array([[Decimal(s + SHIFT * len(part)) for s in sums]], pa.list_(pa.decimal128(38, 0))),
                ], schema=_PACKED_ARROW)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and whole numbers of the packed blocks, one block at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            n, size = batch["n"][i].as_py(), batch["width"][i].as_py()
            x = np.frombuffer(batch["payload"][i].as_buffer(), f"<i{size}").reshape(n, -1)
            yield batch["vec_ids"][i], x.astype(np.int64) + SHIFT


def _cells(m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(m), dtype=np.int32)), lists(m)], names=["i", "row"])


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The matrix whose rows (i, row) the tasks returned in part, added up cell by cell."""
    cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    m = np.zeros(shape)
    m[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["x"].to_numpy()
    return m


def pack(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Centre]:
    """The usable vectors in packed blocks, written once, with their number and sums.

    Left out are vectors that are null or empty, hold null or non-finite entries
    or entries beyond 2^56, and vectors of another length than the most frequent
    one (the longer of two equally frequent).
    """
    ship_package(vectors.sparkSession)
    entries = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    fits = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < LARGEST) & ~F.isnan(c))
    entries = entries.where(F.coalesce((F.size("vector") > 0) & fits, F.lit(False)))
    lengths = entries.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], _PACKED), Centre(0, [])
    blocks = materialize(entries.where(F.size("vector") == lengths.width).mapInArrow(_pack(lengths.width), _PACKED), "vector-blocks")
    sums = blocks.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # one row a dimension
    n = blocks.agg(F.sum("n")).first()[0]
    return blocks, Centre(n, [int(r.x) for r in sorted(sums, key=lambda r: r.i)])


def covariance_times(blocks: DataFrame, centre: Centre, q: np.ndarray) -> np.ndarray:
    """XᵀXQ / n over all blocks, X centred before it is multiplied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches):
            c = centre.centred(x)
            part = c.T @ (c @ q)
            total = part if total is None else total + part
        if total is not None:
            yield _cells(total)

    return _summed(blocks.mapInArrow(run, "i int, row array<double>"), q.shape) / centre.n


def _trace(blocks: DataFrame, centre: Centre) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([float(np.square(centre.centred(x)).sum())])], names=["x"])

    return blocks.mapInArrow(run, "x double").agg(F.sum("x")).first()[0] / centre.n


def leading_pairs(multiply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and eigenvectors of the d x d matrix that ``multiply`` applies.

    The matrix has no negative eigenvalues.  Each round filters the block by a
    Chebyshev polynomial of the interval below it, then orthogonalizes and
    rotates it to Ritz vectors.  Certified leading pairs are locked and projected
    out.
    """
    wanted = min(wanted, d)
    locked, values = np.zeros((d, 0)), []
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(d, min(d, wanted + guard))))[0]
    y, lower, before, slow = multiply(q), None, math.inf, 0
    for _ in range(ROUNDS):
        h = q.T @ y
        theta, u = np.linalg.eigh((h + h.T) / 2)
        theta, u = np.maximum(theta[::-1], 0), u[:, ::-1]
        q, y = q @ u, y @ u
        residual = np.linalg.norm(y - q * theta, axis=0)
        largest = max([*values[:1], theta[0]])
        left = wanted - len(values)
        worst = float((residual / np.maximum(theta, RANK * largest))[:left].max())
        slow = slow + 1 if worst > before / 2 else 0
        certified = residual <= TOLERANCE * (largest if slow >= 3 else np.maximum(theta, RANK * largest))
        if len(theta) + len(values) == d:  # the block spans everything: its Ritz pairs are the eigenpairs
            certified[:] = True
        head = left if certified[:left].all() else int(np.argmin(certified[:left]))
        locked, values = np.hstack([locked, q[:, :head]]), [*values, *theta[:head]]
        if len(values) == wanted:
            order = np.argsort(values, kind="stable")[::-1]
            return np.array(values)[order], locked[:, order]
        q, y, theta, left = q[:, head:], y[:, head:], theta[head:], left - head
        if lower is None:  # of a random block, Ritz values and residuals tell where the spectrum begins
            lower = max(0.0, float((theta - residual[head:]).min()))
        elif slow:
            lower = 0.0  # a bound that surely holds
        before = worst
        upper = min(theta[-1], theta[left - 1] - 0.005 * (theta[left - 1] - lower))  # lower where the whole block is level
        middle, half = (upper + lower) / 2, max((upper - lower) / 2, 1e-6 * theta[0], RANK * largest)
        growth = np.arccosh(np.maximum((theta[[0, left - 1]] - middle) / half, 1 + 1e-9))
        enough = math.log(4 * max(worst / TOLERANCE, 1)) / growth[1]
        apart = math.log(SPREAD) / growth[0]
        degree = int(max(1, min(math.ceil(enough), apart, 40)))
        last, now = q, (y - middle * q) / half
        for _ in range(degree - 1):
            now -= locked @ (locked.T @ now)
            last, now = now, 2 * (multiply(now) - middle * now) / half - last
        for _ in range(2):
            now -= locked @ (locked.T @ now)
            now = np.linalg.qr(now / np.linalg.norm(now, axis=0))[0]
        q = now
        y = multiply(q)
        y -= locked @ (locked.T @ y)
    raise RuntimeError(f"no certificate after {ROUNDS} rounds: residual {worst:.1e}")


def _project(centre: Centre, p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches):
            moved = centre.moved(x)
            if moved.dtype == object or int(np.abs(moved).max()) >= math.isqrt((1 << 63) // moved.shape[1]):
                exact = (moved.astype(object) ** 2).sum(axis=1).tolist()
                deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            else:
                deviation = pa.array(np.square(moved).sum(axis=1))
            whitened = (moved / centre.n).astype(np.float64) @ p
            yield pa.RecordBatch.from_arrays([ids.values, deviation, lists(whitened)], names=["vec_id", "deviation", "whitened"])

    return run


def _moments(rows: DataFrame, width: int, n: int) -> np.ndarray:
    """Covariance of the whitened vectors: their mean first, then products of what is centred."""

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _cells(matrix(batch["whitened"], width).sum(axis=0, keepdims=True))

    mean = _summed(rows.select("whitened").mapInArrow(means, "i int, row array<double>"), (1, width)) / n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            c = matrix(batch["whitened"], width) - mean
            total += c.T @ c
        if total.any():
            yield _cells(total)

    return _summed(rows.select("whitened").mapInArrow(products, "i int, row array<double>"), (width, width)) / n


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable vector and component.

    Which vectors are usable says ``pack``; all of them are the fit list.  Equal
    rows and rows with a null vec_id each give their own rows.  Components whose
    eigenvalue is zero (beyond the rank) are left out, so equal vectors alone
    give no rows, like an empty table.  ``deviation`` is null where it is no long.
    """
    spark = vectors.sparkSession
    blocks, centre = pack(vectors, vec_id, vector)
    empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    trace = _trace(blocks, centre) if centre.n else 0.0
    if not trace > 0:
        return spark.createDataFrame([], empty)
    e, q = leading_pairs(lambda m: covariance_times(blocks, centre, m), len(centre.sums), components)
    kept = e > RANK * e[0]
    e, q = e[kept], q[:, kept]
    rows = materialize(blocks.mapInArrow(_project(centre, q / np.sqrt(e)), "vec_id long, deviation long, whitened array<double>"), "whitened")
    error = float(np.abs(_moments(rows, len(e), centre.n) - np.eye(len(e))).max())
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(x / trace)) for x in e]), F.col("at") + 1)
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, tuple[Query, str | None]] = {"op11_embedding_whitening": (op11_embedding_whitening, None)}
