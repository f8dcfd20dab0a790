"""Operator 12: embedding whitening from an exact integer scatter matrix.

Entries become integers v = floor(64 * c), which is x - SHIFT for the contract's x = floor(64 * c) + SHIFT;
the scatter n * XᵀX - SSᵀ does not change under a shift, and small integers keep the exact work short.

1. Each task multiplies blocks of BLOCK_ROWS rows. A value is cut into limbs of LIMB_BITS bits; the sums of a
   block stay below 2**53, so products of limbs are exact in floating point and run as matrix products. Block
   sums are added up as integers of any length, and leave the task as 32-bit limbs.
2. One aggregation adds the limbs of each matrix entry; its result, a number for each pair of dimensions,
   is all that reaches the driver, whatever the number of rows.
3. There n * XᵀX - SSᵀ is formed exactly, divided by n² with one correct rounding an entry, and decomposed by eigh.
4. Each task projects its rows: n * v - S is exact, the division by n comes last.

Two more passes check the result against the rows (identity_error) and write it. Nothing is shuffled but sums.

Defined results: a row whose vector is null, or has a null or non-finite entry, is dropped; so is one whose number of
entries is not the commonest (the larger one if two are equally common); repeated rows and null ids count as rows
like others; |64 * c| is held under 2**63 - 2**21; a component is left out where its eigenvalue is zero in double precision, so
fewer than two different vectors give no rows; a deviation beyond a 64-bit integer is null; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Production parameters: components returned, scale and shift of the integers, and the exact products' block.
COMPONENTS, SCALE, SHIFT, BLOCK_ROWS, LIMB_BITS = 32, 64, 1_000_000, 1 << 12, 20
#: Limbs of 32 bits that a task's sums are sent in: products of 63-bit values over 2**40 rows need 166 bits.
WIDE, WORDS = 32, 6
_BOUND = float((1 << 63) - (1 << 21))


@dataclass(frozen=True)
class Fit:
    """Row count, sums of v, components (columns are eigenvectors), their eigenvalues and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def integers(column: pa.Array, size: int) -> np.ndarray:
    """v of each row and dimension."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * flat), -_BOUND, _BOUND).astype(np.int64).reshape(-1, size)


def limbs(v: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(power of two, float matrix) whose weighted sum is v; one matrix where all entries are short."""
    if not v.size or (-(1 << LIMB_BITS) < v.min() and v.max() < 1 << LIMB_BITS):
        return [(0, v.astype(np.float64))]
    cut = [(at, (v >> at) & ((1 << LIMB_BITS) - 1)) for at in range(0, 60, LIMB_BITS)]
    return [(at, x.astype(np.float64)) for at, x in [*cut, (60, v >> 60)] if x.any()]


class Scatter:
    """Exact sums and cross-products of integer rows."""

    def __init__(self, size: int):
        self.n, self.sums, self.products = 0, np.zeros(size, object), np.zeros((size, size), object)
        self.open: dict[tuple[int, int], np.ndarray] = {}
        self.blocks = 0

    def add(self, v: np.ndarray) -> None:
        for i in range(0, len(v), BLOCK_ROWS):
            block = v[i : i + BLOCK_ROWS]
            self.n += len(block)
            parts = limbs(block)
            for k, (at, x) in enumerate(parts):
                self.sums += x.sum(0).astype(np.int64).astype(object) << at
                for to, y in parts[k:]:
                    product = (x.T @ y).astype(np.int64)
                    self.open[at, to] = self.open[at, to] + product if (at, to) in self.open else product
            self.blocks += 1
            if self.blocks % 1000 == 0:  # so many sums under 2**53 fit into 64 bits
                self.close()

    def close(self) -> None:
        for (at, to), x in self.open.items():
            x = x.astype(object) << (at + to)
            self.products += x if at == to else x + x.T
        self.open.clear()

    def entries(self) -> Iterator[tuple[int, int, int]]:
        """(i, j, value): sums have j = -1, the number of rows has both -1."""
        self.close()
        yield -1, -1, self.n
        for i, s in enumerate(self.sums):
            yield i, -1, s
            for j in range(i, len(self.sums)):
                yield i, j, self.products[i, j]


def words_of(value: int) -> list[int]:
    return [*((value >> (WIDE * k)) & ((1 << WIDE) - 1) for k in range(WORDS - 1)), value >> (WIDE * (WORDS - 1))]


def _scatter(size: int):
    names = ["i", "j", *(f"w{k}" for k in range(WORDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Scatter(size)
        for batch in batches:
            total.add(integers(batch.column("vector"), size))
        if total.n:
            rows = [(i, j, *words_of(int(value))) for i, j, value in total.entries()]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[at : at + 10_000], strict=True)], names)

    return run


def exact_scatter(vectors: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, n * XᵀX - SSᵀ) of the column `vector` (arrays of `size` doubles) as integers of any length."""
    names = [f"w{k}" for k in range(WORDS)]
    parts = vectors.select("vector").mapInArrow(_scatter(size), f"i long, j long, {', '.join(f'{x} long' for x in names)}")
    found = {(r.i, r.j): sum(r[x] << (WIDE * k) for k, x in enumerate(names)) for r in parts.groupBy("i", "j").agg(*(F.sum(x).alias(x) for x in names)).collect()}
    n, sums = found.get((-1, -1), 0), [found.get((i, -1), 0) for i in range(size)]
    return n, sums, [[n * found.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(size)] for i in range(size)]


def decomposed(n: int, sums: list[int], scatter: list[list[int]], components: int) -> Fit:
    """Eigenvectors of scatter / n², by falling eigenvalue; those of zero eigenvalues are left out."""
    v = np.array([[x / (n * n) for x in row] for row in scatter], np.float64)  # integer division rounds once
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = sum(scatter[i][i] for i in range(len(sums))) / (n * n)
    keep = np.flatnonzero(values > trace * len(sums) * np.finfo(np.float64).eps)[:components]
    return Fit(n, sums, np.ascontiguousarray(vectors[:, keep]), values[keep], trace)


def centred(v: np.ndarray, fit: Fit) -> tuple[np.ndarray, list[int | None]]:
    """(x - S/n as doubles, sum of (n*x - S)² of each row); shifts cancel."""
    far = max([fit.n * max(abs(int(v.min())), abs(int(v.max()))) + max(map(abs, fit.sums)), 1]) if v.size else 1
    if far * far * max(1, v.shape[1]) < 1 << 63:
        apart = v * fit.n - np.array(fit.sums, np.int64)
        return apart / fit.n, (apart * apart).sum(1).tolist()
    apart = v.astype(object) * fit.n - np.array(fit.sums, object)
    squares = [int(x) for x in (apart * apart).sum(1)]
    return np.array([[x / fit.n for x in row] for row in apart], np.float64).reshape(v.shape), [x if x < 1 << 63 else None for x in squares]


def _products(fit: Fit):
    """Sums of products of whitened values, for the identity check."""
    w, size = fit.vectors / np.sqrt(fit.values), len(fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = w.shape[1]
        total = np.zeros((k + 1, k))
        for batch in batches:
            y = centred(integers(batch.column("vector"), size), fit)[0] @ w
            total[:k] += y.T @ y
            total[k] += y.sum(0)
        i, j = np.divmod(np.arange((k + 1) * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "total"])

    return run


def identity_error(vectors: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance (divisor n) minus the identity."""
    k = len(fit.values)
    total = np.zeros((k + 1, k))
    for r in vectors.select("vector").mapInArrow(_products(fit), "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        total[r.i, r.j] = r.total
    mean = total[k] / fit.n
    return float(np.abs(total[:k] / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def _whitened(fit: Fit, error: float):
    w, size = fit.vectors / np.sqrt(fit.values), len(fit.sums)
    share = fit.values / fit.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = w.shape[1]
        for whole in batches:
            for at in range(0, len(whole), 1000):  # each row becomes k rows
                batch = whole.slice(at, 1000)
                x, deviation = centred(integers(batch.column("vector"), size), fit)
                row = np.repeat(np.arange(len(batch)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))), pa.array(np.full(len(row), fit.n)),
                        pa.array(deviation, pa.int64()).take(pa.array(row)), pa.array((x @ w).ravel()), pa.array(np.tile(share, len(batch))), pa.array(np.full(len(row), error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of the table (vec_id, embedding)."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    clean = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & clean)
    common = vectors.groupBy(F.size("vector").alias("entries")).count().orderBy(F.desc("count"), F.desc("entries")).first()
    size = common.entries if common else 0
    fit = None
    if size:
        vectors = vectors.where(F.size("vector") == size)
        fit = decomposed(*exact_scatter(vectors, size), components)
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fit is None or not len(fit.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    return vectors.mapInArrow(_whitened(fit, identity_error(vectors, fit)), schema)


#: What SQL can say of the operator: n and each row's exact deviation.
BASE_ORACLE = """
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT + 1000000) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
entries AS (SELECT row_number() OVER () AS row, vec_id, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS i FROM fit),
sums AS (SELECT i, count(*)::HUGEINT AS n, sum(x)::HUGEINT AS s FROM entries GROUP BY i)
SELECT any_value(vec_id) AS vec_id, any_value(n)::BIGINT AS n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation
FROM entries JOIN sums USING (i) GROUP BY row
"""
