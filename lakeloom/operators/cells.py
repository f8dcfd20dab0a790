"""Exact best inner products with pruning: vectors lie in cells around centres, and whole cells are left out by their bounds.

A cell with centre c, radius r (greatest |v - c|) and greatest norm V bounds every product with q in two ways: qv = qc + q(v - c) is at
most qc + |q| r, and by the triangle inequality |q - v| is at least |q - c| - r, so qv is at most (|q|² + V² - (|q - c| - r)²) / 2. A batch
of queries first meets the cells of greatest bounds that together hold k vectors; after that only cells whose bound reaches the k-th
product found are met. Nothing is approximate: the result is that of dense.search().

Centres are a bounded sample of the vectors; which vectors are sampled changes only how much is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batch import Best
from .bm25 import ranked
from .dense import QUERY_BYTES, _matrix

#: Centres that are sampled at most, and slack of bounds: products are rounded to 9 digits.
MOST_CENTRES, SLACK = 256, 1e-6
#: Queries of one block: their products with the centres are in the driver's memory.
BLOCK_QUERIES = 20_000


def _distances(a: np.ndarray, b: np.ndarray, products: np.ndarray) -> np.ndarray:
    """|a - b| of all pairs from their products."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * products, 0))


def centres_of(vectors: DataFrame, key: str = "doc_id", most: int = MOST_CENTRES) -> np.ndarray:
    """Up to `most` vectors, those of least key hash: the same ones whatever the partitions."""
    rows = vectors.orderBy(F.xxhash64(key), key).limit(most).select("embedding").collect()
    return np.unique(np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1), axis=0)


def assigned(vectors: DataFrame, centres: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, embedding, cell, distance, norm): each vector with its nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column("embedding"), len(batch))
            far = _distances(v, centres, v @ centres.T)
            cell = far.argmin(1)
            rest = pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(v)), cell]), pa.array(np.sqrt((v * v).sum(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *rest], [key, "embedding", "cell", "distance", "norm"])

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (key, "embedding")}
    return vectors.select(key, "embedding").mapInArrow(run, f"{key} {kinds[key]}, embedding {kinds['embedding']}, cell int, distance double, norm double")


class Cells:
    """Vectors in cells: rows is a table that assigned() made, written or cached by the caller."""

    def __init__(self, rows: DataFrame, centres: np.ndarray, key: str = "doc_id"):
        self.rows, self.centres, self.key = rows, centres, key
        found = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"), F.max("norm").alias("norm")).collect()
        self.size, self.radius, self.norm = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(len(centres))
        for r in found:
            self.size[r.cell], self.radius[r.cell], self.norm[r.cell] = r.n, r.radius, r.norm

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that a product of each query with a vector of each cell can be."""
        products = q @ self.centres.T
        squares = (q * q).sum(1)[:, None]
        apart = np.maximum(_distances(q, self.centres, products) - self.radius, 0)
        return np.minimum(products + np.sqrt(squares) * self.radius, (squares + self.norm**2 - apart**2) / 2)

    def _products(self, ids: pa.Array, q: np.ndarray, wanted: np.ndarray, k: int, kind: str) -> DataFrame:
        """The k best products of each query with a task's vectors of the cells that it wants; `wanted` is queries by cells."""
        spark, key = self.rows.sparkSession, self.key
        shared, counted = spark.sparkContext.broadcast((ids, q, np.packbits(wanted, axis=0))), self.multiplied

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, packed = shared.value
            best = Best(len(q), k, True, 9, -np.inf)
            for batch in batches:
                cell = batch.column("cell").to_numpy(zero_copy_only=False)
                v = _matrix(batch.column("embedding"), len(batch)) if len(batch) else np.zeros((0, q.shape[1]))
                for c in np.unique(cell):
                    who = np.flatnonzero(np.unpackbits(packed[:, c], count=len(q)))
                    at = np.flatnonzero(cell == c)
                    for i in range(0, len(who), step := max(1, (1 << 22) // max(1, len(at)))):
                        some = who[i : i + step]
                        counted.add(len(some) * len(at))
                        best.add(q[some] @ v[at].T, batch.column(key).take(pa.array(at)), who=some)
            rows = best.cut()
            for r in rows.to_batches(max_chunksize=1 << 16) if rows is not None else ():
                yield pa.RecordBatch.from_arrays([ids.take(r.column("q")), r.column("key"), r.column("raw")], ["query_id", key, "raw"])

        cells = [int(c) for c in np.flatnonzero(wanted.any(0))]
        key_kind = self.rows.schema[key].dataType.simpleString()
        return self.rows.where(F.col("cell").isin(cells)).select(key, "embedding", "cell").mapInArrow(run, f"query_id {kind}, {key} {key_kind}, raw double")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, key, rank, score), as dense.search() gives them. queries: (query_id, vector), a stated set, met in blocks of a checked size.

        self.multiplied counts the products of queries and vectors that were made, once the result was computed.
        """
        if k < 1:
            raise ValueError("top_k must be at least 1")
        spark = self.rows.sparkSession
        self.multiplied = spark.sparkContext.accumulator(0)
        asked, kind = queries.select("query_id", "vector").where("vector is not null"), queries.schema["query_id"].dataType.simpleString()
        n = asked.count()
        blocks = max(1, -(-n // BLOCK_QUERIES), -(-8 * n * self.centres.shape[1] // QUERY_BYTES))
        found = None
        for b in range(blocks):
            block = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow().combine_chunks()
            if not len(block):
                continue
            ids, q = block.column("query_id").combine_chunks(), _matrix(block.column("vector").combine_chunks(), len(block))
            most = np.where(self.size > 0, self.bounds(q), -np.inf)
            order = np.argsort(-most, axis=1)
            before = np.cumsum(self.size[order], axis=1) - self.size[order]
            first = np.zeros(most.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)  # the cells of greatest bounds that hold k vectors together
            near = self._products(ids, q, first, k, kind)
            near.write.parquet(path := _scratch(spark))
            near = spark.read.schema(near.schema).parquet(path)
            place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw")))
            worst = {r.query_id: r.raw for r in near.select("query_id", "raw", place.alias("place")).where(F.col("place") == k).collect()}
            least = np.array([worst.get(x, -np.inf) for x in ids.to_pylist()])
            rest = ~first & (most >= least[:, None] - SLACK) & (self.size > 0)
            both = near.unionByName(self._products(ids, q, rest, k, kind)) if rest.any() else near
            found = both if found is None else found.unionByName(both)
        if found is None:
            return spark.createDataFrame([], f"query_id {kind}, {self.key} {self.rows.schema[self.key].dataType.simpleString()}, rank long, score double")
        return ranked(found, k, self.key).select("query_id", self.key, "rank", "score")


def _scratch(spark) -> str:
    from ..plans.artifacts import scratch

    return scratch(spark)
