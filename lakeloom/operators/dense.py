"""Exact dense retrieval for batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bm25 import ranked


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """Unit length; null for zero or non-finite vectors."""
    norm = F.sqrt(inner_product(v, v))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(v, lambda x: (x / norm).cast("float")))


#: Texts that a model gets at once: 1 to MOST_BATCH. Pairs of a block that are scored together.
BATCH, MOST_BATCH, BLOCK_PAIRS = 16, 64, 1 << 22
#: Bytes of query vectors up to which they go to the tasks as one broadcast; larger sets go in blocks.
QUERY_BYTES = 64 << 20

_models: dict = {}


def loaded(make: Callable[[], Callable], key: str) -> Callable[[list[str]], np.ndarray]:
    """A model that each Python worker makes once, at its first batch, and keeps: make() loads it, without a network if its files are there."""

    def model(texts: list[str]) -> np.ndarray:
        if key not in _models:
            _models[key] = make()
        return _models[key](texts)

    return model


def paper_text() -> Column:
    """What stands for a paper in a dense index: title and abstract on two lines."""
    return F.trim(F.concat_ws("\n", "title", "abstract"))


def embed(docs: DataFrame, embedder: Callable[[list[str]], np.ndarray], text: str = "text", batch: int = BATCH) -> DataFrame:
    """docs with an embedding column from an injected model; zero and non-finite vectors are errors."""
    if not 1 <= batch <= MOST_BATCH:
        raise ValueError(f"batch is 1 to {MOST_BATCH}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [np.asarray(embedder(pdf[text].iloc[i : i + batch].tolist()), np.float32) for i in range(0, len(pdf), batch)]
            v = np.concatenate(got) if got else np.zeros((0, 1), np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            if not np.isfinite(v).all() or (norm == 0).any():
                raise ValueError("the model gave a zero or non-finite vector")
            yield pdf.assign(embedding=list(v / norm))

    return docs.mapInPandas(run, T.StructType([*docs.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    if not n:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if column.null_count or len(flat) % n or (np.diff(column.offsets.to_numpy()) != len(flat) // n).any():
        raise ValueError("vectors are missing or of several dimensions")
    return flat.reshape(n, -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """(query_id, key, rank, score) by inner product of unit vectors; ties by id as text before the cut.

    queries: (query_id, vector), a stated set that meets every vector. They go to the tasks in blocks of a checked
    size; each batch of vectors is multiplied with a block, and only the k best of each query and task leave it.
    Products are fixed to 9 digits before they are compared.
    """
    from .batch import Best

    if k < 1:
        raise ValueError("top_k must be at least 1")
    spark, asked = vectors.sparkSession, queries.select("query_id", "vector").where("vector is not null")
    kinds = {c: f.schema[c].dataType.simpleString() for f, c in ((queries, "query_id"), (vectors, key))}
    size = asked.agg(F.coalesce(F.sum(8 * F.size("vector") + 16), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // QUERY_BYTES))
    found = None
    for b in range(n_blocks):
        block = (asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)).toArrow().combine_chunks()
        ids = block.column("query_id").combine_chunks() if len(block) else pa.array([], block.schema.field("query_id").type)
        q = _matrix(block.column("vector").combine_chunks(), len(block)) if len(block) else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = Best(len(q), k, True, 9, -np.inf)
            for batch in batches:
                v = _matrix(batch.column("embedding"), len(batch))
                step = max(1, BLOCK_PAIRS // max(1, len(batch)))
                for i in range(0, len(q) if len(batch) else 0, step):
                    some = np.arange(i, min(i + step, len(q)))
                    best.add(q[some] @ v.T, batch.column(key), who=some)
            rows = best.cut()
            for r in rows.to_batches(max_chunksize=1 << 16) if rows is not None else ():
                yield pa.RecordBatch.from_arrays([ids.take(r.column("q")), r.column("key"), r.column("raw")], ["query_id", key, "raw"])

        part = vectors.select(key, "embedding").mapInArrow(run, f"query_id {kinds['query_id']}, {key} {kinds[key]}, raw double")
        found = part if found is None else found.unionByName(part)
    return ranked(found, k, key)
