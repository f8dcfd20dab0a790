"""Rank fusion, reranking and parent aggregation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def _share(rank: Column, k: Column | int) -> Column:
    return F.coalesce(1.0 / (F.lit(k) + rank if isinstance(k, int) else k + rank), F.lit(0.0))


def fuse(sparse: DataFrame, dense: DataFrame, k: int = 10, rrf_k: int = RRF_K, key: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of two channels (query_id, key, rank): bm25_rank, dense_rank, rrf_rank, score."""
    a = sparse.select("query_id", key, F.col("rank").alias("bm25_rank"))
    b = dense.select("query_id", key, F.col("rank").alias("dense_rank"))
    both = a.join(b, ["query_id", key], "full").withColumn("raw", _share(F.col("bm25_rank"), rrf_k) + _share(F.col("dense_rank"), rrf_k))
    order = Window.partitionBy("query_id").orderBy(F.col("raw").desc(), F.col(key).cast("string"))
    return both.withColumn("rrf_rank", F.row_number().over(order).cast("long")).where(F.col("rrf_rank") <= k).withColumn("score", F.round("raw", 8)).drop("raw")


def fuse_queries(hits: DataFrame, k: int = 10, rrf_k: int = RRF_K, key: str = "doc_id") -> DataFrame:
    """Fusion over several phrasings: hits (query_id, variant, key, rank) -> score, rank and the variants that found each."""
    one = F.struct("variant", "rank")
    grouped = hits.groupBy("query_id", key).agg(F.array_sort(F.collect_list(one)).alias("matched_queries"))
    raw = F.aggregate("matched_queries", F.lit(0.0), lambda s, x: s + _share(x["rank"], rrf_k))
    order = Window.partitionBy("query_id").orderBy(F.col("raw").desc(), F.col(key).cast("string"))
    return grouped.withColumn("raw", raw).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).withColumn("score", F.round("raw", 8)).drop("raw")


def channel(hits: DataFrame, candidate_k: int, key: str = "doc_id") -> DataFrame:
    """The first candidate_k of a channel, then each key once, ranked anew."""
    first = hits.where(F.col("rank") <= candidate_k).groupBy("query_id", key).agg(F.min("rank").alias("at"))
    return first.select("query_id", key, F.row_number().over(Window.partitionBy("query_id").orderBy("at")).cast("long").alias("rank"))


def one_parent_each(hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The hits, after one aggregation found no chunk with two parents."""
    torn = hits.groupBy(key).agg(F.countDistinct("parent_id").alias("n")).where("n > 1")
    if not torn.isEmpty():
        raise ValueError(f"{torn.count()} chunks have several parents")
    return hits


def rerank(hits: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None, limit: int, score: Column | None = None, key: str = "doc_id") -> DataFrame:
    """The first `limit` hits of a query by an injected cross encoder's score, the rest after them as they were.

    hits: query_id, key, rank, question, passage. scorer gets Series of questions and passages; score is a Column instead.
    """
    if scorer is not None:
        score = F.pandas_udf(scorer, "double")("question", "passage")
    scored = hits.where(F.col("rank") <= limit).withColumn("rerank_score", score.cast("double"))
    rest = hits.where(F.col("rank") > limit).withColumn("rerank_score", F.lit(None).cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.col("rank") > limit, F.col("rerank_score").desc_nulls_last(), "rank", F.col(key).cast("string"))
    return scored.unionByName(rest).withColumn("new_rank", F.row_number().over(order).cast("long"))


def parents(hits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Chunk hits (query_id, chunk_id, parent_id, rank, score) to parents in order of their best chunk; unknown parents go."""
    one = F.struct("rank", "chunk_id")
    grouped = hits.groupBy("query_id", "parent_id").agg(
        F.min("rank").alias("best_chunk_rank"), F.min_by("score", "rank").alias("retrieval_score"), F.array_sort(F.collect_list(one)).alias("matched_chunks")
    )
    if known is not None:
        grouped = grouped.join(known, "parent_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("best_chunk_rank")
    return grouped.withColumn("parent_rank", F.row_number().over(order).cast("long"))


def orphans(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Hits whose parent is unknown, by query."""
    return hits.join(known, "parent_id", "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("orphans"))
