"""Lexical index and batch BM25 scoring.

The index is a postings table with term frequency, document length, document frequency and a title
flag side by side, so that a batch of queries needs one join and one aggregation. Postings shuffle
once for their counts; at query time the distinct query terms are joined to them (Spark broadcasts
that side when its measured size is small) and top-k is a ranked window with a group limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize

K1, B, TITLE_WEIGHT = 1.2, 0.75, 1.25


#: Distinct terms up to which an index is built for a stated batch of queries only.
FEW_TERMS = 5000


def few_terms(queries: DataFrame, tokens=tokenize) -> list[str] | None:
    """The distinct terms of a batch of queries (query_id, question), or None if there are more than FEW_TERMS."""
    found = [r.term for r in query_terms(queries, tokens).select("term").distinct().limit(FEW_TERMS + 1).collect()]
    return found if len(found) <= FEW_TERMS else None


def build(docs: DataFrame, key: str = "doc_id", text: Column | None = None, title: Column | None = None, tokens=tokenize, terms: list[str] | None = None) -> DataFrame:
    """Postings (term, key, tf, dl, df, n_docs, avgdl, in_title) of docs; key is unique.

    terms: postings of these only. Other words then never leave their row; lengths and counts of documents are those of whole texts.
    """
    text = F.col("text") if text is None else text
    title = F.lit("") if title is None else title
    words = docs.select(key, tokens(F.concat_ws(" ", title, text)).alias("w"), F.array_distinct(tokens(title)).alias("tw"))
    wanted = F.col("w") if terms is None else F.filter("w", lambda t: t.isin(*terms)) if terms else F.slice("w", 1, 0)
    sized = words.select(key, F.size("w").cast("long").alias("dl"), "tw", wanted.alias("w")).select(key, F.explode("w").alias("term"), "dl", "tw")
    tf = sized.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"), F.first(F.array_contains("tw", F.col("term"))).alias("in_title"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = words.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("w")).alias("avg")).select("n_docs", F.when(F.col("avg") > 0, F.col("avg")).otherwise(1.0).alias("avgdl"))
    return tf.join(df, "term").crossJoin(stats)  # stats has one row


def term_score(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def query_terms(queries: DataFrame, tokens=tokenize) -> DataFrame:
    """(query_id, term) without repeats from (query_id, question)."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))


def contributions(postings: DataFrame, terms: DataFrame, key: str = "doc_id", title_weight: Column | float = TITLE_WEIGHT) -> DataFrame:
    boost = F.when(F.col("in_title"), title_weight).otherwise(F.lit(1.0))
    c = term_score(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avgdl")) * boost
    return postings.join(terms, "term").select("query_id", key, "term", "in_title", c.alias("part"))


def ranked(scored: DataFrame, k: int, key: str = "doc_id", *more: str) -> DataFrame:
    """Top k of each query by unrounded score, then by id as text; sums are fixed to 9 digits before they are compared."""
    if k < 1:
        raise ValueError("top_k must be at least 1")
    order = Window.partitionBy("query_id", *more).orderBy(F.col("raw").desc(), F.col(key).cast("string"))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).withColumn("score", F.round("raw", 5)).drop("raw")


def search(postings: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", title_weight: float = TITLE_WEIGHT, tokens=tokenize) -> DataFrame:
    """(query_id, key, rank, score): documents without any query term are not returned."""
    parts = contributions(postings, query_terms(queries, tokens), key, title_weight)
    return ranked(parts.groupBy("query_id", key).agg(F.round(F.sum("part"), 9).alias("raw")), k, key)


def matched_terms(postings: DataFrame, queries: DataFrame, hits: DataFrame, key: str = "doc_id", tokens=tokenize) -> DataFrame:
    """hits with matched_terms in order; only the hits' postings are looked up."""
    terms = postings.select(key, "term").join(hits.select("query_id", key), key).join(query_terms(queries, tokens), ["query_id", "term"])
    return hits.join(terms.groupBy("query_id", key).agg(F.array_sort(F.collect_set("term")).alias("matched_terms")), ["query_id", key])


def late_title_search(postings: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", bonus: float = 0.25) -> DataFrame:
    """Two stages: body scores keep max(10 k, 1000) candidates, then title terms add their share and the rest is ranked anew."""
    terms = query_terms(queries)
    body = contributions(postings, terms, key, 1.0)
    pool = ranked(body.groupBy("query_id", key).agg(F.round(F.sum("part"), 9).alias("raw")).withColumn("body", F.col("raw")), max(10 * k, 1000), key).select("query_id", key, "body")
    extra = contributions(postings.where("in_title"), terms, key, 1.0).groupBy("query_id", key).agg((bonus * F.sum("part")).alias("more"))
    both = pool.join(extra, ["query_id", key], "left").select("query_id", key, F.round(F.col("body") + F.coalesce("more", F.lit(0.0)), 9).alias("raw"))
    return ranked(both, k, key)


def section_search(docs: DataFrame, queries: DataFrame, k: int = 10, tokens=tokenize) -> DataFrame:
    """Index-free variant: the whole score is raised by a quarter for each query word in the section name; ties keep document order.

    docs: doc_id, section, text. Scores are compared after rounding to 4 digits.
    """
    return section_ranked(build(docs, tokens=tokens, terms=few_terms(queries, tokens)), docs.select("doc_id", "section"), queries, k, "doc_id", tokens)


def section_ranked(postings: DataFrame, sections: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", tokens=tokenize) -> DataFrame:
    """(query_id, key, score, rank) from postings at hand; sections: key, section."""
    raw = contributions(postings, query_terms(queries, tokens), key, 1.0).groupBy("query_id", key).agg(F.round(F.sum("part"), 9).alias("raw"))
    wanted = queries.select("query_id", F.array_distinct(tokens(F.col("question"))).alias("q"))
    named = sections.select(key, F.array_distinct(tokens(F.col("section"))).alias("s"))
    boosted = raw.join(wanted, "query_id").join(named, key).select("query_id", key, F.round(F.col("raw") * (1 + 0.25 * F.size(F.array_intersect("q", "s"))), 4).alias("score")).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return boosted.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
