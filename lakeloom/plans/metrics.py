"""Ranking metrics: one implementation, k a parameter, slices as grouping sets.

NULL is "not measured", 0 is a measured zero; avg() skips NULLs, which gives macro means over eligible queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (5, 10, 20)


def parent_ranking(hits: DataFrame, key: str = "doc_id", *more: str) -> DataFrame:
    """First occurrence of each key by rank, ranked anew."""
    first = hits.groupBy("query_id", *more, key).agg(F.min("rank").alias("at"))
    order = Window.partitionBy("query_id", *more).orderBy("at", F.col(key).cast("string"))
    return first.withColumn("rank", F.row_number().over(order).cast("long")).drop("at")


def query_metrics(queries: DataFrame, qrels: DataFrame, ranking: DataFrame, key: str = "doc_id", cutoffs: tuple = CUTOFFS, k: int = 10, more: tuple = (), grid: list[tuple] | None = None) -> DataFrame:
    """Per query (and columns of more, from ranking): n_gold, recall@c, mrr, ndcg, hit; NULL without gold.

    qrels: distinct (query_id, key). A query that retrieved nothing scores zeros. grid: the values of more, if they are known; else they are
    read from ranking.
    """
    gold = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = ranking.join(qrels, ["query_id", key], "left_semi")
    r = F.col("rank")
    found = hits.groupBy("query_id", *more).agg(
        *(F.count_if(r <= c).alias(f"found_{c}") for c in cutoffs),
        F.min(F.when(r <= k, r)).alias("first"),
        F.array_sort(F.collect_list(F.when(r <= k, r))).alias("places"),
    )
    base = queries.join(gold, "query_id", "left")
    if more and grid is not None:
        every = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(more, row, strict=True))) for row in grid))
        base = base.withColumn("_grid", F.explode(every)).select("*", "_grid.*").drop("_grid")
    elif more:
        base = base.crossJoin(ranking.select(*more).distinct())  # every configuration has every query
    joined = base.join(found, ["query_id", *more], "left")
    gain = F.aggregate(F.coalesce("places", F.array().cast("array<bigint>")), F.lit(0.0), lambda s, x: s + 1.0 / F.log2(x + 1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, x: s + 1.0 / F.log2(x + 1.0))
    has = F.col("n_gold").isNotNull()
    out = {f"recall_{c}": F.when(has, F.coalesce(f"found_{c}", F.lit(0)) / F.col("n_gold")) for c in cutoffs}
    out |= {"mrr": F.when(has, F.coalesce(1.0 / F.col("first"), F.lit(0.0))), "ndcg": F.when(has, gain / ideal)}
    return joined.withColumns(out).drop("first", "places", *(f"found_{c}" for c in cutoffs))


def summarize(per_query: DataFrame, sets: list[str], measures: list[str], digits: int = 6) -> DataFrame:
    """Macro means overall and by each column of sets: one aggregation over grouping sets; slice names the set, value its value."""
    spread = per_query.select(F.explode(F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *(F.struct(F.lit(c).alias("slice"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in sets))).alias("g"), *measures)
    return spread.groupBy("g.slice", "g.value").agg(F.count(F.lit(1)).alias("n"), F.count(measures[0]).alias("eligible"), *(F.round(F.avg(m), digits).alias(m) for m in measures))


def deltas(summary: DataFrame, baseline: Column, keys: list[str], measures: list[str], digits: int = 6) -> DataFrame:
    """Each row's measures less those of the baseline row with the same keys; rows without one go."""
    same = Window.partitionBy(*keys)
    base = {m: F.max(F.when(baseline, F.col(m))).over(same) for m in measures}
    has = F.max(baseline.cast("int")).over(same) == 1
    marked = summary.select("*", has.alias("_has"), *(F.round(F.col(m) - base[m], digits).alias(f"delta_{m}") for m in measures))
    return marked.where("_has").drop("_has")


def complete_only(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """Queries all of whose gold is in the corpus."""
    state = qrels.join(corpus.select(key).distinct().withColumn("here", F.lit(True)), key, "left").groupBy("query_id").agg(F.bool_and(F.coalesce("here", F.lit(False))).alias("complete"))
    return queries.join(state.where("complete"), "query_id", "left_semi")


def textless_ceiling(qrels: DataFrame, textless: DataFrame, key: str = "doc_id") -> DataFrame:
    """The best reachable recall: mean of one less the share of gold without text."""
    per = qrels.join(textless.select(key, F.lit(1).alias("bare")), key, "left").groupBy("query_id").agg((1 - F.count("bare") / F.count(F.lit(1))).alias("reach"))
    return per.agg(F.round(F.avg("reach"), 6).alias("ceiling"))


def stable_sample(queries: DataFrame, n: int, key: str = "query_id") -> DataFrame:
    """The n rows with the smallest SHA-256 of their id."""
    return queries.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(n)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows each side has that the other lacks (an independent check passes with zeros)."""
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_right")))


def e2e_scores(rows: DataFrame) -> DataFrame:
    """End-to-end question rows -> status and per-row metrics.

    rows: query_id, state, answerability, gold array, in_corpus boolean, ranked array, refused boolean, n_claims, n_supported, n_citations, n_valid.
    """
    status = (
        F.when(F.col("state") == "failed", "retrieval_failed")
        .when(F.col("gold").isNull() | (F.size("gold") == 0), "no_qrels")
        .when(~F.col("in_corpus"), "incomplete_gold_out_of_scope")
        .otherwise("scored")
    )
    recall = F.when(status == "scored", F.size(F.array_intersect("gold", "ranked")) / F.size("gold"))
    refusal = F.when((F.col("state") != "failed") & F.col("answerability").isin("answerable", "unanswerable"), (F.col("refused") == (F.col("answerability") == "unanswerable")).cast("double"))
    return rows.select(
        "query_id", status.alias("status"), recall.alias("recall"), refusal.alias("refusal_ok"),
        F.try_divide(F.col("n_valid"), F.col("n_citations")).alias("citation_validity"), F.try_divide(F.col("n_supported"), F.col("n_claims")).alias("supported_claim_rate"),
        F.when(F.col("query_id").cast("string").endswith("_zh"), "translated").otherwise("original").alias("language"),
    )
