"""Evaluation runs over written rankings: pilot, mode comparison, sweeps, reranking, consistency, end-to-end systems, latency."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import batch, bm25, fusion
from . import metrics
from .runtime import BudgetExceeded, Run

MEASURES = ["recall_5", "recall_10", "recall_20", "mrr", "ndcg"]
# The grid of the fusion sweep and its baseline.
CANDIDATE_KS, RRF_KS, BASELINE = (20, 50, 100), (20, 40, 60, 100), (100, 60)


def parent_hits(hits: DataFrame, parents: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Chunk hits (query_id, chunk_id, parent_id, rank) -> rankings of known parents, and orphan hits a query."""
    known = parents.select("parent_id").distinct().withColumn("known", F.lit(True))
    marked = hits.join(known, "parent_id", "left")
    orphans = marked.groupBy("query_id", *more).agg(F.count_if(F.col("known").isNull()).alias("orphans"))
    return metrics.parent_ranking(marked.where("known"), "parent_id", *more), orphans


def retrieval_eval(queries: DataFrame, qrels: DataFrame, hits: DataFrame, parents: DataFrame, more: tuple = (), top_k: int = 5, grid: list[tuple] | None = None) -> DataFrame:
    """Per query: ranking metrics of its parents, how many were recovered, gold in the child pool, orphans. Gold outside the corpus doesn't count."""
    inside = qrels.join(parents.select("parent_id").distinct(), "parent_id", "left_semi").distinct()
    ranking, orphans = parent_hits(hits, parents, *more)
    scored = metrics.query_metrics(queries, inside, ranking, "parent_id", more=more, grid=grid)
    keys = ["query_id", *more]
    recovered = ranking.groupBy(*keys).agg(F.count(F.lit(1)).alias("recovered"))
    found = hits.select(*keys, "parent_id").distinct().join(inside, ["query_id", "parent_id"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("in_pool"))
    joined = scored.join(recovered, keys, "left").join(found, keys, "left").join(orphans, keys, "left").fillna(0, ["recovered", "in_pool", "orphans"])
    return joined.withColumns({"pool_coverage": F.try_divide("in_pool", "n_gold"), "below_top_k": F.col("recovered") < top_k, "hit": F.when(F.col("n_gold").isNotNull(), (F.col("recall_10") > 0).cast("double"))}).drop("in_pool")


def summary(per_query: DataFrame, slices: list[str], more: tuple = ()) -> DataFrame:
    """Means overall and by slice (and by configuration), with hits, pool coverage, recovered parents, queries below top k and orphans."""
    sets = F.explode(F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *(F.struct(F.lit(c).alias("slice"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in slices)))
    spread = per_query.withColumn("g", sets)
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return spread.groupBy(*more, "g.slice", "g.value").agg(
        F.count(F.lit(1)).alias("n"), F.count("n_gold").alias("eligible"), *map(mean, [*MEASURES, "hit", "pool_coverage"]),
        F.round(F.avg("recovered"), 6).alias("mean_recovered"), F.count_if("below_top_k").alias("below_top_k"), F.sum("orphans").alias("orphans"),
    )


def compare(queries: DataFrame, qrels: DataFrame, modes: Mapping[str, DataFrame], parents: DataFrame, slices: list[str]) -> DataFrame:
    """Summaries of several rankings (mode -> chunk hits) of one set of questions, side by side."""
    every = None
    for name, hits in modes.items():
        rows = hits.select("query_id", "chunk_id", "parent_id", "rank").withColumn("mode", F.lit(name))
        every = rows if every is None else every.unionByName(rows)
    return summary(retrieval_eval(queries, qrels, every, parents, ("mode",), grid=[(name,) for name in modes]), slices, ("mode",))


def fusion_sweep(sparse: DataFrame, near: DataFrame, k: int = 10, key: str = "chunk_id", candidate_ks: Iterable[int] = CANDIDATE_KS, rrf_ks: Iterable[int] = RRF_KS) -> DataFrame:
    """(candidate_k, rrf_k, query_id, key, rank, score) of every configuration: one pass, configurations are rows.

    Ranks of a channel differ, so a key that only one channel has (up to candidate_k), behind its k-th place, has k keys before it and is left out
    before the rows are multiplied, unless a channel of the query has a key twice. Rows of a query meet once: they are grouped and ranked where they are.
    """
    grid = F.array(*(F.struct(F.lit(c).alias("candidate_k"), F.lit(r).alias("rrf_k")) for c in candidate_ks for r in rrf_ks))
    both = sparse.select("query_id", key, "rank", F.lit(0).alias("channel")).unionByName(near.select("query_id", key, "rank", F.lit(1).alias("channel")))
    keys = both.repartition("query_id").groupBy("query_id", key).agg(F.array_sort(F.collect_list("rank")).alias("ranks"), F.size(F.collect_set("channel")).alias("channels"))
    twice = F.max(F.size("ranks") > F.col("channels")).over(Window.partitionBy("query_id"))
    each = keys.withColumn("twice", twice).withColumn("g", F.explode(grid)).withColumn("ranks", F.filter("ranks", lambda r: r <= F.col("g.candidate_k")))
    each = each.where((F.size("ranks") > 0) & ((F.size("ranks") > 1) | (F.col("ranks")[0] <= k) | F.col("twice")))
    raw = F.aggregate("ranks", F.lit(0.0), lambda s, r: s + 1.0 / (F.col("g.rrf_k") + r))
    return bm25.ranked(each.select("g.candidate_k", "g.rrf_k", "query_id", key, F.round(raw, 12).alias("raw")), k, key, "candidate_k", "rrf_k")


def sweep_deltas(queries: DataFrame, qrels: DataFrame, swept: DataFrame, slices: list[str], key: str = "doc_id", candidate_ks: Iterable[int] = CANDIDATE_KS, rrf_ks: Iterable[int] = RRF_KS) -> DataFrame:
    """Metrics of every configuration of fusion_sweep(), overall and by slice, and their differences from the baseline's."""
    per = metrics.query_metrics(queries, qrels, swept, key, more=("candidate_k", "rrf_k"), grid=[(c, r) for c in candidate_ks for r in rrf_ks])
    sets = F.explode(F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *(F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in slices)))
    means = per.withColumn("g", sets).groupBy("candidate_k", "rrf_k", "g.slice", "g.value").agg(*(F.round(F.avg(m), 6).alias(m) for m in MEASURES))
    return metrics.deltas(means, (F.col("candidate_k") == BASELINE[0]) & (F.col("rrf_k") == BASELINE[1]), ["slice", "value"], MEASURES)


def title_deltas(queries: DataFrame, qrels: DataFrame, hits: DataFrame, weights: Iterable[float] = (1.0, 1.25, 1.5), baseline: float = bm25.TITLE_WEIGHT, key: str = "doc_id") -> DataFrame:
    """Mean metrics by title weight and their differences from the baseline's, from rankings at hand: hits (query_id, key, weight, rank)."""
    per = metrics.query_metrics(queries, qrels, hits, key, more=("weight",), grid=[(float(w),) for w in weights])
    means = per.groupBy("weight").agg(*(F.round(F.avg(m), 6).alias(m) for m in MEASURES)).withColumn("one", F.lit(1))
    return metrics.deltas(means, F.col("weight") == baseline, ["one"], MEASURES).drop("one")


def title_sweep(postings: DataFrame, queries: DataFrame, qrels: DataFrame, weights: Iterable[float] = (1.0, 1.25, 1.5), baseline: float = bm25.TITLE_WEIGHT, sample: int | None = None, k: int = 10, key: str = "doc_id") -> DataFrame:
    """title_deltas() over all queries or a stable sample of them; postings are scored in tasks, no row is made for each pair of query and document."""
    asked, weights = queries if sample is None else metrics.stable_sample(queries, sample), tuple(map(float, weights))
    hits = [batch.search_postings(postings, asked, k, key, w).withColumn("weight", F.lit(w)) for w in weights]
    return title_deltas(asked, qrels, reduce(DataFrame.unionByName, hits), weights, baseline, key)


def rerank_eval(queries: DataFrame, qrels: DataFrame, pool: DataFrame, scorer=None, score=None, limit: int = 20, key: str = "doc_id") -> DataFrame:
    """Per query: metrics before and after the first `limit` of a fused pool are reranked, their differences, and the pool's coverage of gold.

    pool: query_id, key, rank, question, passage. scorer or score as in fusion.rerank().
    """
    after = fusion.rerank(pool, scorer, limit, score, key).select("query_id", key, F.col("new_rank").alias("rank"))
    both = pool.select("query_id", key, F.col("rank").cast("long").alias("rank")).withColumn("stage", F.lit("before")).unionByName(after.withColumn("stage", F.lit("after")))
    per = metrics.query_metrics(queries.select("query_id"), qrels, both, key, more=("stage",), grid=[("before",), ("after",)])
    side = lambda name: per.where(F.col("stage") == name).select("query_id", "n_gold", *(F.col(m).alias(f"{m}_{name}") for m in MEASURES))
    covered = pool.join(qrels, ["query_id", key], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("in_pool"))
    joined = side("before").join(side("after").drop("n_gold"), "query_id").join(covered, "query_id", "left")
    joined = joined.withColumn("pool_coverage", F.when(F.col("n_gold").isNotNull(), F.coalesce("in_pool", F.lit(0)) / F.col("n_gold"))).drop("in_pool")
    return joined.withColumns({f"{m}_delta": F.col(f"{m}_after") - F.col(f"{m}_before") for m in MEASURES})


def smoke(fused: DataFrame, sparse: DataFrame, near: DataFrame, chunks: DataFrame, parents: DataFrame, key: str = "chunk_id", k: int = 200, rrf_k: int = fusion.RRF_K) -> DataFrame:
    """(check, ok, detail): a fused ranking against one computed anew by addition, and its rows against their sources."""
    again = sparse.select("query_id", key, "rank").unionByName(near.select("query_id", key, "rank")).groupBy("query_id", key).agg(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("raw"))
    order = Window.partitionBy("query_id").orderBy(F.round("raw", 12).desc(), F.col(key).cast("string"))
    again = again.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, F.round("raw", 6).alias("score"))
    got = fused.select("query_id", key, F.round("score", 6).alias("score"))
    other = metrics.same_rows(got, again).first()
    lost = fused.select(key).distinct().join(chunks, key, "left_anti").count()
    no_parent = fused.select(key).distinct().join(chunks.select(key, "parent_id"), key).join(parents, "parent_id", "left_anti").count()
    blank = fused.select(key).distinct().join(chunks, key).where(F.trim(F.coalesce("text", F.lit(""))) == "").count()
    rows = [("fusion is the sum of both channels", other.only_left + other.only_right), ("hits are chunks of the corpus", lost), ("chunks have parents", no_parent), ("chunks have text", blank)]
    return fused.sparkSession.createDataFrame([(name, not n, "" if not n else f"{n} rows") for name, n in rows], "check string, ok boolean, detail string")


System = tuple[Callable[[str], list], Callable[[str, list], dict]]


def end_to_end(spark: SparkSession, questions: list[dict], systems: Mapping[str, System], corpus: set | None = None, judge: Callable[[dict, dict, list], dict] | None = None, top_k: int = 5, run: Run | None = None) -> DataFrame:
    """Rows for metrics.e2e_scores(), one a system and question, from live (retriever, answerer) pairs; a stated set of questions.

    retriever gives ids of papers in order; answerer gives refused, citations (paper ids) and answer. judge gives claim_count and
    supported_claims. A failure is a row, not an end; a spent budget ends the run.
    """
    run, rows = run or Run(), []
    for system, (retrieve, answer) in systems.items():
        for q in questions:
            row = {"system": system, "query_id": str(q["id"]), "question": q["question"], "answerability": q.get("answerability", "unknown"), "category": q.get("category"), "gold": [str(x) for x in q.get("gold_paper_ids") or []] or None}
            row["in_corpus"] = row["gold"] is None or corpus is None or set(row["gold"]) <= corpus
            row |= {"state": "ok", "ranked": [], "refused": False, "n_claims": 0, "n_supported": 0, "n_citations": 0, "n_valid": 0, "answer": None, "seconds": None, "error": None}
            began = run.clock()
            try:
                with run.stage("question", system=system):
                    ids = [str(x) for x in retrieve(q["question"])]
                    said = answer(q["question"], ids)
                    cited = [str(x) for x in said.get("citations") or []]
                    row |= {"ranked": ids[:top_k], "refused": bool(said.get("refused")), "answer": said.get("answer"), "n_citations": len(cited), "n_valid": sum(c in ids for c in cited), "state": said.get("status", "ok")}
                    if judge is not None:
                        verdict = judge(q, said, ids)
                        row |= {"n_claims": int(verdict.get("claim_count", 0)), "n_supported": int(verdict.get("supported_claims", 0))}
                        if not 0 <= row["n_supported"] <= row["n_claims"]:
                            raise ValueError(f"the judge's counts for {q['id']} make no sense")
            except (BudgetExceeded, ValueError):
                raise
            except Exception as e:
                row |= {"state": "failed", "error": type(e).__name__}
            rows.append(tuple((row | {"seconds": run.clock() - began})[c] for c in _E2E))
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in _E2E.items()))


_E2E = {
    "system": "string", "query_id": "string", "question": "string", "answerability": "string", "category": "string", "gold": "array<string>", "in_corpus": "boolean", "state": "string",
    "ranked": "array<string>", "refused": "boolean", "n_claims": "long", "n_supported": "long", "n_citations": "long", "n_valid": "long", "answer": "string", "seconds": "double", "error": "string",
}


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows of end_to_end(), to be scored again."""
    return spark.read.schema(", ".join(f"{c} {t}" for c, t in _E2E.items())).json(path)


# Profiles of the latency run.
PROFILES = {
    "bm25_k100": {"retriever": "bm25", "candidate_k": 100}, "dense_k100": {"retriever": "dense", "candidate_k": 100}, "hybrid_k20": {"retriever": "hybrid", "candidate_k": 20},
    "hybrid_k50": {"retriever": "hybrid", "candidate_k": 50}, "hybrid_k100": {"retriever": "hybrid", "candidate_k": 100},
    "hybrid_k100_ce20": {"retriever": "hybrid", "candidate_k": 100, "rerank_k": 20}, "hybrid_k100_ce50": {"retriever": "hybrid", "candidate_k": 100, "rerank_k": 50},
}


def latency(spark: SparkSession, questions: list[str], search: Callable[..., object], profiles: Mapping[str, dict] = PROFILES, repeats: int = 2, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """(profile, question_no, pass, seconds, status): every question by every profile, the first pass cold and the others warm. search(question, **profile) runs to its end."""
    rows = []
    for name, options in profiles.items():
        for k in range(repeats):
            for i, question in enumerate(questions):
                began, status = clock(), "ok"
                try:
                    search(question, **options)
                except BudgetExceeded:
                    raise
                except Exception as e:
                    status = type(e).__name__
                rows.append((name, i, "cold" if k == 0 else "warm", float(clock() - began), status))
    return spark.createDataFrame(rows, "profile string, question_no int, pass string, seconds double, status string")
