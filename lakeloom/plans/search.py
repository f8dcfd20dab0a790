"""Search and answering over injected models.

Every step takes a batch of questions. Planning and a second round are rounds over a table of states; the one
revision of an answer stays on the driver. All of them are bounded by the run's grants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, context, dense, evidence, fusion
from . import artifacts
from .runtime import BudgetExceeded, Run


class Planner(Protocol):
    """Makes further phrasings of questions, in tasks; both calls may raise runtime or I/O errors."""

    def plan(self, question: str) -> list[str]: ...

    def follow_up(self, question: str, asked: list[str], titles: list[str]) -> list[str]: ...


def hybrid(postings: DataFrame, vectors: DataFrame | None, queries: DataFrame, candidate_k: int = 100, rrf_k: int = fusion.RRF_K, run: Run | None = None, key: str = "doc_id") -> DataFrame:
    """Both channels fused: (query_id, key, rank, score). queries: query_id, question, and vector where dense search is wanted.

    Without vectors a lenient run takes BM25 alone; else that is an error.
    """
    return both_channels(bm25.search(postings, queries, candidate_k, key), vectors, queries, candidate_k, rrf_k, run, key)


def both_channels(sparse: DataFrame, vectors: DataFrame | None, queries: DataFrame, candidate_k: int = 100, rrf_k: int = fusion.RRF_K, run: Run | None = None, key: str = "doc_id") -> DataFrame:
    """hybrid() from a lexical ranking (query_id, key, rank, score) at hand."""
    if vectors is None or "vector" not in queries.columns:
        if run is not None:
            run.give_way("dense", OSError("no dense index"))
        return sparse.select("query_id", key, "rank", "score")
    near = dense.search(vectors, queries.where("vector is not null"), candidate_k, key)
    return fusion.fuse(sparse, near, 2 * candidate_k, rrf_k, key).select("query_id", key, F.col("rrf_rank").alias("rank"), "score")


#: Tokens that a planner's call may use (fixed value), and the most queries of one question (a power of two beyond 1 + 4 + 2).
PLAN_TOKENS, VARIANTS = 500, 16


def _written(frame: DataFrame) -> DataFrame:
    """Rows that models made, kept as a table: no model is asked twice because a plan runs twice or an executor is lost."""
    path = artifacts.scratch(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _made(states: DataFrame, stage: str, call: Callable[[str, list[str], list[str]], list[str]], run: Run, limit: int) -> DataFrame:
    """States with `new`, up to `limit` queries that a model makes from (question, asked, titles) in tasks, one call a row.

    Calls are leased from the run. Errors come back as rows: a lenient run leaves those rows without new queries.
    """
    n = states.count()
    if not n:
        return states.withColumn("new", F.slice("asked", 1, 0))
    context = states.sparkSession.sparkContext
    tasks = min(n, context.defaultParallelism)
    task = F.pmod(F.hash("number"), F.lit(tasks))  # where repartition() sends a row
    rows = {r.task: r.n for r in states.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()}
    lease = run.lease(context, stage, tasks, 2 * n, PLAN_TOKENS, wanted=[rows.get(t, 0) for t in range(tasks)])
    model = lease.metered(call)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for number, question, asked, titles in zip(pdf.number, pdf.question, pdf.asked, pdf.titles, strict=True):
                try:
                    rows.append((number, [str(x) for x in model(question, list(asked), list(titles))], None, False))
                except Exception as e:
                    rows.append((number, [], type(e).__name__, isinstance(e, (RuntimeError, OSError))))
            yield pd.DataFrame(rows, columns=["number", "made", "error", "passing"])

    answers = _written(states.select("number", "question", "asked", "titles").repartition(tasks, "number").mapInPandas(ask, "number long, made array<string>, error string, passing boolean"))
    run.settle(lease)
    for bad in answers.where("error is not null").groupBy("error").agg(F.bool_and("passing").alias("passing")).orderBy("error").collect():
        if bad.error == BudgetExceeded.__name__:
            raise BudgetExceeded(stage)
        run.give_way(stage, OSError(bad.error) if bad.passing else ValueError(bad.error))
    fresh = F.array_except(T.sanitize_queries(F.col("made"), limit), "asked")
    return states.join(answers.select("number", "made"), "number").withColumn("new", fresh).drop("made")


def agentic(questions: DataFrame, planner: Planner, search: Callable[[DataFrame], DataFrame], run: Run, titles: DataFrame | None = None, k: int = 100, key: str = "doc_id") -> DataFrame:
    """Rounds of planned queries for a batch of questions (query_id, question), fused over all rankings: (query_id, key, rank, score, matched_queries).

    The questions are a table of states (number, query_id, question, asked, titles, new), written once a round: a round asks the planner in
    tasks for more queries of each state, searches all new ones as one batch, and a state without new ones is done. titles (key, title), if
    given, names the best hits to the planner's second call.
    """
    states = _written(questions.select(F.monotonically_increasing_id().alias("number"), "query_id", "question", F.array("question").alias("asked"), F.array().cast("array<string>").alias("titles")))
    hits: DataFrame | None = None

    def ranked(new: DataFrame, first: Column) -> DataFrame:
        """Rankings of the queries in `new`, whose variants are numbered from `first` on."""
        variants = new.select("number", "query_id", F.posexplode("new").alias("pos", "text"), first.alias("first"))
        nth = (F.col("first") + F.col("pos")).cast("long")
        variants = _written(variants.select((F.col("number") * VARIANTS + nth).alias("query_id"), F.col("query_id").alias("whose"), nth.alias("variant"), F.col("text").alias("question")))
        return search(variants.select("query_id", "question")).join(variants.select("query_id", "whose", "variant"), "query_id").select(F.col("whose").alias("query_id"), "variant", key, "rank")

    calls = (("planner", "plan", lambda question, asked, known: planner.plan(question)), ("reviewer", "review", planner.follow_up))
    for (role, name, call), limit in zip(calls, run.grants["rounds"], strict=False):
        with run.stage(name):
            if hits is not None and titles is not None:
                best = fusion.fuse_queries(hits, 10, key=key).join(titles, key)
                named = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("titles"))
                states = states.drop("titles").join(named, "query_id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
            made = _written(_made(states, role, call, run, limit))
        with run.stage("retrieve"):
            first_round = hits is None
            new = made.withColumn("new", F.concat("asked", "new")) if first_round else made
            found = ranked(new.where(F.size("new") > 0), F.lit(0) if first_round else F.size("asked"))
            hits = found if first_round else hits.unionByName(found)
        states = made.withColumn("asked", F.concat("asked", "new")).drop("new")
    return fusion.fuse_queries(hits, k, key=key)


def ask(questions: DataFrame, hits: DataFrame, generate: Callable[[str, str], str], judge=None, revise: Callable[[str, str, str], str] | None = None, run: Run | None = None, max_chars: int = 12000, per_parent: int = 2) -> DataFrame:
    """(query_id, state, answer): answers from contexts, verified, revised at most once, else refused.

    hits: query_id, question, parent_id, parent_rank, rank, chunk_id, text. generate gets the question and its prompt; the batch of
    questions is a stated set whose answers come to the driver.
    """
    spark, run = questions.sparkSession, run or Run()
    contexts = context.select_contexts(hits, max_chars, per_parent)
    prompts = {r.query_id: r.prompt for r in context.prompt(contexts).collect()}
    asked = {r.query_id: r.question for r in questions.collect()}

    def message(ids: dict, reason: str) -> dict:
        if not ids:
            return {}
        rows = spark.createDataFrame(list(ids.items()), "query_id long, question string")
        return {r.query_id: r.m for r in rows.select("query_id", T.refusal_message(F.col("question"), reason).alias("m")).collect()}

    def unsafe(answers: dict) -> set:
        if not answers:
            return set()
        rows = spark.createDataFrame(list(answers.items()), "answer_id long, answer string")
        verdicts = evidence.verify(rows, contexts.select(F.col("query_id").alias("answer_id"), "number", "text"), judge)
        return {r.answer_id for r in evidence.answer_safety(rows, verdicts).where("not safe").select("answer_id").collect()}

    out: dict = {}
    answers: dict = {}
    for q, text in asked.items():
        if q in prompts:
            run.book("answer", 1, 1000)
            with run.stage("answer"):
                answers[q] = generate(text, prompts[q])
    bad = unsafe(answers)
    if revise is not None and bad:
        for q in sorted(bad):
            run.book("revise", 1, 1000)
            with run.stage("revise"):
                answers[q] = revise(asked[q], prompts[q], answers[q])
        bad = unsafe({q: answers[q] for q in bad})
    if answers:
        rows = spark.createDataFrame(list(answers.items()), "query_id long, answer string")
        refusals = {r.query_id for r in rows.where(T.is_refusal(F.col("answer"))).select("query_id").collect()}
    else:
        refusals = set()
    groups = {
        "refused_no_retrieval": ({q: t for q, t in asked.items() if q not in answers}, "no_retrieval"),
        "refused_evidence_insufficient": ({q: asked[q] for q in answers if q in refusals}, "evidence_insufficient"),
        "refused_unverified": ({q: asked[q] for q in answers if q in bad and q not in refusals}, "unverified"),
    }
    for state, (ids, reason) in groups.items():
        out |= {q: (state, m) for q, m in message(ids, reason).items()}
    out |= {q: ("verified", a) for q, a in answers.items() if q not in out}
    return spark.createDataFrame([(q, s, a) for q, (s, a) in sorted(out.items())], "query_id long, state string, answer string")
