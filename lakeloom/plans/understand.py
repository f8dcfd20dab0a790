"""Paper cards and related-work overviews from an injected model, kept only as far as their evidence holds.

The papers of one call are a stated set: their prompts come to the driver, and the run's grants bound the calls.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, evidence
from .runtime import BudgetExceeded, Run

CARD = "map<string, array<struct<claim: string, evidence: array<struct<chunk_id: string, quote: string>>>>>"
OVERVIEW = """papers array<struct<paper_id: string, field: string, value: string, evidence: array<struct<paper_id: string, chunk_id: string, quote: string>>>>,
groups array<struct<members: array<string>, inference: string, evidence: array<struct<paper_id: string, chunk_id: string, quote: string>>>>,
comparisons array<struct<entries: array<struct<paper_id: string, claim: string>>, cited: array<string>>>"""

Judge = Callable[[pd.Series, pd.Series], pd.Series]


def window_prompts(chunks: DataFrame, window_chars: int = 28_000, max_windows: int = 8) -> DataFrame:
    """parent_id, window_no, prompt (null for what lies beyond max_windows), n_chunks: whole chunks, each under its id."""
    placed = chunks.join(chunk.chunk_windows(chunks, window_chars, max_windows).select("parent_id", "chunk_id", "window_no"), ["parent_id", "chunk_id"])
    one = F.struct("chunk_index", F.concat(F.lit("["), F.col("chunk_id"), F.lit("]\n"), F.col("text")).alias("block"))
    grouped = placed.groupBy("parent_id", "window_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["block"]), "\n\n").alias("prompt"), F.count(F.lit(1)).alias("n_chunks"))
    return grouped.withColumn("prompt", F.when(F.col("window_no").isNotNull(), F.col("prompt")))


def cards(chunks: DataFrame, complete: Callable[[str], str], judge: Judge | None = None, run: Run | None = None, window_chars: int = 28_000, max_windows: int = 8) -> tuple[DataFrame, DataFrame]:
    """(claims of each paper's card, status of each paper). chunks: parent_id, chunk_id, chunk_index, text.

    complete gets a window's prompt and gives JSON, field -> claims with chunk_id and quote as evidence. A window whose call or JSON
    fails is lost alone; windows after a spent budget, and those beyond max_windows, are omitted. With a judge, only supported claims stay.
    """
    spark, run, answers = chunks.sparkSession, run or Run(), []
    spent = False
    for w in window_prompts(chunks, window_chars, max_windows).orderBy("parent_id", F.col("window_no").asc_nulls_last()).collect():
        state, answer = "omitted", None
        if w.prompt is not None and not spent:
            try:
                run.book("understand", 1, 2048)
                with run.stage("understand"):
                    state, answer = "ok", complete(w.prompt)
            except BudgetExceeded:
                spent, state = True, "omitted"
            except Exception:
                state = "failed"
        answers.append((w.parent_id, -1 if w.window_no is None else w.window_no, state, answer, w.n_chunks))
    rows = spark.createDataFrame(answers, "parent_id string, window_no long, state string, answer string, n_chunks long")
    read = rows.withColumn("card", T.json_object(F.concat(F.lit('{"card": '), F.regexp_extract("answer", r"(?s)(\{.*\})", 1), F.lit("}")), f"card {CARD}")["card"])
    read = read.withColumn("state", F.when((F.col("state") == "ok") & F.col("card").isNull(), "failed").otherwise(F.col("state")))
    claims = read.where("state = 'ok'").select("parent_id", "window_no", F.explode("card").alias("field", "claims")).select("parent_id", "window_no", "field", F.posexplode("claims").alias("pos", "c"))
    proposed = claims.select("parent_id", "window_no", "field", "pos", F.col("c.claim").alias("claim"), F.explode("c.evidence").alias("e")).select("parent_id", "window_no", "field", "pos", "claim", "e.chunk_id", "e.quote")
    # a window is checked by itself, as its claims are numbered by itself
    keyed = proposed.withColumn("parent_id", F.to_json(F.struct("parent_id", "window_no")))
    windows = read.select("parent_id", "window_no").join(chunks, "parent_id").select(F.to_json(F.struct("parent_id", "window_no")).alias("parent_id"), "chunk_id", "text")
    kept = evidence.card_claims(keyed, windows)
    if judge is not None:
        quotes = F.array_join(F.transform("evidence", lambda e: e["quote"]), "\n")
        kept = evidence.judged_entries(kept.withColumn("given", F.col("evidence")).withColumn("evidence", quotes), judge).where("verdict = 'support'").withColumn("evidence", F.col("given")).drop("given", "verdict", "reason")
    at = F.from_json("parent_id", "parent_id string, window_no long")
    own = kept.withColumn("at", at).select("at.parent_id", "at.window_no", "field", "claim_no", "claim", "evidence")
    merged = evidence.merged_cards(own)
    counted = own.groupBy("parent_id", "window_no").agg(F.count(F.lit(1)).alias("n_claims"))
    states = read.select("parent_id", "window_no", "state", "n_chunks").join(counted, ["parent_id", "window_no"], "left").fillna(0, ["n_claims"])
    return merged, evidence.card_status(states)


def overview(contexts: DataFrame, complete: Callable[[str], str], judge: Judge | None = None, run: Run | None = None) -> dict[str, DataFrame]:
    """fields, groups, comparisons and coverage of a related-work overview over contexts (number, parent_id, chunk_id, text) of one question.

    Fields need evidence of their own paper; groups' members must be the papers that their evidence cites, two or more, and so must their
    inference's; comparisons need every entry supported and entries of exactly the cited papers. What does not hold is unknown or goes.
    """
    spark, run = contexts.sparkSession, run or Run()
    texts = contexts.select(F.col("parent_id").alias("paper_id"), "chunk_id", F.col("text").alias("source"))
    blocks = [f"[{r.number}] {r.parent_id} {r.chunk_id}\n{r.text}" for r in contexts.orderBy("number").collect()]
    run.book("related", 1, 4096)
    with run.stage("related"):
        answer = complete("\n\n".join(blocks))
    got = spark.createDataFrame([(answer,)], "answer string").select(T.json_object(F.col("answer"), OVERVIEW).alias("o")).select("o.*")

    def holding(entries: DataFrame, *keys: str) -> DataFrame:
        """Evidence (e) of entries that stands in its chunk: keys and paper_id."""
        flat = entries.select(*keys, F.explode("evidence").alias("e")).select(*keys, "e.paper_id", "e.chunk_id", "e.quote")
        return flat.join(texts, ["paper_id", "chunk_id"]).where(T.contains_quote(F.col("source"), F.col("quote"))).select(*keys, "paper_id").distinct()

    fields = got.select(F.explode("papers").alias("p")).select("p.*")
    own = holding(fields.select(F.col("paper_id").alias("whose"), "field", "evidence"), "whose", "field")
    fields = evidence.same_paper_fields(fields.select("paper_id", "field", "value"), own.select(F.col("whose").alias("paper_id"), "field", F.col("paper_id").alias("evidence_paper_id")))
    groups = got.select(F.posexplode("groups").alias("group_id", "g")).select("group_id", "g.*")
    cited = holding(groups, "group_id")
    valid = evidence.valid_groups(groups.select("group_id", "members"), cited).join(evidence.inferences(groups.select("group_id", "inference"), cited), "group_id")
    compared = got.select(F.posexplode("comparisons").alias("comparison_id", "c")).select("comparison_id", "c.*")
    entries = compared.select("comparison_id", F.posexplode("entries").alias("entry_no", "x")).select("comparison_id", "entry_no", "x.paper_id", "x.claim")
    sources = texts.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("source")), "\n\n").alias("evidence"))
    asked = entries.join(sources, "paper_id", "left")
    verdicts = evidence.judged_entries(asked, judge).select("comparison_id", "entry_no", "verdict") if judge is not None else entries.select("comparison_id", "entry_no", F.lit("insufficient").alias("verdict"))
    held = evidence.comparisons(entries.select("comparison_id", "entry_no", "paper_id"), compared.select("comparison_id", F.explode("cited").alias("paper_id")), verdicts)
    used = fields.where("value <> 'unknown'").select("paper_id").unionByName(valid.select(F.explode("members").alias("paper_id"))).unionByName(held.select(F.explode("papers").alias("paper_id")))
    return {"fields": fields, "groups": valid, "comparisons": held, "coverage": evidence.coverage(texts, used)}
