"""Claims, verdicts and fail-closed validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

VERDICTS = ("support", "contradiction", "insufficient")
MAX_CONTEXTS, MAX_CHARS = 1000, 100_000


def check_contexts(contexts: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """The contexts, after one aggregation found none too long, no answer with too many, and no blank name among the columns that name a source."""
    names = [c for c in ("paper_id", "chunk_id", "section") if c in contexts.columns]
    blank = F.lit(False)
    for c in names:
        blank |= F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    per = contexts.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("text")).alias("chars"), F.count_if(blank).alias("blank"))
    worst = per.agg(F.max("n").alias("n"), F.max("chars").alias("chars"), F.sum("blank").alias("blank")).first()
    longest = answers.agg(F.max(F.char_length("answer"))).first()[0] if answers is not None else 0
    if (worst.n or 0) > MAX_CONTEXTS or max(worst.chars or 0, longest or 0) > MAX_CHARS:
        raise ValueError(f"at most {MAX_CONTEXTS} contexts, each and the answer of at most {MAX_CHARS} characters")
    if worst.blank:
        raise ValueError(f"{worst.blank} contexts lack one of {names}")
    return contexts


def claims(answers: DataFrame) -> DataFrame:
    """(answer_id, answer) -> (answer_id, claim_no, claim, citations); caveats that need no citation are left out.

    A caveat about priority counts as one only if an earlier claim cited something about a paper.
    """
    pieces = answers.select("answer_id", F.posexplode(T.split_claims(F.coalesce("answer", F.lit("")))).alias("pos", "raw"))
    cut = pieces.select("answer_id", "pos", T.citation_numbers(F.col("raw")).alias("citations"), F.regexp_replace(T.strip_citations(F.col("raw")), r"^[ \t,;:，；：]+|[ \t,;:，；：]+$", "").alias("claim")).where("claim <> ''")
    low = F.lower("claim")
    before = Window.partitionBy("answer_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    named = cut.withColumn("prior", F.coalesce(F.max(((F.size("citations") > 0) & low.rlike(r"\bpaper\b|论文")).cast("int")).over(before), F.lit(0)) == 1)
    priority = low.rlike(r"\b(?:first|earliest|priority|only)\b|首次|最早|唯一")
    skipped = (F.size("citations") == 0) & T.is_caveat(F.col("claim")) & (~priority | F.col("prior"))
    kept = named.where(~skipped)
    return kept.select("answer_id", (F.row_number().over(Window.partitionBy("answer_id").orderBy("pos"))).cast("long").alias("claim_no"), "claim", "citations")


def _fail_closed(judge: Callable, claim: pd.Series, evidence: pd.Series) -> list[tuple[str, str]]:
    """Verdict and reason of each claim from one call; results that make no sense and errors fail closed, without the error's text, which may hold secrets."""

    def one(x) -> tuple[str, str]:
        if isinstance(x, str):
            said, why = x, ""
        elif isinstance(x, Mapping):
            said, why = str(x.get("verdict", "")), str(x.get("reason", ""))[:500]
        else:
            return "insufficient", "invalid_judge_result"
        said = said.strip().casefold()
        return (said, why) if said in VERDICTS else ("insufficient", "invalid_judge_verdict")

    try:
        got = list(judge(claim, evidence))
        return [one(x) for x in got] if len(got) == len(claim) else [("insufficient", "invalid_judge_result")] * len(claim)
    except Exception:
        return [("insufficient", "judge_error")] * len(claim)


def _guarded(judge: Callable) -> Callable:
    """judge over Series of entries, a batch a call."""
    return F.pandas_udf(lambda claim, evidence: pd.DataFrame(_fail_closed(judge, claim, evidence), columns=["verdict", "reason"]), "verdict string, reason string")


def judged_answers(rows: DataFrame, judge: Callable[[pd.Series, pd.Series], object], tasks: int | None = None) -> DataFrame:
    """(answer_id, claim_no, said): one call of the judge for each answer, with all its claims and evidence in order; rows: answer_id, claim_no, claim, evidence.

    A call that fails, or doesn't give as many verdicts as there are claims, leaves this answer's claims insufficient and no other's.
    """
    one = F.struct("claim_no", "claim", F.coalesce("evidence", F.lit("")).alias("evidence"))
    asked = rows.groupBy("answer_id").agg(F.array_sort(F.collect_list(one)).alias("asked"))
    if tasks is not None:  # by a key of its own, or the engine would keep the grouping's partitions and coalesce them
        asked = asked.withColumn("slot", F.xxhash64("answer_id")).repartition(tasks, "slot").drop("slot")
    kind = rows.schema["answer_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for answer, claims in zip(pdf.answer_id, pdf.asked, strict=True):
                said = _fail_closed(judge, pd.Series([x["claim"] for x in claims]), pd.Series([x["evidence"] for x in claims]))
                out += [(answer, x["claim_no"], *verdict) for x, verdict in zip(claims, said, strict=True)]
            yield pd.DataFrame(out, columns=["answer_id", "claim_no", "verdict", "reason"])

    said = asked.mapInPandas(run, f"answer_id {kind}, claim_no long, verdict string, reason string")
    return said.select("answer_id", "claim_no", F.struct("verdict", "reason").alias("said"))


def verify(answers: DataFrame, contexts: DataFrame, judge: Callable[[pd.Series, pd.Series], object] | None = None, tasks: int | None = None) -> DataFrame:
    """Verdict and reason of each claim, and its citation numbers that no context has; contexts: (answer_id, number, text), checked first.

    judge, if given, is called once an answer with Series of its claims and their joined evidence and gives verdicts, or mappings with verdict
    and reason, in the same order; whatever is no known verdict is insufficient. tasks: over how many the calls are spread (for a lease).
    """
    found, contexts = claims(answers), check_contexts(contexts, answers)
    cited = found.select("answer_id", "claim_no", "claim", F.explode("citations").alias("number")).join(contexts.select("answer_id", "number", "text", T.evidence_norm(F.col("text")).alias("norm")), ["answer_id", "number"], "left")
    needle = T.evidence_norm(F.col("claim"))
    tested = cited.groupBy("answer_id", "claim_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("text").isNull(), F.col("number")))).alias("unsupported"),
        F.coalesce(F.bool_or((needle != "") & F.contains(F.col("norm"), needle)), F.lit(False)).alias("exact"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), "\n\n").alias("evidence"),
    )
    joined = found.join(tested, ["answer_id", "claim_no"], "left").withColumn("unsupported", F.coalesce("unsupported", F.slice("citations", 1, 0)))
    if judge is None:
        said = F.struct(F.when(F.col("exact"), "support").otherwise("insufficient").alias("verdict"), F.when(F.col("exact"), "exact_text_match").otherwise("no_semantic_judge").alias("reason"))
        joined = joined.withColumn("said", said)
    else:
        joined = joined.join(judged_answers(joined, judge, tasks), ["answer_id", "claim_no"])
    uncited, invalid = F.size("citations") == 0, F.size("unsupported") > 0
    return joined.select(
        "answer_id", "claim_no", "claim", "citations",
        F.when(uncited | invalid, "insufficient").otherwise(F.col("said.verdict")).alias("verdict"),
        F.when(uncited, "missing_citation").when(invalid, "invalid_citation_number").otherwise(F.col("said.reason")).alias("reason"),
        "unsupported",
    )


def unsupported_numbers(verdicts: DataFrame) -> DataFrame:
    """(answer_id, numbers): the citation numbers of an answer that no context has, in order."""
    return verdicts.groupBy("answer_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("unsupported")))).alias("numbers"))


def answer_safety(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """safe: at least one claim, no invalid number, every claim supported."""
    per = verdicts.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_claims"), F.bool_and((F.col("verdict") == "support") & (F.col("reason") != "invalid_citation_number")).alias("all_supported"))
    joined = answers.select("answer_id").join(per, "answer_id", "left")
    return joined.select("answer_id", F.coalesce("n_claims", F.lit(0)).cast("long").alias("n_claims"), F.coalesce("all_supported", F.lit(False)).alias("safe"))


def apply_verdicts(entries: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Fail closed: an entry without a known verdict is insufficient."""
    known = verdicts.where(F.col("verdict").isin(*VERDICTS)).select(*keys, "verdict")
    return entries.join(known, keys, "left").withColumn("verdict", F.coalesce("verdict", F.lit("insufficient")))


# The fields of a paper card.
CARD_FIELDS = ("research_problem", "methods", "datasets", "experimental_setup", "main_findings", "limitations")


def card_claims(proposals: DataFrame, chunks: DataFrame, most: int = 20, fields: tuple = CARD_FIELDS) -> DataFrame:
    """Proposed claims (parent_id, field, pos, claim, chunk_id, quote) whose quote stands verbatim in the parent's own chunk.

    Claims without evidence or of unknown fields go; the first of each spelling stays, at most `most` a field.
    """
    own = chunks.select("parent_id", "chunk_id", F.col("text").alias("source"))
    ok = proposals.where(F.col("field").isin(*fields) & (F.trim("claim") != "")).join(own, ["parent_id", "chunk_id"]).where(T.contains_quote(F.col("source"), F.col("quote")))
    spelt = ok.groupBy("parent_id", "field", F.lower(F.trim("claim")).alias("spelling")).agg(F.min("pos").alias("pos"), F.min_by("claim", "pos").alias("claim"), F.array_sort(F.collect_set(F.struct("chunk_id", "quote"))).alias("evidence"))
    order = Window.partitionBy("parent_id", "field").orderBy("pos", "spelling")
    return spelt.withColumn("claim_no", F.row_number().over(order).cast("long")).where(F.col("claim_no") <= most).drop("spelling")


def card_drops(proposals: DataFrame, kept: DataFrame) -> DataFrame:
    """(parent_id, proposed, dropped): how many proposed claims of a parent did not come into its card."""
    asked = proposals.groupBy("parent_id").agg(F.countDistinct("field", "pos").alias("proposed"))
    stayed = kept.groupBy("parent_id").agg(F.count(F.lit(1)).alias("kept"))
    return asked.join(stayed, "parent_id", "left").select("parent_id", "proposed", (F.col("proposed") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def merged_cards(windows: DataFrame) -> DataFrame:
    """Claims of a parent's windows (parent_id, window_no, field, claim_no, claim, evidence) as one card: the first of each spelling of a field, in order."""
    first = windows.groupBy("parent_id", "field", F.lower(F.trim("claim")).alias("spelling")).agg(F.min(F.struct("window_no", "claim_no", "claim", "evidence")).alias("x"))
    order = Window.partitionBy("parent_id", "field").orderBy("x.window_no", "x.claim_no")
    return first.select("parent_id", "field", F.row_number().over(order).cast("long").alias("claim_no"), F.col("x.claim").alias("claim"), F.col("x.evidence").alias("evidence"), F.col("x.window_no").alias("window_no"))


def card_status(windows: DataFrame) -> DataFrame:
    """(parent_id, window_no, state, n_claims, and n_chunks if there) -> status, windows by state, chunks that were left out.

    A window's state is failed, omitted (never tried) or anything else (done). All failed: failed; some failed or
    omitted: partial; else verified with any claim and insufficient_evidence without.
    """
    chunks = F.col("n_chunks") if "n_chunks" in windows.columns else F.lit(0)
    lost = F.col("state").isin("failed", "omitted")
    g = windows.groupBy("parent_id").agg(
        F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "omitted").alias("omitted"), F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("n_claims"), F.lit(0)).alias("claims"), F.coalesce(F.sum(F.when(lost, chunks)), F.lit(0)).cast("long").alias("omitted_chunks"), F.coalesce(F.sum(F.when(~lost, chunks)), F.lit(0)).cast("long").alias("processed_chunks"),
    )
    done = F.col("n") - F.col("failed") - F.col("omitted")
    status = F.when(done == 0, "failed").when(done < F.col("n"), "partial").when(F.col("claims") == 0, "insufficient_evidence").otherwise("verified")
    return g.select("parent_id", status.alias("status"), (F.col("n") - F.col("omitted")).alias("attempted_windows"), done.alias("completed_windows"), "processed_chunks", "omitted_chunks")


def judged_entries(entries: DataFrame, judge: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """Entries (claim, evidence as text, ...) with verdict and reason from an injected verifier; it fails closed."""
    return entries.withColumn("said", _guarded(judge)("claim", F.coalesce("evidence", F.lit("")))).select("*", "said.verdict", "said.reason").drop("said")


def coverage(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """One row: candidate papers in order that the result uses, and those that it leaves out."""
    marked = candidates.select("paper_id").distinct().join(used.select("paper_id").distinct().withColumn("used", F.lit(True)), "paper_id", "left")
    pick = lambda how: F.array_sort(F.collect_list(F.when(how, F.col("paper_id"))))
    return marked.agg(pick(F.col("used").isNotNull()).alias("covered"), pick(F.col("used").isNull()).alias("omitted"))


def valid_groups(groups: DataFrame, evidence: DataFrame, least: int = 2) -> DataFrame:
    """Groups (group_id, members array) whose members are exactly the papers that their evidence (group_id, paper_id) cites, two or more."""
    cited = evidence.groupBy("group_id").agg(F.array_sort(F.collect_set("paper_id")).alias("cited"))
    return groups.join(cited, "group_id").where((F.array_sort(F.array_distinct("members")) == F.col("cited")) & (F.size("cited") >= least)).select("group_id", F.col("cited").alias("members"))


def same_paper_fields(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """A field (paper_id, field, value) without any evidence, or with evidence of another paper, is unknown."""
    per = evidence.groupBy("paper_id", "field").agg(F.bool_and(F.col("evidence_paper_id") == F.col("paper_id")).alias("own"))
    return fields.join(per, ["paper_id", "field"], "left").select("paper_id", "field", F.when(F.coalesce("own", F.lit(False)), F.col("value")).otherwise("unknown").alias("value"))


def cost_range(calls: DataFrame, hit: float = 0.003, miss: float = 0.15, completion: float = 0.6) -> DataFrame:
    """Token cost by run: off-peak and peak (double) per million; unsplit prompt tokens count as misses."""
    tokens = calls.select("run_id", F.coalesce("hit_tokens", F.lit(0)).alias("h"), F.coalesce("miss_tokens", F.greatest(F.coalesce("prompt_tokens", F.lit(0)) - F.coalesce("hit_tokens", F.lit(0)), F.lit(0))).alias("m"), F.coalesce("completion_tokens", F.lit(0)).alias("c"))
    low = (F.sum("h") * hit + F.sum("m") * miss + F.sum("c") * completion) / 1e6
    return tokens.groupBy("run_id").agg(F.round(low, 8).alias("low"), F.round(2 * low, 8).alias("high"))


def related_context(hits: DataFrame, papers: int = 20, chunks: int = 4, longest: int = 4000, max_chars: int = 12000) -> DataFrame:
    """Contexts of related papers: the first papers, few chunks of each, cut to a length, taken round robin within a budget."""
    from .context import select_contexts

    return select_contexts(hits.where(F.col("parent_rank") <= papers).withColumn("question", F.lit("")), max_chars, chunks, 220, longest)


def comparisons(entries: DataFrame, cited: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Comparisons (comparison_id, paper_id, entry_no) that hold: every entry supported, entries' papers equal to the cited papers, two or more."""
    judged = apply_verdicts(entries, verdicts, ["comparison_id", "entry_no"])
    per = judged.groupBy("comparison_id").agg(F.bool_and(F.col("verdict") == "support").alias("ok"), F.array_sort(F.collect_set("paper_id")).alias("papers"))
    named = cited.groupBy("comparison_id").agg(F.array_sort(F.collect_set("paper_id")).alias("cited"))
    return per.join(named, "comparison_id").where((F.col("papers") == F.col("cited")) & F.col("ok") & (F.size("papers") >= 2)).select("comparison_id", "papers")


def inferences(groups: DataFrame, evidence: DataFrame) -> DataFrame:
    """Group inferences that cite evidence of at least two papers; others are unknown."""
    per = evidence.groupBy("group_id").agg(F.countDistinct("paper_id").alias("n"))
    return groups.join(per, "group_id", "left").select("group_id", F.when(F.coalesce("n", F.lit(0)) >= 2, F.col("inference")).otherwise("unknown").alias("inference"))


def review_rows(results: DataFrame, contexts: DataFrame, most: int = 5) -> DataFrame:
    """Rows for human review (review_id, run_id, query_id, question, answer, evidence): the cited contexts, or the first few if none is cited.

    results: run_id, query_id, question, answer. contexts: query_id, number, text. Ids are stable.
    """
    cited = results.withColumn("cited", T.citation_numbers(F.col("answer")))
    joined = cited.join(contexts, "query_id", "left").where(F.col("number").isNull() | F.array_contains("cited", F.col("number")) | ((F.size("cited") == 0) & (F.col("number") <= most)))
    packed = joined.groupBy("run_id", "query_id", "question", "answer").agg(F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "text")))).alias("evidence"))
    return packed.withColumn("review_id", T.short_id(F.col("run_id"), F.col("query_id"), F.col("answer")))


def checked_questions(results: DataFrame, questions: DataFrame, recorded: Mapping[str, object] | None = None) -> DataFrame:
    """results (query_id, question, ...) with the questions' own columns, after the question set proved to be that of the run.

    recorded holds the fingerprint (n, x, s) that the run noted of its question set. Another set, a question that the set lacks, or one
    with another text, is an error: a label must not be given to something else than was asked.
    """
    if recorded is not None:
        from ..plans.artifacts import fingerprint

        now = fingerprint(questions).first().asDict()
        if {k: recorded.get(k) for k in now} != now:
            raise ValueError("the question set is not the one that the run recorded")
    told = questions.withColumnRenamed("question", "_told")
    joined = results.join(told, "query_id", "left")
    wrong = joined.agg(F.count_if(F.col("_told").isNull()).alias("absent"), F.count_if(F.col("_told") != F.col("question")).alias("other")).first()
    if wrong.absent or wrong.other:
        raise ValueError(f"{wrong.absent} results have no question in the set, {wrong.other} have another text")
    return joined.drop("_told")


def _review(rows: DataFrame, report: Column, kind: str, path: Column, content: Column, references: Column) -> DataFrame:
    named = rows.select(report.alias("report_id"), F.lit(kind).alias("kind"), path.alias("path"), content.alias("content"), references.alias("source_references"))
    ids = T.short_id(F.col("report_id"), F.col("kind"), F.col("path"), F.col("content"))
    return named.select(ids.alias("review_id"), "*", F.lit("").alias("label"), F.lit("").alias("evidence_support"))


def card_review_rows(claims: DataFrame) -> DataFrame:
    """Every claim of paper cards (parent_id, field, claim_no, claim, evidence) as a row for review: review_id, report_id, kind, path, content, source_references, label, evidence_support.

    Paths name a claim's place in its field, counted from 0; references are each passage once, in order; ids are stable.
    """
    place = F.row_number().over(Window.partitionBy("parent_id", "field").orderBy("claim_no")) - 1
    rows = claims.where(F.trim(F.coalesce("claim", F.lit(""))) != "").withColumn("place", place)
    passages = F.transform(F.array_distinct("evidence"), lambda e: F.struct(e["chunk_id"].cast("string").alias("chunk_id"), e["quote"].alias("quote")))
    return _review(rows, F.concat(F.lit("paper_understanding:"), F.col("parent_id").cast("string")), "paper_field", F.concat(F.lit("fields."), F.col("field"), F.lit("["), F.col("place").cast("string"), F.lit("]")), F.col("claim"), passages)


def overview_review_rows(topic: str, parts: Mapping[str, DataFrame]) -> DataFrame:
    """What an overview (see understand.overview) says, as rows for review: known fields of papers, groups and comparisons."""
    none, report = F.array().cast("array<struct<chunk_id: string, quote: string>>"), F.lit(f"related_work:{topic}")
    fields = parts["fields"].where(F.lower("value") != "unknown")
    known = _review(fields, report, "related_paper_field", F.concat_ws(".", F.lit("papers"), F.col("paper_id").cast("string"), "field"), F.col("value"), none)
    whole = lambda name, key: _review(parts[name], report, name.removesuffix("s"), F.concat(F.lit(f"{name}["), F.col(key).cast("string"), F.lit("]")), F.to_json(F.struct(*sorted(parts[name].columns))), none)
    return known.unionByName(whole("groups", "group_id")).unionByName(whole("comparisons", "comparison_id"))
