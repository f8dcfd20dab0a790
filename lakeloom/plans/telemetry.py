"""Latency, outcome, label and corpus summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse


#: Values of a group up to which its percentiles are read from all of them; of larger ones only the values near the wanted ranks are sorted.
NARROW = 1 << 16
#: Sketch size, and the share of ranks left to each side of a wanted one (the sketch errs by about 0.3 %).
SKETCH_K, MARGIN = 1024, 0.015


def percentiles(rows: DataFrame, keys: list[str], value: Column, points: tuple = (0.5, 0.95)) -> DataFrame:
    """Count and exact linearly interpolated percentiles; NaN and infinities are not measured, an empty group gives NULL.

    Two mergeable passes, whatever a group's size: sketches give bounds that enclose each wanted rank; then the values below the
    bounds are counted, and only those between them are sorted, which may spill. No task holds a group in memory.
    """
    x = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value.cast("double"))
    group = F.struct(*keys) if keys else F.struct(F.lit(1).alias("one"))  # groups of NULL keys are groups like others
    named = rows.select(group.alias("g"), x.alias("x"))
    measured = named.where("x is not null")
    sketch = measured.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.kll_sketch_agg_double("x", SKETCH_K).alias("k"))
    side = lambda p, end: F.when(F.col("n") > NARROW, F.kll_sketch_get_quantile_double("k", F.lit(p))).otherwise(F.col(end)) if 0 < p < 1 else F.col(end)
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), side(p - MARGIN, "lo").alias("a"), side(p + MARGIN, "hi").alias("b")) for i, p in enumerate(points)))
    marks = sketch.select("g", "n", F.explode(wanted).alias("q")).select("g", "n", "q.*")
    joined = measured.join(marks, "g")
    # one pass for both, since a sketch that is computed again may give other bounds: all values below them are one entry, with x NULL
    near = joined.where(F.col("x") <= F.col("b")).groupBy("g", "i", F.when(F.col("x") >= F.col("a"), F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("p").alias("p"))
    placed = near.withColumn("last", F.sum("c").over(Window.partitionBy("g", "i").orderBy(F.asc_nulls_first("x"))))
    rank = (F.col("n") - 1) * F.col("p")
    holds = lambda r: F.max(F.when((F.col("last") - F.col("c") <= r) & (r < F.col("last")), F.col("x")))
    found = placed.groupBy("g", "i").agg(holds(F.floor(rank)).alias("low"), holds(F.ceil(rank)).alias("high"), F.max(rank).alias("rank"))
    read = F.round(F.col("low") + (F.col("high") - F.col("low")) * (F.col("rank") - F.floor("rank")), 6)
    wide = found.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, read)).alias(f"p{round(100 * p)}") for i, p in enumerate(points)))
    every = named.groupBy("g").agg(F.count("x").alias("n"))
    return every.join(wide, "g", "left").select(*(F.col(f"g.{c}").alias(c) for c in keys), "n", *(f"p{round(100 * p)}" for p in points))


def counts_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def label_scores(labels: DataFrame, system: str, decided: Column, good: Column) -> DataFrame:
    """Coverage and decided-only rate by system and overall (system NULL): one rollup."""
    g = labels.rollup(system).agg(F.count(F.lit(1)).alias("n"), F.count_if(decided.isNotNull()).alias("labelled"), F.count_if(decided).alias("decided"), F.count_if(decided & good).alias("good"))
    return g.select(F.coalesce(F.col(system).cast("string"), F.lit("overall")).alias("system"), "n", "labelled", "decided", F.round(F.try_divide("labelled", "n"), 6).alias("coverage"), F.round(F.try_divide("good", "decided"), 6).alias("rate"))


# What reviewers of cards may say of an entry, and of its evidence.
CARD_LABELS, SUPPORT_LABELS = ("correct", "incorrect", "uncertain"), ("yes", "no", "uncertain")


def card_report(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """By kind and overall: rows, and for labels and for evidence labels each a histogram, coverage, decided rows and the share of good ones among them.

    rows: kind, label, evidence_support. Blank and unknown labels are not labels; uncertain ones are not decided.
    """
    def part(column: str, allowed: tuple, good: str, name: str) -> list[Column]:
        said = F.col(column)
        decided = said.isin(*allowed[:2])
        histogram = F.map_from_arrays(F.array(*map(F.lit, allowed)), F.array(*(F.count_if(said == x) for x in allowed)))
        return [
            histogram.alias(f"{name}s"), F.round(F.count_if(said.isin(*allowed)) / F.count(F.lit(1)), 6).alias(f"{name}_coverage"), F.count_if(decided).alias(f"{name}_decided"),
            F.round(F.try_divide(F.count_if(said == good), F.count_if(decided)), 6).alias(f"{name}_rate"),
        ]

    g = rows.rollup(kind).agg(F.grouping(kind).alias("_every"), F.count(F.lit(1)).alias("n"), *part("label", CARD_LABELS, "correct", "label"), *part("evidence_support", SUPPORT_LABELS, "yes", "support"))
    return g.withColumn(kind, F.when(F.col("_every") == 1, "overall").otherwise(F.col(kind))).drop("_every")


def label_report(rows: DataFrame, labels: tuple, decided: tuple, good: tuple, system: str = "system") -> DataFrame:
    """By system and overall: rows, questions, a histogram of the allowed labels, decided rows, coverage, the share of good ones among the decided, and refusal accuracy.

    rows: system, query_id, label, answerability, refused, failed. A label that isn't allowed is an error. Refusals are judged where the
    question is known to be answerable or not and the run didn't fail.
    """
    wrong = rows.where(F.col("label").isNotNull() & (F.col("label") != "") & ~F.col("label").isin(*labels)).select("label").first()
    if wrong is not None:
        raise ValueError(f"unknown label {wrong.label!r}")
    known = F.col("answerability").isin("answerable", "unanswerable")
    scored = known & ~F.coalesce("failed", F.lit(False))
    right = F.coalesce("refused", F.lit(False)) == (F.col("answerability") == "unanswerable")
    g = rows.rollup(system).agg(
        F.grouping(system).alias("_every"), F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("questions"), F.count_if(F.col("label").isin(*labels)).alias("labelled"),
        *(F.count_if(F.col("label") == x).alias(f"_{x}") for x in labels), F.count_if(F.col("label").isin(*decided)).alias("decided"), F.count_if(F.col("label").isin(*good)).alias("good"),
        F.count_if(scored).alias("refusal_scored"), F.count_if(known & F.coalesce("failed", F.lit(False))).alias("refusal_skipped_failed"), F.count_if(scored & right).alias("_right"),
    )
    histogram = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*(F.col(f"_{x}") for x in labels))), lambda _, n: n > 0)
    return g.select(
        F.when(F.col("_every") == 1, "overall").otherwise(F.coalesce(F.col(system), F.lit("unknown"))).alias("system"), "n", "questions", "labelled", histogram.alias("labels"), "decided",
        F.round(F.try_divide("labelled", "n"), 6).alias("coverage"), F.round(F.try_divide("good", "decided"), 6).alias("rate"),
        "refusal_scored", "refusal_skipped_failed", F.round(F.try_divide("_right", "refusal_scored"), 6).alias("refusal_accuracy"),
    )


def corpus_audit(docs: DataFrame) -> DataFrame:
    """One row: documents, repeated titles, least, upper-median and most words, texts under 50 words."""
    words = F.size(F.filter(F.split(F.trim(F.col("text")), r"\s+"), lambda w: w != "")).cast("long")
    sized = docs.select(F.lower(collapse(F.substring_index("text", "\n", 1))).alias("title"), words.alias("w"))
    repeated = sized.groupBy("title").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated_titles"))
    spread = sized.groupBy("w").agg(F.count(F.lit(1)).alias("k"))  # a histogram: its size doesn't grow with the corpus
    ordered = spread.agg(F.array_sort(F.collect_list(F.struct("w", "k"))).alias("h"), F.sum("k").alias("n"))
    upper = F.aggregate(
        "h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("m")),
        lambda a, x: F.struct((a["seen"] + x["k"]).alias("seen"), F.when(a["m"].isNull() & (a["seen"] + x["k"] > F.floor(F.col("n") / 2)), x["w"]).otherwise(a["m"]).alias("m")),
    )["m"]
    short = F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + F.when(x["w"] < 50, x["k"]).otherwise(F.lit(0)))
    return ordered.select(F.col("n").alias("documents"), F.element_at("h", 1)["w"].alias("least"), upper.alias("upper_median"), F.element_at("h", -1)["w"].alias("most"), short.alias("short_texts")).crossJoin(repeated)


def paper_audit(papers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row: papers, years, missing doi and pdf_url; categories by number, most first; ids of abstracts under 50 words). papers: as sources.readers.papers()."""
    bare = lambda c: F.count_if(F.coalesce(F.trim(F.col(c)), F.lit("")) == "").alias(f"no_{c}")
    one = papers.agg(F.count(F.lit(1)).alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), bare("doi"), bare("pdf_url"))
    categories = papers.groupBy(F.coalesce("primary_category", F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")
    words = F.size(F.filter(F.split(F.trim(F.coalesce("abstract", F.lit(""))), r"\s+"), lambda w: w != ""))
    return one, categories, papers.where(words < 50).select("paper_id")


def scale_audit(rows: DataFrame, text: str, kind: str, target: int) -> DataFrame:
    """Counts and bytes by kind, with a linear projection to a target number of documents."""
    total = rows.agg(F.count(F.lit(1)).alias("all"))
    g = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.coalesce(text, F.lit("")))).alias("bytes")).crossJoin(total)
    return g.select(kind, "n", "bytes", F.round(F.col("bytes") * target / F.col("all"), 0).cast("long").alias("projected_bytes"))


def chunk_scale(parents: DataFrame, chunks: DataFrame, target: int, text: str = "text") -> DataFrame:
    """One row: parents, chunks, their ratio, bytes, both projected linearly to a target number of parents, and hashes of both tables."""
    from .artifacts import fingerprint

    size = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias(f"{name}_bytes"))
    mark = lambda rows, name: fingerprint(rows).select(F.hex("x").alias(f"{name}_hash"))
    one = size(parents, "parents").crossJoin(size(chunks, "chunks")).crossJoin(mark(parents, "parents")).crossJoin(mark(chunks, "chunks"))  # single rows
    ratio = F.try_divide("chunks", "parents")
    return one.withColumns({"chunks_a_parent": F.round(ratio, 6), "projected_chunks": F.round(ratio * target).cast("long"), "projected_bytes": F.round(F.try_divide("chunks_bytes", "parents") * target).cast("long")})


def dedupe_reports(rows: DataFrame) -> DataFrame:
    """Report rows (scope, system, question, detail boolean, ...): an aggregate row goes if a detail row has its signature."""
    detail = rows.where("detail").select("scope", "system", "question").distinct()
    return rows.where("detail").unionByName(rows.where("not detail").join(detail, ["scope", "system", "question"], "left_anti"))


def missing_fields(rows: DataFrame, *names: str) -> DataFrame:
    """How many rows lack each field, and all of them."""
    empty = {c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in names}
    every = F.lit(True)
    for x in empty.values():
        every &= x
    return rows.agg(*(F.count_if(x).alias(f"no_{c}") for c, x in empty.items()), F.count_if(every).alias("no_field"))


def usage(calls: DataFrame) -> DataFrame:
    """Model calls by stage: number, failures, tokens."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return calls.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") != "ok").alias("failed"), n("prompt_tokens"), n("completion_tokens"))


def completed_latency(rows: DataFrame, keys: list[str], points: tuple = (0.5, 0.95)) -> DataFrame:
    """Percentiles of seconds over completed runs: successful and refused ones."""
    return percentiles(rows.where(F.col("outcome").isin("successful", "refused")), keys, F.col("seconds"), points)


def inherit(rows: DataFrame, runs: DataFrame, *columns: str) -> DataFrame:
    """Rows take what they lack from their run's metadata."""
    meta = runs.select("run_id", *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(meta, "run_id", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


# Names under which aggregate reports list their systems.
SYSTEM_NAMES = {"classic_hybrid": "classic", "agentic_hybrid": "agentic"}


def _system(c: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in SYSTEM_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, c), c)


def report_rows(reports: DataFrame) -> DataFrame:
    """Reports as rows, one a run: aggregate reports are spread to their systems' rows, which give way to a detail report of the same run.

    reports: path, status, question, pipeline, rerank, top_k, corpus_hash, chunk_hash, config (map), seconds, cost, timings, calls (arrays), and
    systems: array of (system, rows: array of (id, question, category, status, refused, seconds, cost, recall, mrr, ndcg, timings, calls)); null or empty for a
    detail report. Details take what their configuration lacks, and the question's id, category and metrics, from the aggregate that lies in the same
    folder or nearest above; they count as one run.
    """
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    is_all = F.size(F.coalesce("systems", F.array().cast(reports.schema["systems"].dataType))) > 0
    tagged = reports.withColumns({"folder": folder, "is_all": is_all})
    roots = tagged.where("is_all").select(F.col("folder").alias("root")).distinct()
    below = (F.col("folder") == F.col("root")) | F.col("folder").startswith(F.concat("root", F.lit("/")))
    # the folders above a report's, longest first, are looked up: no report meets every root
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/"))), lambda k: F.array_join(F.slice(F.split("folder", "/"), 1, k), "/"))
    scopes = tagged.select("path", "folder", F.explode(steps).alias("root")).join(roots, "root").where(below).groupBy("path").agg(F.max_by("root", F.length("root")).alias("scope"))
    scoped = tagged.join(scopes, "path", "left").withColumn("scope", F.coalesce("scope", "folder"))
    signature = ["scope", "system", "asked", "corpus_hash", "chunk_hash", "top_k"]
    common = ["path", "scope", "corpus_hash", "chunk_hash", "top_k", "config"]

    spread = scoped.where("is_all").select(*common, F.explode("systems").alias("s")).select(*common, F.col("s.system").alias("named"), F.explode("s.rows").alias("r"))
    rows = spread.select(*common, _system(F.col("named")).alias("system"), F.trim(F.coalesce("r.question", F.lit(""))).alias("asked"), "r.*")
    agentic = F.when((F.col("pipeline") == "agentic") & F.coalesce("rerank", F.lit(False)), F.lit("agentic_rerank")).otherwise(F.col("pipeline"))
    details = scoped.where(~F.col("is_all")).select(*common, agentic.alias("system"), F.trim(F.coalesce("question", F.lit(""))).alias("asked"), "status", "seconds", "cost", "timings", "calls")

    key = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in signature))
    rows, details = rows.withColumn("run_key", key), details.withColumn("run_key", key)
    source = rows.groupBy("run_key").agg(*(F.first(c).alias(f"all_{c}") for c in ("config", "id", "category", "recall", "mrr", "ndcg", "refused")))
    kept = rows.join(details.select("run_key").distinct(), "run_key", "left_anti").withColumn("detail", F.lit(False))
    whole = details.join(source, "run_key", "left")
    merged = F.map_concat(F.map_filter(F.coalesce("all_config", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("config", F.create_map().cast("map<string,string>"))), k)), F.coalesce("config", F.create_map().cast("map<string,string>")))
    whole = whole.withColumn("config", merged).select("*", *(F.col(f"all_{c}").alias(c) for c in ("id", "category", "recall", "mrr", "ndcg", "refused"))).withColumn("detail", F.lit(True))
    columns = ["path", "scope", "system", "corpus_hash", "chunk_hash", "top_k", "config", "id", "asked", "category", "status", "refused", "seconds", "cost", "recall", "mrr", "ndcg", "timings", "calls", "detail"]
    return kept.select(columns).unionByName(whole.select(columns))


def report_groups(rows: DataFrame) -> DataFrame:
    """Rows of report_rows() by system and configuration (what is unknown groups with unknown only): runs, outcomes, latency of completed ones, cost, quality means."""
    from ..functions.text import outcome

    config = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("config", F.create_map().cast("map<string,string>"))))))
    tagged = rows.withColumns({"config_key": config, "outcome": outcome(F.col("status"), F.col("refused"))})
    keys = ["system", "corpus_hash", "chunk_hash", "top_k", "config_key"]
    mean = lambda c: F.round(F.avg(F.when(~F.isnan(c), F.col(c))), 6).alias(c)
    counts = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("successful", "refused", "failed", "unlabeled")), F.round(F.sum("cost"), 8).alias("cost"), mean("recall"), mean("mrr"), mean("ndcg"))
    done = percentiles(tagged.where(F.col("outcome").isin("successful", "refused")), keys, F.col("seconds")).withColumnRenamed("n", "timed")
    match = F.lit(True)
    for c in keys:
        match &= counts[c].eqNullSafe(done[c])
    return counts.join(done, match, "left").select(*(counts[c] for c in counts.columns), F.coalesce("timed", F.lit(0)).alias("timed"), "p50", "p95")


def stage_summary(rows: DataFrame) -> DataFrame:
    """Stages of report_rows()' timings: measured runs, percentiles of seconds, and runs by status."""
    t = rows.select(F.explode("timings").alias("t")).select("t.stage", F.coalesce("t.status", F.lit("unlabeled")).alias("status"), F.col("t.seconds").alias("seconds")).where("stage is not null")
    states = t.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("k")).groupBy("stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "k")))).alias("status_counts"))
    return percentiles(t, ["stage"], F.col("seconds")).join(states, "stage")


def quality_by_language(rows: DataFrame) -> DataFrame:
    """Means of retrieval metrics by language (ids that end in _zh are translated questions) and category."""
    language = F.when(F.lower(F.col("id").cast("string")).endswith("_zh"), "translated").otherwise("original")
    mean = lambda c: [F.count(c).alias(f"n_{c}"), F.round(F.avg(c), 6).alias(c)]
    return rows.groupBy(language.alias("language"), F.coalesce("category", F.lit("unknown")).alias("category")).agg(*mean("recall"), *mean("mrr"), *mean("ndcg"))
