"""Persisted indexes, evaluation runs, provenance, service and sinks on tiny inputs."""

import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeloom import service
from lakeloom.functions import text as T
from lakeloom.operators import bm25, cells, chunk, context, dense, evidence, fusion
from lakeloom.plans import artifacts, evaluate, hashtree, index, metrics, provenance, runtime, segments, telemetry, understand, workspace
from lakeloom.plans import search as S
from lakeloom.sources import datasource, readers, sinks
from lakeloom.streaming import incremental, spans

WORDS = "graph net vector search tree model data query index claim".split()


def made_embedder():
    """A function that workers get whole, as they cannot import this file."""
    import numpy as np

    words = list(WORDS)
    return lambda texts: np.array([[1.0 + x.lower().count(w) for w in words] for x in texts], np.float32)


embedder = made_embedder()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i}", f"{WORDS[i % 10]} title", f"{WORDS[i % 10]} {WORDS[(i * 3 + 1) % 10]} text number {i}. It shows {WORDS[(i + 5) % 10]}.") for i in range(30)]
    return spark.createDataFrame(rows, "doc_id string, title string, text string").persist()


def test_lexical_index_is_bound_to_its_corpus(spark, docs, tmp_path):
    root = f"file://{tmp_path}/lex"
    built, fresh = index.ensure_lexical(docs, root, title="title")
    assert fresh and not index.ensure_lexical(docs, root, title="title")[1]
    queries = spark.createDataFrame([(1, "graph claim"), (2, "nothing here")], "query_id long, question string")
    plain = bm25.search(bm25.build(docs, title=F.col("title")), queries)
    assert sorted(map(tuple, index.search(built, queries).collect())) == sorted(map(tuple, plain.collect()))
    assert "In(term" in index.terms_only(built, bm25.query_terms(queries))._jdf.queryExecution().executedPlan().toString()
    other = docs.where("doc_id <> 'd3'")
    with pytest.raises(ValueError):
        index.open_lexical(spark, root, other, title="title")
    assert index.ensure_lexical(other, root, title="title")[1]
    session = index.Session(spark)
    assert session.get(root, warm=True) is session.get(root)
    index.build_lexical(docs, root, title="title")
    assert session.get(root).where("doc_id = 'd3'").count()
    session.drop(root)


def test_dense_index_rejects_other_rows(spark, docs, tmp_path):
    root = f"file://{tmp_path}/dense"
    vectors = index.build_dense(docs, root, embedder, model="m", snapshot="s")
    assert not any(index.binding(vectors, docs).first())
    wrong = docs.withColumn("text", F.when(F.col("doc_id") == "d1", "changed").otherwise(F.col("text"))).where("doc_id <> 'd2'")
    assert tuple(index.binding(vectors, wrong).first()) == (0, 1, 0, 1)
    index.open_dense(spark, root, docs, model="m", dimension=10)
    for bad in ({"model": "n"}, {"dimension": 9}):
        with pytest.raises(ValueError):
            index.open_dense(spark, root, **bad)
    with pytest.raises(ValueError):
        index.open_dense(spark, root, wrong)
    with pytest.raises(ValueError):
        index.build_dense(docs.withColumn("embedding", F.array(F.lit(0.0).cast("float"))), root)
    report = {r.check: r.ok for r in index.validate(spark, docs, f"file://{tmp_path}/none", root).collect()}
    assert report["dense: rows"] and report["dense: each vector belongs to its text"] and not report["lexical: rows"]
    moved = index.migrate_vectors(vectors.join(docs, "doc_id"), f"file://{tmp_path}/moved", 10, "m")
    assert moved.count() == 30
    with pytest.raises(ValueError):
        index.migrate_vectors(vectors.join(docs, "doc_id"), f"file://{tmp_path}/moved", 11, "m")
    assert index.contiguous(spark.range(5), "id") and not index.contiguous(spark.range(1, 6), "id") and not index.contiguous(spark.range(3).union(spark.range(1)), "id")


def test_rebuild_is_all_or_nothing(spark, tmp_path, monkeypatch):
    roots = {n: f"file://{tmp_path}/{n}" for n in "ab"}
    parts = lambda k: {n: (r, lambda: spark.range(k), {"scope": "x"}) for n, r in roots.items()}
    artifacts.rebuild(spark, parts(3))
    assert [artifacts.load(spark, r).count() for r in roots.values()] == [3, 3]

    def refuse(frames):
        raise ValueError("no")

    with pytest.raises(ValueError):
        artifacts.rebuild(spark, parts(4), refuse)
    whole = artifacts.point

    def broken(spark, root, facts):
        if root.endswith("/b") and facts["n"] == 5:
            raise OSError("disk")
        whole(spark, root, facts)

    monkeypatch.setattr(artifacts, "point", broken)
    with pytest.raises(OSError):
        artifacts.rebuild(spark, parts(5))
    assert [artifacts.load(spark, r).count() for r in roots.values()] == [3, 3]
    (tmp_path / "a" / "_pointers" / "000000000099.json").write_text("{torn")
    assert artifacts.load(spark, roots["a"]).count() == 3
    with pytest.raises(FileNotFoundError):
        artifacts.manifest(spark, f"file://{tmp_path}/none")


def test_checkpoint(spark, tmp_path):
    root = f"file://{tmp_path}/run"
    c = artifacts.Checkpoint(spark, root, {"model": "m"})
    assert c.rows() is None and c.todo(spark.range(5), "id").count() == 5
    c.append(spark.range(2))
    torn = tmp_path / "run" / "00000009-torn"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"PAR1")
    again = artifacts.Checkpoint(spark, root, {"model": "m"})
    assert sorted(r.id for r in again.todo(spark.range(5), "id").collect()) == [2, 3, 4]
    with pytest.raises(ValueError):
        artifacts.Checkpoint(spark, root, {"model": "n"})


def test_grants_and_stages():
    for bad in ({"seconds": float("nan")}, {"seconds": float("inf")}, {"seconds_a_call": 0}, {"rounds": (99, 1)}, {"rounds": (1, -1)}, {"rounds": (1, 1, 1)}, {"calls": 0}, {"odd": 1}):
        with pytest.raises(ValueError):
            runtime.Run(**bad)
    now = [0.0]
    run = runtime.Run(True, lambda: now[0], seconds=10)
    with pytest.raises(runtime.BudgetExceeded), run.stage("late"):
        now[0] = 11.0
    assert run.spans[0]["status"] == "failed" and run.spans[0]["error"] == "BudgetExceeded" and run.spans[0]["seconds"] == 11.0
    with pytest.raises(runtime.BudgetExceeded), run.stage("never"):
        pass
    now[0] = 1.0
    assert run.give_way("reranker", OSError("x")) == "fused" and run.book("x", 1, 5) == 9.0
    with pytest.raises(ValueError):
        run.book("x", 1, 0)
    chat = runtime.Chat(lambda m, **o: ("hi", {"prompt_tokens": 3, "completion_tokens": 2}), run)
    assert chat([{"role": "user", "content": "secret"}], stage="plan") == "hi" and "secret" not in repr(run.entries) and run.calls[0]["prompt_tokens"] == 3
    assert workspace.translated("什么 graph", runtime.Chat(lambda m, **o: (' "graph  nets" ', {}), run)) == "graph nets"
    with pytest.raises(RuntimeError):
        workspace.translated("什么", runtime.Chat(lambda m, **o: ("什么", {}), run))
    assert workspace.routed("什么") == "dense" and workspace.routed("what") == "hybrid" and workspace.routed("what", "bm25") == "bm25"


def test_leases_bound_calls_in_tasks(spark):
    """A judge that counts its calls never passes what the run has, with four tasks; what is not used comes back."""
    sc = spark.sparkContext
    seen = sc.accumulator(0)

    def judge(claims, evidence):
        seen.add(1)
        return ["support"] * len(claims)

    answers = spark.createDataFrame([(i, "Bees fly [1]. Ants walk [1].") for i in range(30)], "answer_id long, answer string")
    contexts = spark.createDataFrame([(i, 1, "Bees.") for i in range(30)], "answer_id long, number long, text string")
    for calls in (4, 10, 200):
        run, before = runtime.Run(calls=calls, tokens=10**6), seen.value
        lease = run.lease(sc, "judge", 4)
        rows = evidence.verify(answers, contexts, lease.metered(judge), 4).collect()
        made = seen.value - before
        assert len(rows) == 60 and made <= calls and run.settle(lease) == made and run.left("calls") == calls - made
        assert sum(r.verdict == "support" for r in rows) == 2 * made and {r.reason for r in rows if r.verdict != "support"} <= {"judge_error"}
        assert made == 30 or calls < 200
    lease = runtime.Run(calls=7, tokens=100).lease(sc, "x", 3, tokens_a_call=2)
    assert sum(lease.share(t, a) for t in range(5) for a in range(4)) == 7 and lease.share(0, 2) == lease.share(3, 0) == 0
    with pytest.raises(runtime.BudgetExceeded):
        runtime.Run(calls=1).lease(sc, "x", 3, 2)


def test_judge_is_asked_once_an_answer(spark):
    answers = spark.createDataFrame([(i, "Bees fly [1]. Ants walk [1]. Bees fly high [1].") for i in range(9)], "answer_id long, answer string")
    contexts = spark.createDataFrame([(i, 1, f"Text {i}.") for i in range(9)], "answer_id long, number long, text string")

    def judge(claims, proof):
        if proof[0] == "Text 4.":
            raise OSError("down")
        return [{"verdict": "support", "reason": f"{len(claims)} {k} {c}"} for k, c in enumerate(claims)][: 2 if proof[0] == "Text 5." else 3]

    got = {(r.answer_id, r.claim_no): (r.verdict, r.reason) for r in evidence.verify(answers, contexts, judge).collect()}
    assert got[0, 2] == ("support", "3 1 Ants walk .") and {got[4, k][1] for k in (1, 2, 3)} == {"judge_error"} and {got[5, k][1] for k in (1, 2, 3)} == {"invalid_judge_result"}


def made_planner():
    """A planner whose queries follow from its arguments; made here, so that workers get it whole."""

    class Phrases:
        def plan(self, question):
            if "bad" in question:
                raise OSError("down")
            return [f"{question} graph", "vector search", "vector  search", "图"]

        def follow_up(self, question, asked, titles):
            if "stop" in question:
                return []
            return [f"{titles[0] if titles else 'none'} trees", *asked]

    return Phrases()


def test_batches_of_questions_equal_single_runs(spark):
    docs = spark.createDataFrame([(f"d{i}", f"{w} text {i}", f"T{i}") for i, w in enumerate(("graph", "vector", "trees", "search graph", "none"))], "doc_id string, text string, title string")
    postings = bm25.build(docs).persist()
    titles = docs.select("doc_id", "title")
    asked = [(i, f"{('graph', 'vector', 'stop trees', 'bad none')[i % 4]} text {i % 5}") for i in range(40)]
    search = lambda q: bm25.search(postings, q)

    def rows(pairs, run):
        return sorted(tuple(r) for r in S.agentic(spark.createDataFrame(pairs, "query_id long, question string"), made_planner(), search, run, titles).collect())

    run = runtime.Run(True, calls=400, tokens=10**6)
    batch = rows(asked, run)
    assert {r[0] for r in batch} == set(range(40)) and run.fallbacks == [{"stage": "planner", "fallback": "classic", "error": "OSError"}] and run.left("calls") == 400 - 80
    for i in (0, 2, 3):
        assert rows([asked[i]], runtime.Run(True)) == [r for r in batch if r[0] == i]
    with pytest.raises(runtime.BudgetExceeded):
        rows(asked, runtime.Run(calls=8, tokens=10**6))
    with pytest.raises(OSError):
        rows(asked, runtime.Run(calls=400, tokens=10**6))


def test_provenance(spark, tmp_path):
    path = tmp_path / "f.txt"
    path.write_text("abc")
    hashes = provenance.Hashes(spark)
    want = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert hashes.sha256(f"file://{path}") == want
    hashes.verify(f"file://{path}", want)
    path.write_text("abcd")
    with pytest.raises(ValueError):
        hashes.verify(f"file://{path}", want)
    got = provenance.collect(spark, {"x": f"file://{tmp_path}/none"}, {"f": f"file://{path}", "g": f"file://{tmp_path}/g"}, {"chat": {"model": "m", "base_url": "https://u:p@h.org:1/x?key=1"}}, {"top_k": 5}, str(tmp_path))
    assert got["models"]["chat"]["base_url"] == "https://h.org:1" and got["files"]["g"]["sha256"] is None and got["artifacts"]["x"] is None and "f.txt" in got["code"]
    assert provenance.redacted("::") == "configured (redacted)" and provenance.redacted("") == ""
    z = provenance.source_snapshot(str(tmp_path))
    assert z == provenance.source_snapshot(str(tmp_path)) and json.loads(zipfile.ZipFile(io.BytesIO(z)).read("MANIFEST.json")) == got["code"]
    assert "pyspark==" in provenance.lock() and provenance.versions("no-such-package") == {"no-such-package": None}


def hits_of(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, parent_id string, rank long")


def test_retrieval_evaluation(spark):
    queries = spark.createDataFrame([(1, "s"), (2, "t")], "query_id long, query_set string")
    qrels = spark.createDataFrame([(1, "a"), (1, "zz"), (2, "b")], "query_id long, parent_id string")
    parents = spark.createDataFrame([("a",), ("b",), ("c",)], "parent_id string")
    hits = hits_of(spark, [(1, "x1", "c", 1), (1, "x2", "a", 2), (1, "x3", "a", 3), (1, "x4", "gone", 4), (2, "x1", "c", 1)])
    per = {r.query_id: r for r in evaluate.retrieval_eval(queries, qrels, hits, parents).collect()}
    assert (per[1].n_gold, per[1].mrr, per[1].orphans, per[1].recovered, per[1].pool_coverage, per[1].below_top_k) == (1, 0.5, 1, 2, 1.0, True)
    assert (per[2].mrr, per[2].pool_coverage, per[2].hit) == (0.0, 0.0, 0.0)
    total = {(r.slice, r.value): r for r in evaluate.summary(evaluate.retrieval_eval(queries, qrels, hits, parents), ["query_set"]).collect()}
    assert total["all", "all"].mrr == 0.25 and total["query_set", "s"].n == 1 and total["all", "all"].orphans == 1
    both = evaluate.compare(queries, qrels, {"m1": hits, "m2": hits.where("query_id = 2")}, parents, [])
    assert {r.mode: r.mrr for r in both.collect()} == {"m1": 0.25, "m2": 0.0}


def test_rerank_and_sweep_deltas(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    qrels = spark.createDataFrame([(1, "c"), (2, "a")], "query_id long, doc_id string")
    pool = spark.createDataFrame([(q, d, i, "q", p) for q in (1, 2) for i, (d, p) in enumerate([("a", "x"), ("b", "xx"), ("c", "xxx")], 1)], "query_id long, doc_id string, rank long, question string, passage string")
    got = {r.query_id: r for r in evaluate.rerank_eval(queries, qrels, pool, score=F.length("passage"), limit=3).collect()}
    assert (round(got[1].mrr_delta, 6), round(got[2].mrr_delta, 6), got[1].pool_coverage) == (round(1 - 1 / 3, 6), round(1 / 3 - 1, 6), 1.0)
    channel = lambda ids: spark.createDataFrame([(1, x, i) for i, x in enumerate(ids, 1)], "query_id long, doc_id string, rank long")
    swept = evaluate.fusion_sweep(channel(["a", "b", "c"]), channel(["c", "b"]), key="doc_id")
    assert swept.select("candidate_k", "rrf_k").distinct().count() == 12
    rows = evaluate.sweep_deltas(queries, qrels, swept, [], "doc_id").collect()
    assert len(rows) == 12 and all(r.delta_mrr == 0 for r in rows if (r.candidate_k, r.rrf_k) == evaluate.BASELINE)


def test_smoke_finds_foreign_hits(spark):
    channel = lambda ids: spark.createDataFrame([(1, x, i) for i, x in enumerate(ids, 1)], "query_id long, chunk_id string, rank long")
    a, b = channel(["x", "y"]), channel(["y", "z"])
    fused = fusion.fuse(a, b, 200, key="chunk_id")
    chunks = spark.createDataFrame([("x", "p", "t"), ("y", "p", "t"), ("z", "q", "")], "chunk_id string, parent_id string, text string")
    parents = spark.createDataFrame([("p",)], "parent_id string")
    assert [r.ok for r in evaluate.smoke(fused, a, b, chunks, parents).collect()] == [True, True, False, False]
    assert not evaluate.smoke(fused.where("chunk_id <> 'x'"), a, b, chunks, parents).first().ok
    assert metrics.same_rows(a, a).first() == (0, 0)
    with pytest.raises(ValueError):
        fusion.one_parent_each(spark.createDataFrame([("x", "p"), ("x", "q")], "chunk_id string, parent_id string"))
    assert sorted((r.chunk_id, r["rank"]) for r in fusion.channel(channel(["x", "x", "y", "z"]), 3, "chunk_id").collect()) == [("x", 1), ("y", 2)]


def test_end_to_end_and_replay(spark, tmp_path):
    questions = [{"id": 1, "question": "a", "gold_paper_ids": ["p"], "answerability": "answerable"}, {"id": "2_zh", "question": "b", "answerability": "unanswerable"}, {"id": 3, "question": "c", "gold_paper_ids": ["far"]}]

    def answer(q, ids):
        if q == "c":
            raise OSError("secret")
        return {"refused": q == "b", "citations": ["p", "other"], "answer": q}

    rows = evaluate.end_to_end(spark, questions, {"s": (lambda q: ["p", "r"], answer)}, {"p", "r"}, lambda q, said, ids: {"claim_count": 2, "supported_claims": 1})
    rows.write.json(f"file://{tmp_path}/rows")
    for frame in (rows, evaluate.replay(spark, f"file://{tmp_path}/rows")):
        got = {r.query_id: r for r in metrics.e2e_scores(frame).collect()}
        assert (got["1"].status, got["1"].recall, got["1"].citation_validity, got["1"].supported_claim_rate, got["1"].refusal_ok) == ("scored", 1.0, 0.5, 0.5, 1.0)
        assert (got["2_zh"].status, got["2_zh"].language, got["2_zh"].refusal_ok) == ("no_qrels", "translated", 1.0) and got["3"].status == "retrieval_failed"
    assert "secret" not in str(rows.collect())


def test_latency_profiles(spark):
    tick = iter(range(1000))
    got = evaluate.latency(spark, ["q1", "q2"], lambda q, **o: None if o["retriever"] != "dense" else 1 / 0, clock=lambda: next(tick))
    assert got.count() == 7 * 2 * 2 and {r.status for r in got.where("profile = 'dense_k100'").collect()} == {"ZeroDivisionError"}
    assert {r["pass"]: r.n for r in telemetry.percentiles(got.where("status = 'ok'"), ["pass"], F.col("seconds")).collect()} == {"cold": 12, "warm": 12}


def test_percentiles_of_large_groups(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(k, float(v)) for k, n in (("a", 3000), (None, 700), ("c", 1)) for v in np.round(r.lognormal(size=n), 2)] + [("d", None), ("a", float("nan")), ("a", float("inf"))]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    monkeypatch.setattr(telemetry, "NARROW", 100)
    got = {x.k: x for x in telemetry.percentiles(frame, ["k"], F.col("v"), (0.0, 0.5, 0.95, 1.0)).collect()}
    for k in ("a", None, "c"):
        values = [v for g, v in rows if g == k and v is not None and np.isfinite(v)]
        assert got[k].n == len(values)
        assert [got[k].p0, got[k].p50, got[k].p95, got[k].p100] == [round(float(np.percentile(values, p)), 6) for p in (0, 50, 95, 100)]
    assert got["d"].n == 0 and got["d"].p50 is None
    assert telemetry.percentiles(frame, [], F.col("v")).first().n == 3701


REPORT = """path string, status string, question string, pipeline string, rerank boolean, top_k int, corpus_hash string, chunk_hash string, config map<string,string>, seconds double, cost double,
timings array<struct<stage:string,seconds:double,status:string>>, calls array<string>,
systems array<struct<system:string,rows:array<struct<id:string,question:string,category:string,status:string,refused:boolean,seconds:double,cost:double,recall:double,mrr:double,ndcg:double,timings:array<struct<stage:string,seconds:double,status:string>>,calls:array<string>>>>>"""


def test_reports(spark):
    row = lambda i, q, s, status="verified": (i, q, "c", status, False, s, 0.1, 1.0, 0.5, 0.5, [("plan", s, "ok")], [])
    reports = [
        ("/r/all.json", None, None, None, None, 5, "p", "h", {"prompt": "v1", "top": "5"}, None, None, None, None, [("classic_hybrid", [row("1", "qa", 1.0), row("2_zh", "qb", 3.0, "refused_x")])]),
        ("/r/deep/one.json", "verified", " qa ", "classic", None, 5, "p", "h", {"top": "6"}, 2.0, 0.3, [("plan", 2.0, "ok"), ("plan", None, "failed")], [], None),
        ("/other/one.json", "failed", "qa", "classic", None, 5, "p", "h", None, 9.0, None, None, None, None),
        ("/r/x.json", "verified", "qz", "agentic", True, 5, None, None, None, 4.0, 0.2, None, None, []),
    ]
    got = telemetry.report_rows(spark.createDataFrame(reports, REPORT))
    rows = {(r.path, r.asked): r for r in got.collect()}
    assert set(rows) == {("/r/all.json", "qb"), ("/r/deep/one.json", "qa"), ("/other/one.json", "qa"), ("/r/x.json", "qz")}
    one = rows["/r/deep/one.json", "qa"]
    assert one.config == {"prompt": "v1", "top": "6"} and (one.id, one.recall, one.seconds) == ("1", 1.0, 2.0) and rows["/r/x.json", "qz"].system == "agentic_rerank"
    groups = telemetry.report_groups(got).collect()
    assert sum(g.runs for g in groups) == 4 and sum(g.failed for g in groups) == 1 and sum(g.refused for g in groups) == 1
    assert [(r.stage, r.n, r.p50, r.status_counts) for r in telemetry.stage_summary(got).collect()] == [("plan", 2, 2.5, {"failed": 1, "ok": 2})]
    assert {(r.language, r.category): r.recall for r in telemetry.quality_by_language(got.where("id is not null")).collect()} == {("original", "c"): 1.0, ("translated", "c"): 1.0}


def test_label_report(spark):
    rows = [("s", 1, "correct", "answerable", False, False), ("s", 2, "uncertain", "unanswerable", True, False), ("s", 3, None, "unknown", None, None), ("t", 1, "incorrect", "answerable", True, True)]
    frame = spark.createDataFrame(rows, "system string, query_id long, label string, answerability string, refused boolean, failed boolean")
    got = {r.system: r for r in telemetry.label_report(frame, ("correct", "incorrect", "uncertain"), ("correct", "incorrect"), ("correct",)).collect()}
    s, every = got["s"], got["overall"]
    assert (s.n, s.labelled, s.labels, s.decided, s.rate, s.refusal_accuracy) == (3, 2, {"correct": 1, "uncertain": 1}, 1, 1.0, 1.0)
    assert (every.questions, every.rate, every.refusal_scored, every.refusal_skipped_failed) == (3, 0.5, 2, 1)
    with pytest.raises(ValueError):
        telemetry.label_report(frame.withColumn("label", F.lit("odd")), ("correct",), (), ())


def test_audits(spark, docs):
    papers = spark.createDataFrame([("1", "T", "word " * 60, 2020, "", None, "cs"), ("2", "T", "short", 2023, "10.1/x", "u", None)], "paper_id string, title string, abstract string, year int, doi string, pdf_url string, primary_category string")
    one, categories, short = telemetry.paper_audit(papers)
    assert tuple(one.first()) == (2, 2020, 2023, 1, 1) and sorted(map(tuple, categories.collect())) == [("cs", 1), ("unknown", 1)] and [r.paper_id for r in short.collect()] == ["2"]
    scale = telemetry.chunk_scale(docs, docs.union(docs), 300).first()
    assert (scale.parents, scale.chunks, scale.chunks_a_parent, scale.projected_chunks) == (30, 60, 2.0, 600)
    runs = spark.createDataFrame([("r", "m")], "run_id string, model string")
    assert telemetry.inherit(spark.createDataFrame([("r", None), ("q", "x")], "run_id string, model string"), runs, "model").orderBy("run_id").collect()[1].model == "m"
    assert telemetry.completed_latency(spark.createDataFrame([("s", "failed", 9.0), ("s", "refused", 1.0)], "s string, outcome string, seconds double"), ["s"]).first().p50 == 1.0


def test_cards(spark):
    chunks = spark.createDataFrame([("p", "c1", "We use BM25 and trees."), ("p", "c2", "Trees grow.")], "parent_id string, chunk_id string, text string")
    rows = [("p", "methods", 1, "Uses BM25", "c1", "use bm25"), ("p", "methods", 2, "uses bm25 ", "c1", "We use"), ("p", "methods", 3, "Invented", "c1", "not there"), ("p", "odd", 4, "x", "c1", "We"), ("q", "methods", 1, "y", "c1", "We")]
    proposed = spark.createDataFrame(rows, "parent_id string, field string, pos long, claim string, chunk_id string, quote string")
    kept = evidence.card_claims(proposed, chunks)
    assert [(r.parent_id, r.field, r.claim, len(r.evidence), r.claim_no) for r in kept.collect()] == [("p", "methods", "Uses BM25", 2, 1)]
    assert {r.parent_id: (r.proposed, r.dropped) for r in evidence.card_drops(proposed, kept).collect()} == {"p": (4, 3), "q": (1, 1)}
    windows = spark.createDataFrame([("p", 2, "methods", 1, " uses bm25", ["b"]), ("p", 1, "methods", 1, "Uses BM25", ["a"]), ("p", 2, "methods", 2, "New", ["c"])], "parent_id string, window_no long, field string, claim_no long, claim string, evidence array<string>")
    assert [(r.claim_no, r.claim, r.evidence) for r in evidence.merged_cards(windows).orderBy("claim_no").collect()] == [(1, "Uses BM25", ["a"]), (2, "New", ["c"])]
    states = [("a", 1, "failed", 0, 2), ("b", 1, "ok", 1, 2), ("b", 2, "failed", 0, 3), ("c", 1, "ok", 0, 1), ("d", 1, "ok", 2, 1), ("e", 1, "ok", 1, 1), ("e", 2, "omitted", 0, 4)]
    got = {r.parent_id: r for r in evidence.card_status(spark.createDataFrame(states, "parent_id string, window_no long, state string, n_claims long, n_chunks long")).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "failed", "b": "partial", "c": "insufficient_evidence", "d": "verified", "e": "partial"}
    assert (got["e"].attempted_windows, got["e"].completed_windows, got["e"].processed_chunks, got["e"].omitted_chunks) == (1, 1, 1, 4)
    judged = evidence.judged_entries(spark.createDataFrame([("c", "e")], "claim string, evidence string"), lambda c, e: pd.Series(["support"] * len(c)))
    assert judged.first().verdict == "support"


def test_related_work(spark):
    entries = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("m", "a", 1), ("m", "b", 2)], "comparison_id string, paper_id string, entry_no long")
    cited = spark.createDataFrame([(c, p) for c in "km" for p in "ab"], "comparison_id string, paper_id string")
    verdicts = spark.createDataFrame([("k", 1, "support"), ("k", 2, "support"), ("m", 1, "support")], "comparison_id string, entry_no long, verdict string")
    assert [r.comparison_id for r in evidence.comparisons(entries, cited, verdicts).collect()] == ["k"]
    groups = spark.createDataFrame([("g", "so"), ("h", "no")], "group_id string, inference string")
    cites = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a"), ("h", "a")], "group_id string, paper_id string")
    assert {r.group_id: r.inference for r in evidence.inferences(groups, cites).collect()} == {"g": "so", "h": "unknown"}
    fields = spark.createDataFrame([("a", "method", "x"), ("b", "method", "y")], "paper_id string, field string, value string")
    own = spark.createDataFrame([("a", "method", "a"), ("b", "method", "a")], "paper_id string, field string, evidence_paper_id string")
    assert {r.paper_id: r.value for r in evidence.same_paper_fields(fields, own).collect()} == {"a": "x", "b": "unknown"}
    papers = lambda *x: spark.createDataFrame([(p,) for p in x], "paper_id string")
    assert tuple(evidence.coverage(papers("a", "c", "b"), papers("b")).first()) == (["b"], ["a", "c"])


def test_contexts(spark):
    parents = spark.createDataFrame([(1, "p", 1, "x" * 300), (1, "q", 2, ""), (1, "r", 3, "y" * 100)], "query_id long, parent_id string, parent_rank long, text string")
    assert [(r.number, r.parent_id) for r in context.full_contexts(parents, 800).orderBy("number").collect()] == [(1, "p"), (2, "r")]
    with pytest.raises(ValueError):
        context.full_contexts(parents, 700)
    results = spark.createDataFrame([("r", 1, "q", "says [2]."), ("r", 2, "q", "no citation")], "run_id string, query_id long, question string, answer string")
    ctx = spark.createDataFrame([(q, n, f"t{n}") for q in (1, 2) for n in range(1, 8)], "query_id long, number long, text string")
    assert {r.query_id: [e.number for e in r.evidence] for r in evidence.review_rows(results, ctx).collect()} == {1: [2], 2: [1, 2, 3, 4, 5]}
    gold = spark.createDataFrame([(["a", "b"], [("a", "big cat"), ("b", "dog")], {"a": "A Big  CAT", "b": "dogs"}), (["a"], [("b", "x")], {"a": "x"})], "g array<string>, q array<struct<paper_id:string,quote:string>>, t map<string,string>")
    assert [r.x for r in gold.select(T.quotes_cover_gold(F.col("g"), F.col("q"), F.col("t")).alias("x")).collect()] == [True, False]


def test_sources_and_sinks(spark, docs, tmp_path):
    facts = sinks.publish_chunks(docs, f"file://{tmp_path}/chunks", "structured", 300, 20)
    assert sinks.chunks_of(docs, f"file://{tmp_path}/chunks").count() == facts["n"] and facts["size"] == 300
    with pytest.raises(ValueError):
        sinks.chunks_of(docs.limit(3), f"file://{tmp_path}/chunks")
    assert sinks.write_jsonl(docs, f"file://{tmp_path}/j") == 30
    tries = []

    def read():
        tries.append(1)
        return docs if len(tries) > 2 else docs.select(F.raise_error(F.lit("down")).cast("string").alias("x"))

    waits = []
    assert sinks.read_with_retries(read, f"file://{tmp_path}/copy", sleep=waits.append).count() == 30 and waits == [2.0, 4.0]
    calls = []

    def opener(address, timeout):
        calls.append(address)
        return io.BytesIO(b"<feed/>")

    last = [0.0]
    digest = sinks.fetch_feed(spark, f"file://{tmp_path}/feed.xml", "all:graph", 5, opener=opener, clock=lambda: 1.0, sleep=waits.append, last=last)
    assert waits[-1] == pytest.approx(2.1) and "max_results=5" in calls[0] and provenance.Hashes(spark).sha256(f"file://{tmp_path}/feed.xml") == digest
    for bad in (0, 201):
        with pytest.raises(ValueError):
            sinks.fetch_feed(spark, f"file://{tmp_path}/g.xml", "q", bad, opener=opener)
    with pytest.raises(ValueError):
        sinks.fetch_feed(spark, f"file://{tmp_path}/g.xml", "q", opener=opener, most_bytes=3)
    (tmp_path / "p.jsonl").write_text('{"paper_id": "7", "full_text": "x"}\n{"paper_id": "8", "full_text": " "}\n')
    with pytest.raises(ValueError, match="'8'.*p.jsonl"):
        readers.parents(spark, f"file://{tmp_path}/p.jsonl")
    (tmp_path / "q.jsonl").write_text('{"paper_id": "7", "full_text": "x"}\n')
    assert readers.parents(spark, f"file://{tmp_path}/q.jsonl", "http://set").first().source_url == "http://set"
    queries, missing = readers.benchmark_queries(spark.createDataFrame([(" a  b ", ["1"], 9000), ("c", ["2"], 3)], "question string, gold_paper_ids array<string>, position long"), spark.createDataFrame([("1",)], "paper_id string"))
    assert sorted((r.id, r.question) for r in queries.collect()) == [("query_001", "c"), ("query_002", "a b")] and [r.paper_id for r in missing.collect()] == ["2"]
    _, counts = readers.benchmark_papers(spark.createDataFrame([("1", " ", None), ("2", "t", "")], "paper_id string, title string, abstract string"))
    assert tuple(counts.first()) == (1, 2, 1)
    meta = spark.createDataFrame([("d1", "T", "A")], "paper_id string, title string, abstract string")
    assert readers.with_metadata(spark.createDataFrame([("d1",), ("d2",)], "paper_id string"), meta).where("title = ''").count() == 1
    assert readers.by_ids(docs, ["d1"], "doc_id").count() == 1 and readers.by_ids(docs, [f"d{i}" for i in range(500)], "doc_id").count() == 30
    chunks = chunk.chunk(docs, "legacy")
    assert [r.chunk_index for r in readers.paper_chunks(chunks, "d1").collect()] == [0]
    zh = readers.probes(spark.createDataFrame([("1", "q")], "id string, question string"), {"1": "问"})
    assert (zh.first().id, zh.first().question) == ("1_zh", "问")
    with pytest.raises(ValueError):
        readers.probes(spark.createDataFrame([("1", "q")], "id string, question string"), {"2": "问"})
    assert readers.require(docs, "doc_id", "text") is docs


def test_simple_functions(spark):
    row = spark.createDataFrame([("See [1, 2; 3] and [2].", float("nan"), 2.0)], "t string, a double, b double").select(T.simple_citations(F.col("t")).alias("c"), T.finite(F.col("a")).alias("a"), T.finite(F.col("b")).alias("b")).first()
    assert row.c == [1, 2, 3] and row.a is None and row.b == 2.0
    model = dense.loaded(lambda: embedder, "m")
    assert model(["graph"]).shape == (1, 10)
    with pytest.raises(ValueError):
        dense.embed(spark.createDataFrame([("a", "b")], "doc_id string, text string"), embedder, batch=65)
    assert spark.createDataFrame([("t", "a")], "title string, abstract string").select(dense.paper_text().alias("x")).first().x == "t\na"


def test_dense_blocks_equal_plain_products(spark, monkeypatch):
    r = np.random.default_rng(2)
    v = r.normal(size=(200, 6))
    v = np.round(v / np.linalg.norm(v, axis=1, keepdims=True), 1)  # ties
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<double>").repartition(5)
    queries = vectors.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = []
    for q in range(0, 200, 20):
        ranked = sorted(range(200), key=lambda i: (-round(float(v[q] @ v[i]), 9), str(i)))[:7]
        want += [(q, i, k) for k, i in enumerate(ranked, 1)]
    for size, pairs in ((64 << 20, 1 << 22), (100, 50)):
        monkeypatch.setattr(dense, "QUERY_BYTES", size)
        monkeypatch.setattr(dense, "BLOCK_PAIRS", pairs)
        got = dense.search(vectors, queries, 7)
        assert sorted((x.query_id, x.doc_id, x["rank"]) for x in got.collect()) == sorted(want)
    plan = dense.search(vectors, queries, 7)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert dense.search(vectors, queries.limit(0), 3).count() == 0 and dense.search(vectors.limit(0), queries, 3).count() == 0


def test_cards_from_a_model(spark):
    rows = [("p", f"c{i}", i, f"Part {i}. We use method{i} here. " + "x" * 90) for i in range(6)] + [("q", "d0", 0, "Nothing much.")]
    chunks = spark.createDataFrame(rows, "parent_id string, chunk_id string, chunk_index long, text string")

    def complete(prompt):
        if "[c2]" in prompt:
            raise OSError("down")
        if "[d0]" in prompt:
            return "no json"
        ids = [x for x in ("c0", "c1", "c4", "c5") if f"[{x}]" in prompt]
        said = [{"claim": f"Uses method{i[1]}", "evidence": [{"chunk_id": i, "quote": f"we use METHOD{i[1]}"}]} for i in ids] + [{"claim": "Same", "evidence": [{"chunk_id": ids[0], "quote": "We use"}]}, {"claim": "Made up", "evidence": [{"chunk_id": ids[0], "quote": "absent"}]}]
        return "```json\n" + json.dumps({"methods": said, "odd": said}) + "\n```"

    claims, status = understand.cards(chunks, complete, window_chars=260)
    assert [(r.claim_no, r.claim) for r in claims.where("parent_id = 'p'").orderBy("claim_no").collect()] == [(1, "Uses method0"), (2, "Uses method1"), (3, "Same"), (4, "Uses method4"), (5, "Uses method5")]
    got = {r.parent_id: r for r in status.collect()}
    assert (got["p"].status, got["p"].completed_windows, got["p"].processed_chunks, got["p"].omitted_chunks, got["q"].status) == ("partial", 2, 4, 2, "failed")
    few = runtime.Run(calls=1)
    _, status = understand.cards(chunks.where("parent_id = 'p'"), complete, lambda c, e: pd.Series(["support"] * len(c)), few, 260, 2)
    assert (status.first().status, status.first().attempted_windows, status.first().omitted_chunks) == ("partial", 1, 4)


def test_related_overview(spark):
    contexts = spark.createDataFrame([(1, "a", "c1", "A uses trees."), (2, "b", "c2", "B uses graphs."), (3, "z", "c3", "Z.")], "number long, parent_id string, chunk_id string, text string")
    ev = lambda *x: [{"paper_id": p, "chunk_id": c, "quote": q} for p, c, q in x]
    a, b = ("a", "c1", "uses trees"), ("b", "c2", "uses graphs")
    answer = {
        "papers": [{"paper_id": "a", "field": "method", "value": "trees", "evidence": ev(a)}, {"paper_id": "b", "field": "method", "value": "trees", "evidence": ev(a)}],
        "groups": [{"members": ["b", "a"], "inference": "both", "evidence": ev(a, b)}, {"members": ["a", "b"], "inference": "one", "evidence": ev(a)}],
        "comparisons": [{"entries": [{"paper_id": "a", "claim": "trees"}, {"paper_id": "b", "claim": "graphs"}], "cited": ["a", "b"]}, {"entries": [{"paper_id": "a", "claim": "x"}], "cited": ["a"]}],
    }
    got = understand.overview(contexts, lambda p: json.dumps(answer), lambda c, e: pd.Series(["support" if x in y else "insufficient" for x, y in zip(c, e)]))
    assert {r.paper_id: r.value for r in got["fields"].collect()} == {"a": "trees", "b": "unknown"}
    assert [(r.members, r.inference) for r in got["groups"].collect()] == [(["a", "b"], "both")] and [r.papers for r in got["comparisons"].collect()] == [["a", "b"]]
    assert tuple(got["coverage"].first()) == (["a", "b"], ["z"])


def test_title_sweep(spark, docs):
    postings = bm25.build(docs, title=F.col("title"))
    queries = spark.createDataFrame([(1, "graph title"), (2, "net title")], "query_id long, question string")
    qrels = spark.createDataFrame([(1, "d0"), (2, "d1")], "query_id long, doc_id string")
    got = {r.weight: r for r in evaluate.title_sweep(postings, queries, qrels).collect()}
    assert set(got) == {1.0, 1.25, 1.5} and got[1.25].delta_mrr == 0
    assert evaluate.title_sweep(postings, queries, qrels, sample=1).count() == 3


def test_folder(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "a.md").write_text("# Graphs\ngraphs have edges.\n# Trees\ntrees have leaves.")
    (folder / "b.txt").write_text("vectors have lengths.")
    (folder / "c.txt").write_text("  ")
    root = f"file://{tmp_path}/root"
    got = workspace.index_folder(spark, f"file://{folder}", root)
    assert got["chunks"] == 3 and got["files"] == 3 and [x.rpartition("/")[2] for x in got["empty"]] == ["c.txt"]
    assert workspace.search_folder(spark, root, "graphs edges").first().section == "Graphs"
    state, answer = workspace.ask_folder(spark, root, "What have trees?", lambda q, p: "trees have leaves [1].")
    assert state == "verified"


@pytest.fixture(scope="module")
def library(spark, docs, tmp_path_factory):
    made = workspace.Library(spark, f"file://{tmp_path_factory.mktemp('lib')}", embedder, scorer=lambda q, p: p.str.len().astype(float))
    made.prepare(docs)
    return made


def test_library(library, spark):
    assert all(r.ok for r in library.validate().collect())
    for retriever in ("bm25", "dense", "hybrid", "auto"):
        got = library.search("graph net", retriever, top_k=3, candidate_k=20)
        assert 1 <= got.select("parent_id").distinct().count() <= 3
    assert library.search("graph net", "hybrid", top_k=2, rerank_k=5).count() >= 2
    said = library.ask("graph?", lambda q, p: "graph net text number 0 [1].", retriever="bm25")
    assert said["state"] in ("verified", "refused_unverified") and said["spans"]
    strict, soft = runtime.Run(), runtime.Run(True)
    broken = workspace.Library(spark, library.root, embedder, scorer=lambda q, p: 1 / 0)
    with pytest.raises(Exception):
        broken.search("graph net", "bm25", rerank_k=5, run=strict)
    assert broken.search("graph net", "bm25", rerank_k=5, run=soft).count() and soft.fallbacks[0]["fallback"] == "fused"


def test_service(library):
    import threading
    import urllib.error
    import urllib.request

    s = service.Service(library, generate=lambda q, p: "I cannot answer.")
    s.warm_up()
    assert s.status()["warm"] == "ready"
    o = service.options({"question": " q ", "top_k": 99, "candidate_k": "x", "pipeline": "classic"})
    assert (o["question"], o["top_k"], o["candidate_k"], o["rerank_k"]) == ("q", 10, 100, 0)
    for bad in ({}, {"question": "x" * 2001}, {"question": "q", "retriever": "bm25"}, {"question": "q", "pipeline": "odd"}):
        with pytest.raises(ValueError):
            service.options(bad)
    web = service.server(s)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{web.server_port}"
    post = lambda path, body: json.load(urllib.request.urlopen(urllib.request.Request(base + path, body.encode()), timeout=120))
    assert json.load(urllib.request.urlopen(f"{base}/api/status", timeout=30))["can_ask"] and b"<form" in urllib.request.urlopen(base, timeout=30).read()
    assert post("/api/search", '{"question": "graph net", "pipeline": "classic", "retriever": "bm25"}')["hits"]
    assert post("/api/ask", '{"question": "graph net", "pipeline": "classic", "retriever": "bm25"}')["state"].startswith("refused")
    for path, body, code in (("/api/search", "{", 400), ("/api/search", " " * 70_000, 400), ("/api/none", "{}", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            post(path, body)
        assert e.value.code == code
    web.shutdown()
    s.busy.acquire()
    assert s.handle("search", b'{"question": "q", "pipeline": "classic"}')[0] == 409
    s.busy.release()
    assert service.Service(library).handle("ask", b'{"question": "q", "pipeline": "classic"}')[0] == 400
    s.library = workspace.Library(library.spark, f"{library.root}/none")
    assert s.handle("search", b'{"question": "q", "pipeline": "classic", "retriever": "bm25"}')[0] == 409


def test_streams(spark, docs, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"file://{tmp_path}/in")
    incremental.follow_chunks(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check", "legacy").awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == chunk.chunk(docs, "legacy").count()
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 01:10:00", "a", 5.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"file://{tmp_path}/events")
    live = incremental.latency_windows(spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/events"))
    q = live.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted((str(r.start), r.n, r["mean"]) for r in incremental.latency_windows(events).collect())
    assert sorted((str(r.start), r.n, r["mean"]) for r in spark.table("live").collect()) == want and len(want) == 2


def found(frame, key="doc_id"):
    return sorted((r.query_id, r[key], r["rank"], r.score) for r in frame.collect())


def test_segments_equal_a_fresh_index(spark, tmp_path):
    """Three batches with replaced, deleted and added documents, by a stream, equal an index that is built at once; so does the compacted one."""
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(WORDS[int(i)] for i in rng.zipf(1.5, n) % len(WORDS)) + " " + " ".join(f"w{int(i)}" for i in rng.integers(0, 60, n))
    first = [(f"d{i}", text(int(rng.integers(1, 60))), f"{WORDS[i % 10]} note", False, 0) for i in range(150)]
    second = [(f"d{i}", text(20), "other", False, 1) for i in range(0, 60, 3)] + [(f"d{i}", None, None, True, 1) for i in range(1, 40, 4)] + [("e1", "", "", False, 1), ("d5", "stale", "", False, 0), ("d5", "graph graph fresh", "", False, 2)]
    third = [(f"d{i}", text(9), "", False, 2) for i in range(1, 20, 4)] + [("e1", None, None, True, 2), ("none", None, None, True, 2), ("e2", "claim index", "claim", False, 2)]
    schema = "doc_id string, text string, title string, deleted boolean, at long"
    for i, batch in enumerate((first, second, third)):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        index_ = segments.Segments(spark, f"file://{tmp_path}/index")
        incremental.follow_index(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), index_, f"file://{tmp_path}/check").awaitTermination(300)
        assert index_.facts()["batch"] == i and len(index_.facts()["segments"]) == i + 1
    assert not index_.apply(spark.createDataFrame(first, schema), 2)
    live = {}
    for key, body, title, deleted, at in sorted([*first, *second, *third], key=lambda r: r[4]):
        live.pop(key, None)
        if not deleted:
            live[key] = (key, body, title)
    docs = spark.createDataFrame(list(live.values()), "doc_id string, text string, title string")
    fresh = bm25.build(docs, title=F.col("title")).persist()
    columns = ["term", "doc_id", "tf", "dl", "df", "n_docs", "in_title"]
    rows = lambda p: sorted(tuple(r) for r in p.select(*columns, F.round("avgdl", 9)).collect())
    queries = spark.createDataFrame([(i, " ".join(WORDS[(i + j) % 10] for j in range(i % 4 + 1)) + f" w{i}") for i in range(25)] + [(90, "claim"), (91, "unknownword"), (92, "")], "query_id long, question string")
    want = {k: found(bm25.search(fresh, queries, k)) for k in (1, 3, 1000)}
    for _ in range(2):
        assert rows(index_.postings()) == rows(fresh)
        for k, hits in want.items():
            assert found(index_.search(queries, k)) == hits
        index_.compact()
        assert len(index_.facts()["segments"]) == 1


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path):
    """Common words beside rarer ones: most postings of the common ones are never read, and the results are the same."""
    word = "concat('w', cast(floor(pow(pmod(xxhash64(id, i), 100000) / 100000.0, 4) * 3000) as string))"
    docs = spark.range(8000).selectExpr("id AS doc_id", f"array_join(transform(sequence(1, 10 + cast(pmod(xxhash64(id), 50) as int)), i -> {word}), ' ') AS text")
    made = segments.Segments(spark, f"file://{tmp_path}/index")
    made.apply(docs)
    queries = spark.createDataFrame([(i, f"w{i % 4} w{40 * i + 7} w{90 * i + 11}") for i in range(30)], "query_id long, question string")
    blocks, read = made.plan(queries, 5)
    size = lambda frame: frame.select("term", "layer", "n").distinct().agg(F.sum("n")).first()[0]
    assert size(read) <= size(blocks) / 2
    assert made._read(read, made.facts()).count() == size(read)
    assert found(made.search(queries, 5)) == found(bm25.search(bm25.build(docs), queries, 5))


def test_one_changed_row_is_found_in_one_range(spark, tmp_path):
    rows, root = spark.range(100_000).selectExpr("id AS k", "concat('text ', id) AS x"), f"file://{tmp_path}/ranged"
    hashtree.publish(rows, root, "k")
    found_, ranges = hashtree.changes(rows, root)
    assert ranges == [] and found_.count() == 0
    found_, ranges = hashtree.changes(rows.withColumn("x", F.when(F.col("k") == 4711, "other").otherwise(F.col("x"))), root)
    assert [tuple(r) for r in found_.collect()] == [(4711, "changed")] and len(ranges) == 1
    read = artifacts.load(spark, root).where(F.col("key_range").isin(ranges))
    assert read.count() < 100 and "PushedFilters: [" in read._jdf.queryExecution().toString() and "key_range" in read._jdf.queryExecution().toString().split("PushedFilters: [")[1].split("]")[0]
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n")], "k long, x string")
    hashtree.publish(twice, f"{root}2", "k")
    got = {r.k: r.change for r in hashtree.changes(spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string"), f"{root}2")[0].collect()}
    assert got == {1: "changed", 2: "new", None: "gone"}


def test_case_folding_of_every_character(spark):
    codes = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, f"x{chr(c)}Y") for c in codes], "c long, x string")
    got = {r.c: r.f for r in rows.select("c", T.casefold(F.col("x")).alias("f")).collect()}
    assert got == {c: f"x{chr(c)}Y".casefold() for c in codes}
    assert spark.createDataFrame([("Maße ΣΑΣ ﬁn İ",)], "x string").select(T.evidence_norm(F.col("x"))).first()[0] == "masse σασ fin i̇"


def test_a_failing_embedder_leaves_the_old_library(spark, tmp_path):
    root = f"file://{tmp_path}/lib"
    parents = lambda word: spark.createDataFrame([(i, f"T{i}", f"{word} graph text {i}. " * 40) for i in range(4)], "doc_id long, title string, text string")
    workspace.Library(spark, root, embedder).prepare(parents("old"))

    def broken(texts):
        raise OSError("no model")

    with pytest.raises(Exception):
        workspace.Library(spark, root, broken).prepare(parents("new"))
    again = workspace.Library(spark, root, embedder)
    assert all(r.ok for r in again.validate().collect())
    assert again.search("old", "bm25").count() and not again.search("new", "bm25").count()


def test_folder_search_reads_its_written_index(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Graphs\nGraph text one.\n" * 20)
    (tmp_path / "in" / "b.md").write_text("# 图\n图神经网络 text.\n" * 20)
    workspace.index_folder(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    monkeypatch.setattr(bm25, "build", None)  # nothing is indexed while searching
    assert workspace.search_folder(spark, f"file://{tmp_path}/out", "graph").count() and workspace.search_folder(spark, f"file://{tmp_path}/out", "神经").count()


def test_cells_leave_vectors_out_and_lose_none(spark):
    r = np.random.default_rng(2)
    middle = r.normal(size=(20, 16))
    v = middle[r.integers(0, 20, 3000)] + 0.15 * r.normal(size=(3000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[8] = v[9]
    v[40:50] *= r.uniform(0.8, 1.1, size=(10, 1))  # bounds hold for vectors of any length
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<double>").repartition(3).persist()
    queries = rows.where("doc_id % 40 = 0 or doc_id = 8").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    centres = cells.centres_of(rows, most=200)
    made = cells.Cells(cells.assigned(rows, centres).persist(), centres)
    for k in (1, 10, 4000):
        assert found(made.search(queries, k)) == found(dense.search(rows, queries, k).select("query_id", "doc_id", "rank", "score"))
        assert k > 10 or 0 < made.multiplied.value < queries.count() * 3000 / 2
    assert made.search(queries.limit(0), 3).collect() == []


def test_data_sources(spark, tmp_path):
    """Order inside files, faults, several tasks, units, reports and a stream of new files."""
    datasource.register(spark)
    at = tmp_path / "feeds"
    at.mkdir()
    entry = lambda i, t: f"<entry><id>http://arxiv.org/abs/{i}v1</id><title>{t}</title><summary>s &amp; {t}</summary><author><name>N</name></author></entry>"
    (at / "a.xml").write_text('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">' + "".join(entry(i, f"t{i}") for i in range(1200)) + entry(3, "dup") + "</feed>")
    (at / "b.xml").write_text(entry(5, "later") + entry("x1", "y") + "<entry><id>")
    rows = spark.read.format("atom_feed").load(f"file://{at}")
    got = rows.collect()
    assert len(got) == 1201 + 3 and [r.fault is None for r in sorted(got, key=lambda r: (r.file, r.place))][-1] is False
    papers = {r.paper_id: (r.title, r.abstract, r.authors) for r in readers.atom(spark, f"file://{at}").collect()}
    assert len(papers) == 1201 and papers["3"] == ("t3", "s & t3", ["N"]) and papers["5"][0] == "t5" and papers["x1"][0] == "y"
    stream = lambda: spark.readStream.format("atom_feed").load(f"file://{at}").writeStream.format("parquet").option("path", f"file://{tmp_path}/live").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
    stream()
    (at / "c.xml").write_text(entry("new", "n"))
    stream()
    live = spark.read.parquet(f"file://{tmp_path}/live")
    assert live.count() == 1205 and live.where("id like '%new%'").count() == 1
    (at / "n.md").write_bytes(b"\xef\xbb\xbf# H\nx \xff")
    (at / "r.json").write_text('{"a": 1}')
    (at / "s.json").write_text("{broken")
    (unit,) = spark.read.format("text_units").load(f"file://{at}").collect()
    assert (unit.place, unit.section, unit.text) == (0, None, "# H\nx \ufffd")
    reports = {r.file.rpartition("/")[2]: (r.report, r.fault) for r in spark.read.format("report_files").load(f"file://{at}").collect()}
    assert reports == {"r.json": ('{"a": 1}', None), "s.json": (None, "JSONDecodeError")}
    (tmp_path / "empty").mkdir()
    assert spark.read.format("atom_feed").load(f"file://{tmp_path}/empty").count() == 0


def test_spans_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    """Pairs across batches, ends before begins, repeats, failures and halves that never meet."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    batches = [
        [("r", "1", "began", "plan", at(0), None), ("r", "2", "began", "search", at(1), None), ("r", "3", "ended", "late begin", at(2), None), ("s", "1", "began", "plan", at(1), None), ("r", "9", "began", "never", at(3), None)],
        [("r", "1", "ended", "plan", at(4), None), ("r", "1", "ended", "plan", at(4), "again"), ("r", "3", "began", "late begin", at(1), None), ("s", "1", "ended", "plan", at(6), "OSError"), ("x", "8", "ended", "no begin", at(7), None)],
        [("r", "2", "ended", "search", at(8), None), ("z", "1", "began", "plan", at(9), None), ("z", "1", "ended", "plan", at(9), None)],
        [("t", "1", "began", "tick", at(300), None), ("t", "1", "ended", "tick", at(300), None)],
        [("t", "2", "began", "tick", at(301), None), ("t", "2", "ended", "tick", at(301), None)],
    ]
    schema = "run_id string, span_id string, kind string, stage string, ts timestamp, error string"
    make = lambda rows: spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).select(*(x.split()[0] for x in schema.split(", ")))
    for batch in batches:
        make(batch).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = spans.paired(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(300)
    rows = lambda f: sorted(map(tuple, f.select("run_id", "span_id", "stage", "began", "ended", "seconds", "status").collect()), key=repr)
    live, table = spark.read.parquet(f"file://{tmp_path}/out"), spans.paired(make([r for b in batches for r in b]))
    assert rows(live) == rows(table) and {r.status for r in table.collect()} == {"ok", "failed", "lost"}
    assert {r.stage: (r.n, r.failed, r.lost, r["mean"]) for r in spans.stage_summary(live).collect()}["plan"] == (3, 1, 0, 180.0)
    assert sorted((r.run_id, r.events) for r in spans.sessions(make([r for b in batches for r in b])).collect()) == [("r", 8), ("s", 2), ("t", 4), ("x", 1), ("z", 2)]


def test_reviews_of_checked_questions_and_overviews(spark):
    results = spark.createDataFrame([(1, "What?", "a"), (2, "Why?", "b")], "query_id long, question string, answer string")
    questions = spark.createDataFrame([(1, "What?", "answerable"), (2, "Why?", "unanswerable"), (3, "x", None)], "query_id long, question string, answerability string")
    noted = artifacts.fingerprint(questions).first().asDict()
    assert sorted((r.query_id, r.answerability) for r in evidence.checked_questions(results, questions, noted).collect()) == [(1, "answerable"), (2, "unanswerable")]
    for bad, mark in ((questions.where("query_id < 3"), noted), (questions.where("query_id <> 2"), None), (questions.withColumn("question", F.lit("other")), None)):
        with pytest.raises(ValueError):
            evidence.checked_questions(results, bad, mark)
    parts = {
        "fields": spark.createDataFrame([("p", "method", "trees"), ("p", "data", "Unknown")], "paper_id string, field string, value string"),
        "groups": spark.createDataFrame([(0, ["p", "q"])], "group_id long, members array<string>"),
        "comparisons": spark.createDataFrame([], "comparison_id long, papers array<string>"),
    }
    got = {r.path: (r.kind, r.content, len(r.review_id)) for r in evidence.overview_review_rows("trees", parts).collect()}
    assert got == {"papers.p.method": ("related_paper_field", "trees", 20), "groups[0]": ("group", '{"group_id":0,"members":["p","q"]}', 20)}
