"""Expectations on tiny inputs."""

import json
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.operators import bm25, chunk, context, dense, evidence, fusion
from lakeloom.plans import artifacts, metrics, runtime, telemetry
from lakeloom.plans import search as S
from lakeloom.sources import readers


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(column(*(F.col(n) for n in names)).alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [("Evidence [1-2], repeated [2].", [1, 2]), ("Luo et al. [2021] found this [1].", [1]), ("[2, 1]; repeated [2] and [3；4]", [2, 1, 3, 4]), ("[5-2]", [5, 2]), ("[1-500]", [1, 500]), ("none", [])],
)
def test_citations(spark, text, want):
    assert one(spark, T.citation_numbers, text) == want


def test_text_functions(spark):
    assert one(spark, T.tokenize, "The Graph-based RAG of 2024 is it") == ["graph", "based", "rag", "2024"]
    assert one(spark, T.tokenize_mixed, "图神经 net_1 字") == ["图神", "神经", "net_1", "字"]
    assert one(spark, T.is_refusal, "I cannot answer this.") and not one(spark, T.is_refusal, "Graphs are good.")
    assert one(spark, T.language, "什么") == "Chinese"
    assert one(spark, T.redact_url, "https://u:p@Host.org:8443/a?k=1") == "https://host.org:8443"
    assert one(spark, T.redact_url, "no url") == "<unparsable>"
    assert one(spark, lambda a, b: T.record_url(a, b), "12", "7").count("12") == 1
    assert one(spark, lambda a, b: T.record_url(a, b), "", "arxiv:7") == ""
    assert one(spark, lambda q: T.sanitize_queries(q, 2), ["Graph  nets", "graph nets", "", "123", "图", "More"]) == ["Graph nets", "More"]
    assert one(spark, T.strip_citations, "A [2021] b [1, 2]") == "A [2021] b "
    assert one(spark, T.split_claims, "One et al. two. Three!\nFour") == ["One et al. two.", "Three!", "Four"]
    assert one(spark, T.block_kind, "a | b\nc | d") == "table" and one(spark, T.block_kind, "x = y + 1") == "equation"
    assert one(spark, lambda t, q: T.contains_quote(t, q), "A  Big\ncat", "big CAT") and not one(spark, lambda t, q: T.contains_quote(t, q), "a", " ")
    assert one(spark, lambda t: T.json_object(t, "a int"), "```json\n{\"a\": 3}\n```").a == 3


def test_rrf_order(spark):
    hits = lambda ids: spark.createDataFrame([(1, x, i) for i, x in enumerate(ids, 1)], "query_id long, doc_id string, rank long")
    got = fusion.fuse(hits(["a", "b"]), hits(["b", "c"])).orderBy("rrf_rank").collect()
    assert [r.doc_id for r in got] == ["b", "a", "c"]
    assert got[0].score == round(1 / 62 + 1 / 61, 8) and (got[0].bm25_rank, got[0].dense_rank) == (2, 1)
    many = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "a", 2)], "query_id long, variant long, doc_id string, rank long")
    got = fusion.fuse_queries(many).orderBy("rank").collect()
    assert [(r.doc_id, len(r.matched_queries)) for r in got] == [("a", 2), ("b", 2)]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "a", 1, "q", "x"), (1, "b", 2, "q", "xx"), (1, "c", 3, "q", "xxx")], "query_id long, doc_id string, rank long, question string, passage string")
    got = fusion.rerank(hits, lambda q, p: p.str.len().astype(float), 2).orderBy("new_rank").collect()
    assert [r.doc_id for r in got] == ["b", "a", "c"]


def test_bm25_ties_and_empty(spark):
    docs = spark.createDataFrame([(9, "cat"), (10, "cat"), (11, "dog")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat"), (2, "the")], "query_id long, question string")
    got = bm25.search(bm25.build(docs), queries).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 10), (1, 9)]
    few = bm25.build(docs, terms=bm25.few_terms(queries))
    assert few.select("term").distinct().count() == 1 and sorted(map(tuple, bm25.search(few, queries).collect())) == sorted(map(tuple, bm25.search(bm25.build(docs), queries).collect()))
    assert not bm25.build(docs, terms=[]).count() and few.first().n_docs == 3
    with pytest.raises(ValueError):
        bm25.search(bm25.build(docs), queries, 0)


def test_dense(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0])], "doc_id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [r.doc_id for r in dense.search(docs, queries, 2).orderBy("rank").collect()] == ["a", "b"]
    made = dense.embed(spark.createDataFrame([("a", "xy")], "doc_id string, text string"), lambda t: [[3.0, 4.0]] * len(t)).first()
    assert [round(x, 4) for x in made.embedding] == [0.6, 0.8]
    assert one(spark, dense.normalise, [0.0, 0.0]) is None


def structure(spark, *texts):
    rows = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "doc_id long, title string, text string")
    return chunk._structured_lines(rows).repartition(1).mapInArrow(
        lambda it: (pa.RecordBatch.from_pylist([{"row": r, "path": list(p), "kind": k, "text": t, "a": x, "b": y} for r, p, k, t, x, y in chunk.blocks(b)]) for b in it if chunk.blocks(b)),
        "row long, path array<string>, kind string, text string, a long, b long",
    ).collect()


def test_structure(spark):
    text = "# One\nfirst line\n\n## Two\na | b\nc | d\n# Three\nx = y + 1\n"
    assert [(r.path, r.kind, r.a, r.b) for r in structure(spark, text)] == [(["One"], "body", 2, 2), (["One", "Two"], "table", 5, 6), (["Three"], "equation", 8, 8)]
    for line, want in [("17 Oct 2023", None), ("2.1 Model", (2, "2.1 Model", True)), ("References", (1, "References", False)), ("## A #", (2, "A", False)), ("31 Big", None), ("3 small", None), ("4 X = y", None), ("x" * 141, None)]:
        got = one(spark, T.heading, line)
        assert (tuple(got) if got else None) == want, line
    got = structure(spark, "References\n1. Someone Wrote This\n# Next\n2 Real Heading\nbody", "plain\n\ntext")
    assert [r.path for r in got] == [["References"], ["Next", "2 Real Heading"][1:], ["全文"], ["全文"]]


def path_of(lines, i):
    """Section path of line i: its nearest heading, before it the nearest one that stands less deep, and so on. Depths by definition."""
    depth, out = {}, []
    heads = [(j, h) for j, h in enumerate(lines[:i]) if h]
    for n, (j, (level, _)) in enumerate(heads):
        depth[j] = min(level, depth[heads[n - 1][0]] + 1 if n else 1)
    want = 99
    for j, (_, title) in reversed(heads):
        if depth[j] < want:
            out.append(title)
            want = depth[j]
    return out[::-1] or ["全文"]


def test_section_paths_equal_their_definition(spark):
    r = random.Random(3)
    texts = []
    for _ in range(30):
        texts.append("\n".join(r.choice(["", f"{'#' * r.randint(1, 6)} H{k}", f"word {k}", f"{r.randint(1, 9)}.{r.randint(1, 9)} Title {k}"]) for k in range(r.randint(1, 25))))
    got = structure(spark, *texts)
    for row, text in enumerate(texts):
        lines = text.split("\n")
        heads = [(x.count("#"), x.lstrip("# ")) if x.startswith("#") else (x.split()[0].count(".") + 1, x) if x[:1].isdigit() else None for x in lines]
        want = [(tuple(path_of(heads, k)), k + 1) for k, x in enumerate(lines) if x.startswith("word")]
        assert sorted((tuple(b.path), n) for b in got if b.row == row for n in range(b.a, b.b + 1)) == sorted(want)


def test_long_text():
    assert chunk.pieces_of("x" * 450, 200, 50) == ["x" * 200, "x" * 200, "x" * 150]
    sentence = "Aa bb cc dd."
    parts = chunk.pieces_of(" ".join([sentence] * 60), 200, 20)
    plain = chunk.pieces_of(" ".join([sentence] * 60), 200, 0)
    assert " ".join(plain) == " ".join([sentence] * 60) and all(len(x) <= 200 for x in plain) and len(parts) == len(plain) > 2
    assert parts == [plain[0], *(f"{a[-20:]} {b}".strip() for a, b in zip(plain, plain[1:], strict=False))]
    mixed = chunk.pieces_of(f"Short one. {'y' * 250}. Tail here.", 200, 0)
    assert mixed == ["Short one.", "y" * 200, "y" * 50 + ".", "Tail here."]
    assert list(chunk.separator_windows("a" * 30 + ". " + "b" * 30, 40, 5)) == ["a" * 30 + ".", ". " + "b" * 30][:1] + ["aaa. " + "b" * 30]
    with pytest.raises(ValueError):
        chunk.check_size(100, 0)


def test_windows_end_after_the_best_separator():
    """Every cut against the definition, looked for character by character."""
    r = random.Random(5)
    for _ in range(40):
        text = "".join(r.choice(["a", "b", " ", "\n", "\n\n", "。", "？", ". "]) for _ in range(r.randint(1, 120))).strip()
        want, at = [], 0
        while text:
            end = min(len(text), at + 30)
            if end < len(text):
                cuts = [max((p + len(s) for p in range(at + 15, end - len(s) + 1) if text.startswith(s, p)), default=None) for s in chunk.SEPARATORS]
                end = next((c for c in cuts if c), end)
            want += [x] if (x := text[at:end].strip()) else []
            if end == len(text):
                break
            at = max(at + 1, end - 8)
        assert list(chunk.separator_windows(text, 30, 8)) == want


def test_legacy_chunks_pack_paragraphs(spark):
    text = "Abstract Words\nfirst par\nstill first\n\nsecond par.\n\n" + "z" * 300 + "\nNEXT PART\nlast"
    rows = spark.createDataFrame([(1, "a title.", text)], "doc_id long, title string, text string")
    got = [(r.section, r.text) for r in chunk.chunk(rows, "legacy", 200, 0).orderBy("chunk_index").collect()]
    assert got == [("全文", "a title."), ("Abstract Words", "first par still first\n\nsecond par."), ("Abstract Words", "z" * 200), ("Abstract Words", "z" * 100), ("NEXT PART", "last")]


def test_chunk_styles(spark):
    docs = spark.createDataFrame([(1, "T", "# H\nbody text here.\n\nmore"), (2, "U", "")], "doc_id long, title string, text string")
    for style in chunk.STYLES:
        rows = chunk.chunk(docs, style).collect()
        assert rows and all(r.parent_id in ("1", "2") for r in rows) and len({r.chunk_id for r in rows}) == len(rows)


def test_claims(spark):
    contexts = spark.createDataFrame([(1, 1, "A paper studies graphs."), (1, 2, "Trees are fine.")], "answer_id long, number long, text string")
    verify = lambda a, judge=None: evidence.verify(spark.createDataFrame([(1, a)], "answer_id long, answer string"), contexts, judge).orderBy("claim_no").collect()
    got = verify("A paper studies graphs [1]. Bees fly [2]. Nothing here. Wrong [3].")
    assert [(r.verdict, r.reason) for r in got] == [("support", "exact_text_match"), ("insufficient", "no_semantic_judge"), ("insufficient", "missing_citation"), ("insufficient", "invalid_citation_number")]
    caveat = "The evidence does not establish which was first."
    assert len(verify(f"A paper studies graphs [1]. {caveat}")) == 1 and len(verify(f"Graphs [1]. {caveat}")) == 2
    assert verify("Bees fly [2].", lambda c, e: pd.Series(["support"] * len(c)))[0].verdict == "support"

    def broken(c, e):
        raise RuntimeError("secret")

    said = verify("Bees fly [2].", lambda c, e: [{"verdict": " Contradiction", "reason": "r" * 600}] * len(c))[0]
    assert (said.verdict, len(said.reason)) == ("contradiction", 500)
    assert verify("Bees fly [2].", lambda c, e: [3] * len(c))[0].reason == "invalid_judge_result"
    assert [r.numbers for r in evidence.unsupported_numbers(spark.createDataFrame([(1, [7]), (1, [3, 7]), (1, [])], "answer_id long, unsupported array<long>")).collect()] == [[3, 7]]
    with pytest.raises(ValueError):
        evidence.verify(spark.createDataFrame([(1, "a [1].")], "answer_id long, answer string"), spark.createDataFrame([(1, 1, "x" * 200_000)], "answer_id long, number long, text string"))
    got = verify("Bees fly [2].", broken)[0]
    assert (got.verdict, got.reason) == ("insufficient", "judge_error")


def test_fail_closed(spark):
    entries = spark.createDataFrame([(1,), (2,)], "k long")
    got = evidence.apply_verdicts(entries, spark.createDataFrame([(1, "support"), (2, "maybe")], "k long, verdict string"), ["k"])
    assert sorted((r.k, r.verdict) for r in got.collect()) == [(1, "support"), (2, "insufficient")]
    groups = spark.createDataFrame([("g", ["a", "b"]), ("h", ["a", "b", "c"])], "group_id string, members array<string>")
    cited = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", "a"), ("h", "b")], "group_id string, paper_id string")
    assert [r.group_id for r in evidence.valid_groups(groups, cited).collect()] == ["g"]


def test_context_round_robin(spark):
    rows = [(1, "q", "p1", 1, 1, "c1", "x" * 500), (1, "q", "p1", 1, 3, "c2", "x" * 500), (1, "q", "p2", 2, 2, "c3", "x" * 500)]
    hits = spark.createDataFrame(rows, "query_id long, question string, parent_id string, parent_rank long, rank long, chunk_id string, text string")
    got = context.select_contexts(hits, 12000).orderBy("number").collect()
    assert [r.chunk_id for r in got] == ["c1", "c3", "c2"]
    assert [r.chunk_id for r in context.select_contexts(hits, 1500).orderBy("number").collect()] == ["c1", "c3"]


def test_metrics(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, question string")
    qrels = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "query_id long, doc_id string")
    ranking = spark.createDataFrame([(1, "x", 1), (1, "w", 2)], "query_id long, doc_id string, rank long")
    got = {r.query_id: r for r in metrics.query_metrics(queries, qrels, ranking).collect()}
    assert got[1].recall_5 == 0.5 and got[1].mrr == 1.0 and got[2].recall_5 == 0.0 and got[3].recall_5 is None
    assert 0 <= got[1].ndcg <= 1
    only = metrics.complete_only(queries, qrels, spark.createDataFrame([("x",), ("y",)], "doc_id string"))
    assert [r.query_id for r in only.collect()] == [1]


def test_percentiles(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", float("nan")), ("b", None)], "k string, v double")
    got = {r.k: r for r in telemetry.percentiles(rows, ["k"], F.col("v")).collect()}
    assert (got["a"].p50, got["a"].p95, got["a"].n) == (5.0, 9.5, 2) and got["b"].p50 is None


def test_runtime():
    run = runtime.Run(True, calls=1)
    run.book("plan", 1, 10)
    with pytest.raises(runtime.BudgetExceeded):
        run.book("plan", 1, 10)
    run.give_way("dense", OSError("x"))
    with pytest.raises(ValueError):
        run.give_way("dense", ValueError("stale"))
    with pytest.raises(runtime.BudgetExceeded):
        run.give_way("dense", runtime.BudgetExceeded("x"))
    with run.stage("a"), run.stage("b"):
        pass
    assert [(x["stage"], x["depth"], x["parent_stage"]) for x in run.spans] == [("b", 1, "a"), ("a", 0, None)]


def test_artifacts(spark, tmp_path):
    root = f"file://{tmp_path}/chunks"
    frame = spark.range(5).withColumn("x", F.col("id") * 2)
    artifacts.publish(frame, root, scope="full_text")
    assert artifacts.load(spark, root, verify=True, scope="full_text").count() == 5
    with pytest.raises(ValueError):
        artifacts.load(spark, root, scope="abstract")
    artifacts.publish(spark.range(3), root, scope="full_text")
    assert artifacts.load(spark, root).count() == 3
    got = {r.name: r.status for r in artifacts.audit(spark, {"a": {"root": root}, "b": {"root": f"{root}x"}, "c": {"root": root, "scope": "other"}}).collect()}
    assert got == {"a": "ok", "b": "missing", "c": "stale"}
    good = {"format": 1, "scope": "abstract", "documents": 3, "k1": 1.2, "b": 0.75, "avg_length": 2.0}
    assert artifacts.valid_index_facts(good)
    assert not any(artifacts.valid_index_facts(good | x) for x in ({"documents": True}, {"k1": 0}, {"b": 1.5}, {"avg_length": float("inf")}))
    assert artifacts.todo(spark.range(4), spark.range(2), "id").count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"paper_id": "1", "source_url": "u", "evidence_scope": "abstract", "title": "t"}\n')
    assert readers.papers(spark, f"file://{tmp_path}/p.jsonl").count() == 1
    (tmp_path / "d.jsonl").write_text('{"corpusid": "7", "full_paper": " text "}\n{"corpusid": "7", "full_paper": "again"}\n')
    with pytest.raises(ValueError):
        readers.parents(spark, f"file://{tmp_path}/d.jsonl")
    feed = '<feed><entry><id>http://arxiv.org/abs/2401.1v2</id><title> A  b </title><summary>s</summary><published>2024-01-02</published><author><name>X Y</name></author></entry><entry><id>http://arxiv.org/abs/2401.1v3</id><title>dup</title><summary>s</summary></entry></feed>'
    (tmp_path / "f.xml").write_text(feed)
    got = readers.atom(spark, f"file://{tmp_path}/f.xml").collect()
    assert [(r.paper_id, r.version, r.title, r.year, r.authors) for r in got] == [("2401.1", "v2", "A b", 2024, ["X Y"])]
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("# H\nx")
    assert readers.text_files(spark, f"file://{tmp_path}/md").first().text == "# H\nx"
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "ok.json").write_text('{"a": 1}')
    (tmp_path / "r" / "bad.json").write_text("{broken")
    ok, bad = readers.reports(spark, [f"file://{tmp_path}/r"], "a int")
    assert ok.count() == 1 and bad.count() == 1


def test_ask(spark):
    questions = spark.createDataFrame([(1, "Which graph?"), (2, "None?")], "query_id long, question string")
    rows = [(1, "Which graph?", "p1", 1, 1, "c1", "The graph is green.")]
    hits = spark.createDataFrame(rows, "query_id long, question string, parent_id string, parent_rank long, rank long, chunk_id string, text string")
    got = {r.query_id: r for r in S.ask(questions, hits, lambda q, p: "The graph is green [1].").collect()}
    assert got[1].state == "verified" and got[2].state == "refused_no_retrieval"
    got = {r.query_id: r for r in S.ask(questions, hits, lambda q, p: "It is red [1].", revise=lambda q, p, a: "Still red [1].").collect()}
    assert got[1].state == "refused_unverified"


def test_agentic(spark):
    docs = spark.createDataFrame([("a", "graph nets"), ("b", "vector search")], "doc_id string, text string")
    postings = bm25.build(docs)

    class Plans:
        def plan(self, q):
            return ["vector search", "vector  search", "图"]

        def follow_up(self, q, asked, titles):
            raise RuntimeError("down")

    run = runtime.Run(True)
    got = S.agentic(spark.createDataFrame([(0, "graph")], "query_id long, question string"), Plans(), lambda q: bm25.search(postings, q), run).collect()
    assert {r.doc_id for r in got} == {"a", "b"} and run.fallbacks[0]["fallback"] == "first_round_only"
