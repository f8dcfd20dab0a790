"""Searches of large batches: what leaves their tasks, and that they give the rows of the plain operators."""

import random

import pytest
from test_findings_r03 import WORDS

from lakeloom import queries as Q
from lakeloom import queries_plans  # noqa: F401  registers more

DATA = "/root/testdata/sf0.001"


def texts(spark, n, copies=1):
    """n documents over words of two languages, short and long, each `copies` times."""
    pick = random.Random(7)
    words = [[f"{x}{i}" for i in range(150)] for x in ("en", "es")]
    rows = []
    for i in range(n):
        own = words[i % 2]
        rows.append(" ".join([pick.choice(WORDS), *(own[min(int(pick.expovariate(0.04)), 149)] for _ in range(pick.choice((0, 5, 30, 200))))]))
    rows = [t for t in rows for _ in range(copies)] + [None, "", "the of", "zwei " * 3000]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)


def asked_of(spark, docs):
    asked = docs.where("doc_id % 3 = 0 and text is not null").selectExpr("doc_id as query_id", "substring(text, 1, 80) as question")
    more = spark.createDataFrame([(-1, ""), (-2, None), (-3, "en1 en2 en1"), (-3, "en2 es5"), (-4, "unknown")], "query_id long, question string")
    return asked.unionByName(more)


def rows_of(frame):
    return sorted(map(tuple, frame.select("query_id", "doc_id", "rank", "score").collect()))


@pytest.mark.parametrize("sliced", [True, False])
@pytest.mark.parametrize("k", [1, 6, 90])
def test_pruned_search_is_exact(spark, monkeypatch, sliced, k):
    from lakeloom.operators import batch, blocks, bm25

    docs = texts(spark, 300, 2)
    asked = asked_of(spark, docs)
    want = rows_of(bm25.search(bm25.build(docs), asked, k))
    monkeypatch.setattr(batch, "best", None)  # no task keeps k rows of each query
    if sliced:
        monkeypatch.setattr(blocks, "SLICED_FROM", 10)
        monkeypatch.setattr(blocks, "SAMPLE_DOCS", 20)
        monkeypatch.setattr(blocks, "SLICES", (4, 4, 8))
        monkeypatch.setattr(blocks, "TASK_DOCS", 10)
        monkeypatch.setattr(blocks, "BLOCK_DOCS", 32)
        monkeypatch.setattr(blocks, "LEAST_DOCS", 8)
        monkeypatch.setattr(blocks, "LAID_POSTINGS", 2000)
        monkeypatch.setattr(blocks, "LAID_DOCS", 100)
        monkeypatch.setattr(blocks, "MOST_COMMON", 20)
        monkeypatch.setattr(batch, "BLOCK_QUERIES", 90)
        monkeypatch.setattr(batch, "BLOCK_PAIRS", 512)
    assert rows_of(batch.search(docs, asked, k)) == want


def test_rows_of_a_search_do_not_grow_with_tasks(spark, monkeypatch):
    """k rows left each task for each query; now slices raise a bound that all tasks know."""
    from lakeloom.operators import batch, blocks

    monkeypatch.setattr(blocks, "SLICED_FROM", 10)
    docs = texts(spark, 3000).where("text <> ''").repartition(40)
    asked = docs.where("doc_id % 20 = 0").selectExpr("doc_id as query_id", "substring(text, 1, 80) as question").persist()
    k, n, names = 10, asked.count(), ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    old = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, "1m")  # a task for each file
    try:
        assert batch.best(docs, asked, k).count() > 20 * k * n
        assert blocks.top(docs, asked, k).count() < 8 * k * n
    finally:
        for name in names:
            spark.conf.set(name, old[name])


def test_blocks_leave_queries_out(spark, monkeypatch):
    """A block of documents meets only queries whose words there can reach their bound."""
    import numpy as np
    import pyarrow as pa

    from lakeloom.operators import blocks

    n, words = 64, pa.array(["a", "b", "c", "d"])
    asked = blocks.Asked(pa.table({"query_id": [1, 1, 2, 2], "term": ["a", "b", "c", "d"]}), words, np.array([4.0, 4, 4, 4]), n, 2.0)
    block = blocks._Block(np.array([0, 1, 0, 2]), np.array([3.0, 2.0, 4.0, 1.0]), np.array([2, 2]), 4)
    met = lambda least: [own.tolist() for own, _ in blocks._chunks(asked, block, np.array(least))]
    assert met([0.0, 0.0]) == [[0, 1]]
    assert met([5.9, 1.1]) == [[0]]
    assert met([6.1, 0.9]) == [[1]]
    ((_, score),) = blocks._chunks(asked, block, np.zeros(2))
    assert score.tolist() == [[5.0, 4.0], [0.0, 1.0]]
    assert block.exact(asked, np.array([0, 0, 1]), np.array([0, 1, 1])).tolist() == [5.0, 4.0, 1.0]


def test_sweep_leaves_out_what_cannot_rank(spark):
    """The sweep's rows before they are ranked: not every key by every configuration; keys that stand twice in a channel count as they did."""
    from pyspark.sql import functions as F

    from lakeloom.operators import bm25
    from lakeloom.plans import evaluate

    def plain(sparse, near, k, cks, rks):
        grid = F.array(*(F.struct(F.lit(c).alias("candidate_k"), F.lit(r).alias("rrf_k")) for c in cks for r in rks))
        each = sparse.unionByName(near).select("*", F.explode(F.filter(grid, lambda g: g["candidate_k"] >= F.col("rank"))).alias("g"))
        raw = each.groupBy("g.candidate_k", "g.rrf_k", "query_id", "doc_id").agg(F.round(F.sum(1.0 / (F.col("g.rrf_k") + F.col("rank"))), 12).alias("raw"))
        return bm25.ranked(raw, k, "doc_id", "candidate_k", "rrf_k")

    pick = random.Random(2)
    channel = lambda n, twice: [(q, pick.randrange(60) if twice and q % 2 else d, r + 1) for q in range(12) for r, d in enumerate(pick.sample(range(60), n))]
    sparse, near = (spark.createDataFrame(channel(n, t), "query_id long, doc_id long, rank long").persist() for n, t in ((40, False), (30, True)))
    rows = lambda f: sorted(map(str, f.select("candidate_k", "rrf_k", "query_id", "doc_id", "rank", "score").collect()))
    for k in (3, 10):
        assert rows(evaluate.fusion_sweep(sparse, near, k, "doc_id", (5, 20, 40), (20, 60))) == rows(plain(sparse, near, k, (5, 20, 40), (20, 60)))
    plan = evaluate.fusion_sweep(sparse, near, 3, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")  # the plan is printed from its end: keys are grouped first, then multiplied


def test_dense_search_leaves_k_rows_of_each_query_and_task(spark, monkeypatch):
    import numpy as np

    from lakeloom.operators import dense

    v = np.random.default_rng(1).normal(size=(500, 6)).round(1)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<double>").coalesce(1)
    asked = vectors.where("doc_id % 20 = 0").selectExpr("doc_id as query_id", "embedding as vector")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "50")
    try:
        rows = dense.search(vectors, asked, 4).collect()
        monkeypatch.setattr(dense, "ranked", lambda found, k, key: found)
        assert dense.search(vectors, asked, 4).count() == 4 * 25
    finally:
        spark.conf.set(name, old)
    products = np.round(v[::20] @ v.T, 9)
    want = [(20 * q, d, r + 1) for q, row in enumerate(products) for r, d in enumerate(sorted(range(len(row)), key=lambda d: (-row[d], str(d)))[:4])]  # noqa: B023
    assert sorted((r.query_id, r.doc_id, r.rank) for r in rows) == sorted(want)


def test_title_weights_are_swept_without_rows_for_pairs(spark, monkeypatch):
    """eval_delta and title_sweep add nothing up by query and document; results are those of contributions added up by weight."""
    duckdb = pytest.importorskip("duckdb")
    from pyspark.sql import functions as F
    from test_queries import plain

    from lakeloom.operators import bm25
    from lakeloom.plans import evaluate

    docs = texts(spark, 120, 2).withColumn("title", F.substring_index("text", " ", 3))
    asked = asked_of(spark, docs).where("query_id >= 0")
    qrels = docs.where("doc_id % 6 = 0").selectExpr("doc_id as query_id", "doc_id")
    postings = bm25.build(docs, title=F.col("title")).persist()
    parts = bm25.contributions(postings, bm25.query_terms(asked), title_weight=1.0).withColumn("weight", F.explode(F.array(F.lit(1.0), F.lit(1.25), F.lit(3.0))))
    raw = parts.groupBy("weight", "query_id", "doc_id").agg(F.round(F.sum(F.col("part") * F.when(F.col("in_title"), F.col("weight")).otherwise(1.0)), 9).alias("raw"))
    rows = lambda f: sorted(map(str, f.collect()))
    want = rows(evaluate.title_deltas(asked, qrels, bm25.ranked(raw, 10, "doc_id", "weight"), (1.0, 1.25, 3.0)))
    monkeypatch.setattr(bm25, "contributions", None)
    assert rows(evaluate.title_sweep(postings, asked, qrels, (1.0, 1.25, 3.0))) == want
    monkeypatch.setattr(bm25, "build", None)
    got, c = Q.QUERIES["eval_delta"](spark, DATA), duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    sql = c.sql(Q.SQL["eval_delta"])
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(sql.fetchall(), sql.columns)
