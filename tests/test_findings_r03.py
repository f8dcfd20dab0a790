"""Small tables on which queries differed from their SQL or from a plain computation, and plans that grew faster than their input."""

import random

import pytest
from test_queries import plain

from lakeloom import queries as Q
from lakeloom import queries_plans  # noqa: F401  registers more

WORDS = "de que al ßein Ssein ación Straße STRASSE x² x 1½ zwei‿drei zwei drei ΣΟΦΟΣ lua el un ado".split()


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables with words whose full case folding is longer than they are, and other marks."""
    pick, folder = random.Random(3), tmp_path_factory.mktemp("small")
    texts = [" ".join(pick.choices(WORDS, k=pick.randint(3, 60))) for _ in range(200)]
    items = [" ".join(pick.choices(WORDS, k=pick.randint(1, 3))) for _ in range(20)] + ["ßein ado", "Ssein ado", "x ado", "...", "Straße", ""]
    docs = [(i, t, "es" if i % 2 else "de", "web", len(t)) for i, t in enumerate(texts)] + [(200, None, "de", "web", 0), (201, " . ", "de", "web", 3), (202, "Ssein ado", "de", "web", 9)]
    table(spark, folder, "documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    table(spark, folder, "benchmark", list(enumerate(items)), "item_id long, text string")
    talk = [(1, 0, "user", "Uno de al. Dos. Tres"), (1, 1, "assistant", "et al.\nY. Al. B? C"), (2, 0, "user", ""), (2, 1, "user", None)]
    table(spark, folder, "conversations", talk, "conv_id long, turn long, role string, text string")
    table(spark, folder, "labels", [(i, i % 2, 0) for i in range(0, 200, 3)], "doc_id long, quality int, toxic int")
    return str(folder)


def same_as_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = Q.QUERIES[name](spark, folder), c.sql(Q.SQL[name])
    return plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_claims_after_abbreviations(spark, small):
    assert same_as_sql(spark, small, "claims_split")


@pytest.mark.parametrize("name", ["qrels_containment", "eval_coverage"])
def test_containment_keeps_letters_apart(spark, small, name):
    assert same_as_sql(spark, small, name)


@pytest.mark.parametrize("common", [0, 1024])
def test_batch_scores_are_those_of_an_index(spark, small, monkeypatch, common):
    from lakeloom.operators import batch, bm25

    monkeypatch.setattr(batch, "MOST_COMMON", common)
    monkeypatch.setattr(batch, "BLOCK_TERMS", 8)  # several blocks of queries
    monkeypatch.setattr(batch, "BLOCK_PAIRS", 64)
    docs, items = Q._titled(spark, small), Q._items(spark, small).where("question <> ''")
    options = dict(text=Q._body(), title=Q._title())
    rows = lambda frame: sorted(map(tuple, frame.select("query_id", "doc_id", "rank", "score").collect()))
    assert rows(batch.search(docs, items, 7, **options)) == rows(bm25.search(bm25.build(docs, **options), items, 7))
    assert rows(batch.late_title_search(docs, items, 7, **options)) == rows(bm25.late_title_search(bm25.build(docs, **options), items, 7))


@pytest.mark.parametrize("name", ["bm25_section_boost", "bm25_matched_terms", "rerank_evaluation"])
def test_batch_queries_on_odd_texts(spark, small, name):
    assert same_as_sql(spark, small, name)


def test_no_task_keeps_more_than_k_of_equal_documents(spark):
    from lakeloom.operators import batch

    docs = spark.range(3000).selectExpr("id as doc_id", "'alpha beta' as text").coalesce(1)
    asked = spark.range(40).selectExpr("id as query_id", "'beta gamma' as question")
    found = batch.best(docs, asked, 5)
    assert found.count() <= 40 * 5 * found.rdd.getNumPartitions()
    assert sorted(r.doc_id for r in batch.search(docs, asked, 5).where("query_id = 3").collect()) == [0, 1, 10, 100, 1000]


def test_cells_leave_k_of_each_query_and_task(spark):
    import numpy as np

    from lakeloom.operators import cells, dense

    v = np.random.default_rng(1).normal(size=(600, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<double>").coalesce(1)
    asked = vectors.where("doc_id % 20 = 0").selectExpr("doc_id as query_id", "embedding as vector")
    centres = cells.centres_of(vectors, most=16)
    made = cells.Cells(cells.assigned(vectors, centres), centres)
    made.multiplied = spark.sparkContext.accumulator(0)
    block = asked.toArrow().combine_chunks()
    every = np.ones((len(block), len(centres)), bool)
    rows = made._products(block.column("query_id").combine_chunks(), np.array(block.column("vector").to_pylist()), every, 5, "long")
    assert rows.count() == 5 * len(block)
    plain_rows = lambda f: sorted(map(tuple, f.collect()))
    assert plain_rows(made.search(asked, 5)) == plain_rows(dense.search(vectors, asked, 5).select("query_id", "doc_id", "rank", "score"))


def odd_documents(spark):
    pick = random.Random(5)
    rows = [(i, " ".join(pick.choices(WORDS, k=pick.randint(0, 40))), pick.choice(WORDS) if i % 3 else None) for i in range(300)]
    return spark.createDataFrame([*rows, (300, None, None), (301, "the of", "x"), (302, "zwei " * 3000, "zwei")], "doc_id long, text string, title string").repartition(5)


def test_written_index_has_no_row_for_each_pair(spark, tmp_path, monkeypatch):
    """Words are counted inside their rows, postings travel in blocks, and a search adds up no (query, document) rows; all is as in bm25."""
    from pyspark.sql import functions as F

    from lakeloom.operators import batch, bm25, counts
    from lakeloom.plans import index

    docs = odd_documents(spark)
    asked = spark.createDataFrame([(i, f"{a} {b} {a}") for i, (a, b) in enumerate(zip(WORDS, WORDS[1:], strict=False))] + [(90, ""), (91, None)], "query_id long, question string")
    fresh = bm25.build(docs, title=F.col("title")).persist()
    rows = lambda f: sorted(map(str, f.collect()))
    columns = ["term", "doc_id", "tf", "dl", "df", "n_docs", F.round("avgdl", 9), F.coalesce("in_title", F.lit(False))]
    want, postings = {w: rows(bm25.search(fresh, asked, 7, title_weight=w)) for w in (1.25, 1.0)}, rows(fresh.select(*columns))
    for name in ("build", "search", "contributions"):
        monkeypatch.setattr(bm25, name, None)
    monkeypatch.setattr(counts, "BLOCK", 4)
    monkeypatch.setattr(counts, "STEP_WORDS", 100)
    monkeypatch.setattr(batch, "DEALT_ROWS", 50)
    monkeypatch.setattr(batch, "BUCKET_ROWS", 200)
    monkeypatch.setattr(batch, "BLOCK_PAIRS", 64)
    made = index.build_lexical(docs, f"file://{tmp_path}/index", title="title")
    assert rows(made.select(*columns)) == postings
    assert {w: rows(index.search(made, asked, 7, title_weight=w)) for w in want} == want
    assert not index.search(made, asked.limit(0), 7).count()


def test_segments_have_no_row_for_each_pair(spark, tmp_path, monkeypatch):
    """Changes are counted inside their rows and a search scores postings in buckets of documents: one segment after another equals bm25 over what is left."""
    from pyspark.sql import functions as F

    from lakeloom.operators import batch, bm25, counts
    from lakeloom.plans import segments

    docs = odd_documents(spark)
    asked = spark.createDataFrame([(i, f"{a} {b} {a}") for i, (a, b) in enumerate(zip(WORDS, WORDS[1:], strict=False))] + [(90, ""), (91, None)], "query_id long, question string")
    rows = lambda f: sorted(map(str, f.collect()))
    left = docs.where("doc_id % 11 <> 5")
    want = {k: rows(bm25.search(bm25.build(left, title=F.col("title")), asked, k).select("query_id", "doc_id", "rank", "score")) for k in (2, 400)}
    for name in ("build", "search", "contributions"):
        monkeypatch.setattr(bm25, name, None)
    monkeypatch.setattr(counts, "BLOCK", 4)
    monkeypatch.setattr(batch, "BUCKET_ROWS", 200)
    monkeypatch.setattr(segments, "SEED", 2)
    made = segments.Segments(spark, f"file://{tmp_path}/index")
    made.apply(docs.withColumn("text", F.when(F.col("doc_id") % 7 == 1, "zwei drei").otherwise(F.col("text"))))
    made.apply(docs.where("doc_id % 7 = 1"))
    made.apply(docs.where("doc_id % 11 = 5").withColumn("deleted", F.lit(True)))
    assert {p.name for p in next(x for x in (tmp_path / "index").iterdir() if x.name != "_pointers").iterdir()} == {"terms", "postings", "bounds", "changed", "removed"}
    assert {k: rows(made.search(asked, k)) for k in want} == want
