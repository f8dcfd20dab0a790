"""One entry point: a folder or a corpus is indexed once, then searched and asked."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, chunk, dense, fusion
from ..sources import readers
from ..sources.sinks import empty_files
from . import artifacts, index
from . import search as S
from .runtime import Chat, Run

HAN = "[㐀-鿿]"


def index_folder(spark: SparkSession, folder: str, root: str, size: int = 700, overlap: int = 100) -> dict:
    """Chunks of the folder's md, txt and (where a reader is installed) pdf files, published at root with their postings; counts and empty files."""
    files = readers.text_files(spark, folder).select("doc_id", "path", "text")
    pages = readers.pdf_units(spark, folder)
    made = chunk.chunk(files.select("doc_id", "text"), "units", size, overlap)
    if pages is not None:
        made = made.unionByName(chunk.chunk(pages.select("doc_id", "text"), "units", size, overlap).drop("section").join(pages.select(F.col("doc_id").alias("parent_id"), "section"), "parent_id").select(made.columns))
    staged = artifacts.stage(made, f"{root}/chunks", kind="folder")
    if not staged["n"]:
        raise ValueError(f"{folder}: no text")
    chunks = spark.read.parquet(f"{root}/chunks/{staged['version']}")
    lexical = index.stage_lexical(chunks, f"{root}/lexical", key="chunk_id", tokens=T.tokenize_mixed)
    artifacts.point_all(spark, {f"{root}/lexical": lexical, f"{root}/chunks": staged})
    return {"chunks": staged["n"], "files": files.count(), "empty": [r.path for r in empty_files(files).collect()]}


def search_folder(spark: SparkSession, root: str, question: str, top_k: int = 4) -> DataFrame:
    """chunk_id, parent_id, section, text, rank, score from the written postings: words of the section name raise a chunk's whole score."""
    chunks = artifacts.load(spark, f"{root}/chunks", kind="folder")
    postings = index.open_lexical(spark, f"{root}/lexical", tokens=T.tokenize_mixed.__name__)
    asked = spark.createDataFrame([(0, question)], "query_id long, question string")
    hits = index.section_search(postings, chunks, asked, top_k, "chunk_id", T.tokenize_mixed)
    return hits.join(chunks.select("chunk_id", "parent_id", "section", "text"), "chunk_id").orderBy("rank").drop("query_id")


def ask_folder(spark: SparkSession, root: str, question: str, generate: Callable[[str, str], str], top_k: int = 4, judge=None) -> tuple[str, str]:
    """(state, answer) from the chunks that a question finds."""
    hits = search_folder(spark, root, question, top_k).select(F.lit(0).cast("long").alias("query_id"), F.lit(question).alias("question"), F.col("chunk_id").alias("parent_id"), F.col("rank").alias("parent_rank"), "rank", "chunk_id", "text")
    got = S.ask(spark.createDataFrame([(0, question)], "query_id long, question string"), hits, generate, judge).first()
    return got.state, got.answer


def routed(question: str, retriever: str = "auto") -> str:
    """bm25, dense or hybrid; auto sends Han questions to the dense index and others to both."""
    if retriever not in ("auto", "bm25", "dense", "hybrid"):
        raise ValueError("retriever is auto, bm25, dense or hybrid")
    return retriever if retriever != "auto" else "dense" if re.search(HAN, question) else "hybrid"


def translated(question: str, chat: Chat) -> str:
    """A Han or mixed question as one English query; others as they are. An unusable answer is an error."""
    if not re.search(HAN, question):
        return question
    told = (
        "Turn the question into one short English query for titles and abstracts of papers. Keep technical terms, names, numbers, negations and "
        "comparisons. Answer with the query only."
    )
    said = " ".join(chat([{"role": "system", "content": told}, {"role": "user", "content": question}], max_tokens=256, stage="translate").strip().strip('"“”').split())
    if not re.search("[A-Za-z]", said):
        raise RuntimeError("the model gave no usable English query")
    return said


class Library:
    """A corpus of parents and chunks with its indexes, opened once in a session.

    root: parents (doc_id, title, text, ...), chunks, lexical and dense are artifacts below it. embed, score and chat are the caller's
    models; without embed there is no dense channel.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[list[str]], object] | None = None, scorer=None, chat: Callable | None = None):
        self.spark, self.root, self.embed, self.scorer, self.chat = spark, root, embed, scorer, chat
        self.session = index.Session(spark)

    def prepare(self, parents: DataFrame, style: str = "legacy", **options) -> None:
        """Publishes parents, chunks and indexes together: all become current, or none."""
        named = parents.withColumn("doc_id", F.col("doc_id").cast("string"))
        staged = artifacts.stage(named, f"{self.root}/parents", kind="parents")
        fixed = self.spark.read.parquet(f"{self.root}/parents/{staged['version']}")
        made = artifacts.stage(chunk.chunk(fixed, style, **options), f"{self.root}/chunks", kind="chunks", style=style, parents_x=staged["x"])
        chunks = self.spark.read.parquet(f"{self.root}/chunks/{made['version']}")
        parts = {"parents": staged, "chunks": made, "lexical": index.stage_lexical(chunks, f"{self.root}/lexical", key="chunk_id", title="title")}
        if self.embed is not None:
            parts["dense"] = index.stage_dense(chunks, f"{self.root}/dense", self.embed, key="chunk_id")
        artifacts.point_all(self.spark, {f"{self.root}/{name}": facts for name, facts in parts.items()})

    def chunks(self) -> DataFrame:
        return self.session.get(f"{self.root}/chunks")

    def validate(self) -> DataFrame:
        return index.validate(self.spark, self.chunks(), f"{self.root}/lexical", f"{self.root}/dense" if self.embed else None, "chunk_id", title="title")

    def rank(self, queries: DataFrame, retriever: str = "hybrid", candidate_k: int = 100, run: Run | None = None) -> DataFrame:
        """(query_id, chunk_id, rank, score) of a batch of queries (query_id, question)."""
        if retriever == "bm25":
            return index.search(self.session.get(f"{self.root}/lexical"), queries, candidate_k, "chunk_id").select("query_id", "chunk_id", "rank", "score")
        vectors = None if self.embed is None else self.session.get(f"{self.root}/dense")
        if vectors is not None:
            queries = dense.embed(queries, self.embed, "question").withColumnRenamed("embedding", "vector")
        if retriever == "dense":
            if vectors is None:
                raise ValueError("there is no dense index")
            return dense.search(vectors, queries, candidate_k, "chunk_id").select("query_id", "chunk_id", "rank", "score")
        postings = index.terms_only(self.session.get(f"{self.root}/lexical"), bm25.query_terms(queries))
        return S.hybrid(postings, vectors, queries, candidate_k, run=run, key="chunk_id")

    def search(self, question: str, retriever: str = "auto", pipeline: str = "classic", top_k: int = 5, candidate_k: int = 100, rerank_k: int = 0, planner=None, run: Run | None = None, translate: bool = False) -> DataFrame:
        """query_id, question, parent_id, parent_rank, retrieval_score, rank, chunk_id, text of the first top_k parents' matched chunks."""
        if pipeline not in ("classic", "agentic") or top_k < 1 or candidate_k < top_k:
            raise ValueError("pipeline is classic or agentic, and candidate_k at least top_k")
        run, way = run or Run(), routed(question, retriever)
        if pipeline == "agentic" and way != "hybrid":
            raise ValueError("the agentic pipeline needs the hybrid retriever")
        asked = translated(question, Chat(self.chat, run)) if translate and self.chat is not None else question
        questions = self.spark.createDataFrame([(0, asked)], "query_id long, question string")
        with run.stage("retrieve"):
            if pipeline == "agentic":
                hits = S.agentic(questions, planner, lambda q: self.rank(q, "hybrid", candidate_k, run), run, k=2 * candidate_k, key="chunk_id")
            else:
                hits = self.rank(questions, way, candidate_k, run)
        texts = self.chunks().select("chunk_id", "parent_id", "text")
        rows = hits.select("query_id", "chunk_id", "rank", "score").join(texts, "chunk_id").withColumn("question", F.lit(question))
        if rerank_k and self.scorer is not None:
            with run.stage("rerank"):
                try:
                    ranked = fusion.rerank(rows.withColumnRenamed("text", "passage"), self.scorer, rerank_k, key="chunk_id")
                    again = ranked.withColumns({"rank": F.col("new_rank"), "text": F.col("passage")}).drop("new_rank", "passage")
                    path = artifacts.scratch(self.spark)
                    again.write.parquet(path)  # the model runs here, once, and fails here if it does
                    rows = self.spark.read.schema(again.schema).parquet(path)
                except Exception as e:
                    run.give_way("reranker", OSError(type(e).__name__) if isinstance(e, PySparkException) else e)
        best = fusion.parents(rows).where(F.col("parent_rank") <= top_k).select("query_id", "parent_id", "parent_rank", "retrieval_score")
        return rows.join(best, ["query_id", "parent_id"]).select("query_id", "question", "parent_id", "parent_rank", "retrieval_score", "rank", "chunk_id", "text")

    def ask(self, question: str, generate: Callable[[str, str], str], judge=None, revise=None, run: Run | None = None, max_chars: int = 12000, per_parent: int = 2, **options) -> dict:
        """state and answer, verified claim by claim or refused; a failure after retrieval is a state, not an end."""
        run = run or Run()
        hits = self.search(question, run=run, **options)
        asked = self.spark.createDataFrame([(0, question)], "query_id long, question string")
        got = S.ask(asked, hits, generate, judge, revise, run, max_chars, per_parent).first()
        return {"question": question, "state": got.state, "answer": got.answer, "fallbacks": run.fallbacks, "spans": run.spans, "calls": run.calls}
