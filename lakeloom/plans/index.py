"""Persisted lexical and dense indexes, bound to the corpus that they were built from.

An index is an artifact whose facts hold the fingerprint of its corpus. Opening one checks the facts and,
against a corpus at hand, the fingerprint; a stale or corrupt index is an error or, with ensure(), built anew.
Postings lie in files by ranges of terms, sorted by term, so that a batch of queries reads the row groups of its
terms only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch, bm25, counts, dense
from . import artifacts

#: Distinct query terms up to which they are pushed into the scan as a list; more are joined.
PUSHED_TERMS = 2000


def corpus_facts(docs: DataFrame, key: str, *columns: str) -> dict:
    """What an index remembers of its corpus."""
    row = artifacts.fingerprint(docs.select(key, *columns)).first()
    return {"corpus_n": row.n, "corpus_x": row.x, "corpus_s": row.s}


def contiguous(rows: DataFrame, key: str, first: int = 0) -> bool:
    """Whether the key runs from `first` without gaps or repeats."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    return r.n == 0 or (r.lo == first and r.hi == first + r.n - 1 and r.d == r.n)


def stage_lexical(docs: DataFrame, root: str, scope: str = "full_text_chunk", key: str = "doc_id", text: str = "text", title: str | None = None, tokens=bm25.tokenize) -> dict:
    """Writes the postings of docs, which nobody reads until the facts that are returned are pointed to."""
    columns = [text] if title is None else [text, title]
    counted = artifacts.settled(counts.by_document(docs, key, F.col(text), None if title is None else F.col(title), tokens))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("average")).first()
    average = stats.average or 1.0
    df = counted.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    blocks = counts.by_term(counted, key).drop("layer").join(df, "term")
    rows = counts.laid_out(blocks, key).select("term", key, "tf", "dl", "in_title", "df", F.lit(stats.n).cast("long").alias("n_docs"), F.lit(average).alias("avgdl"))
    facts = dict(kind="lexical", format=1, scope=scope, key=key, tokens=tokens.__name__, documents=stats.n, k1=bm25.K1, b=bm25.B, avg_length=average)
    return artifacts.stage(rows, root, **facts, **corpus_facts(docs, key, *columns))


def build_lexical(docs: DataFrame, root: str, scope: str = "full_text_chunk", key: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """Publishes the postings of docs and opens them."""
    artifacts.point(docs.sparkSession, root, stage_lexical(docs, root, scope, key, text, title))
    return open_lexical(docs.sparkSession, root)


def open_lexical(spark: SparkSession, root: str, docs: DataFrame | None = None, verify: bool = False, text: str = "text", title: str | None = None, **expected) -> DataFrame:
    """The postings; facts that make no sense, other facts than expected or another corpus are errors."""
    _, facts = artifacts.manifest(spark, root)
    if facts.get("kind") != "lexical" or not artifacts.valid_index_facts(facts):
        raise ValueError(f"{root}: not a valid lexical index")
    if docs is not None:
        expected |= corpus_facts(docs, facts["key"], *([text] if title is None else [text, title]))
    return artifacts.load(spark, root, verify, **expected)


def stage_dense(docs: DataFrame, root: str, embedder=None, model: str = "", snapshot: str = "", key: str = "doc_id", text: str = "text") -> dict:
    """Writes one unit vector a document, each beside the hash of its text, which nobody reads yet. docs has an embedding column, or embedder makes it."""
    rows = docs if embedder is None else dense.embed(docs, embedder, text)
    made = rows.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"), dense.normalise(F.col("embedding")).alias("embedding"))
    spark = docs.sparkSession
    staged = artifacts.stage(made, root, kind="dense", format=1, key=key, model=model, snapshot=snapshot, **corpus_facts(docs, key, text))
    sizes = spark.read.parquet(f"{root}/{staged['version']}").agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"), F.count_if(F.col("embedding").isNull()).alias("none")).first()
    if sizes.none or sizes.lo != sizes.hi:
        raise ValueError("vectors are missing, not finite, zero or of several dimensions")
    return staged | {"dimension": sizes.hi}


def build_dense(docs: DataFrame, root: str, embedder=None, model: str = "", snapshot: str = "", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Publishes the vectors of docs and opens them."""
    artifacts.point(docs.sparkSession, root, stage_dense(docs, root, embedder, model, snapshot, key, text))
    return open_dense(docs.sparkSession, root)


def open_dense(spark: SparkSession, root: str, docs: DataFrame | None = None, verify: bool = False, text: str = "text", **identity) -> DataFrame:
    """The vectors; identity (model, snapshot, dimension) must match the index, and with docs each row must belong to its text."""
    _, facts = artifacts.manifest(spark, root)
    if facts.get("kind") != "dense":
        raise ValueError(f"{root}: not a dense index")
    vectors = artifacts.load(spark, root, verify, **identity)
    if docs is not None:
        wrong = binding(vectors, docs, facts["key"], text).first()
        if any(wrong):
            raise ValueError(f"{root}: {wrong.asDict()}")
    return vectors


def binding(vectors: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: documents without a vector, vectors without a document, repeated keys, vectors of another text. All are 0 for a bound index."""
    own = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("v"), F.first("text_sha256").alias("had"))
    all_docs = docs.groupBy(key).agg(F.count(F.lit(1)).alias("d"), F.first(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("has"))
    both = own.join(all_docs, key, "full")
    return both.agg(
        F.count_if(F.col("v").isNull()).alias("without_vector"), F.count_if(F.col("d").isNull()).alias("without_document"),
        F.count_if((F.coalesce("v", F.lit(1)) > 1) | (F.coalesce("d", F.lit(1)) > 1)).alias("repeated"), F.count_if(F.col("had") != F.col("has")).alias("other_text"),
    )


def validate(spark: SparkSession, docs: DataFrame, lexical: str, dense_root: str | None = None, key: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """(check, ok, detail) of a corpus and its indexes; nothing is rebuilt."""
    rows: list[tuple[str, bool, str]] = []

    def note(name: str, test) -> None:
        try:
            detail = test()
            rows.append((name, not detail, str(detail or "")))
        except Exception as e:
            rows.append((name, False, f"{type(e).__name__}: {e}"[:300]))

    note("corpus: keys are unique", lambda: docs.groupBy(key).count().where("count > 1").count())
    note("lexical: facts and corpus", lambda: open_lexical(spark, lexical, docs, text=text, title=title) and None)
    note("lexical: rows", lambda: artifacts.load(spark, lexical, verify=True) and None)
    note("lexical: documents", lambda: artifacts.load(spark, lexical).select(key).distinct().join(docs, key, "left_anti").count())
    if dense_root is not None:
        note("dense: rows", lambda: artifacts.load(spark, dense_root, verify=True) and None)
        note("dense: each vector belongs to its text", lambda: {k: v for k, v in binding(artifacts.load(spark, dense_root), docs, key, text).first().asDict().items() if v})
        norm = F.sqrt(dense.inner_product(F.col("embedding"), F.col("embedding")))
        note("dense: unit norm", lambda: artifacts.load(spark, dense_root).where(norm.isNull() | F.isnan(norm) | (F.abs(norm - 1) > 1e-3)).count())
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")


def ensure_lexical(docs: DataFrame, root: str, text: str = "text", title: str | None = None, key: str = "doc_id", scope: str = "full_text_chunk") -> tuple[DataFrame, bool]:
    """(postings, whether they were built now): the index at root if it belongs to docs and is whole, else a new one."""
    try:
        return open_lexical(docs.sparkSession, root, docs, True, text, title, scope=scope), False
    except (ValueError, FileNotFoundError):
        return build_lexical(docs, root, scope, key, text, title), True


def terms_only(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of a batch's terms: few terms go into the scan as a list, more are left to the join."""
    few = [r.term for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    return postings.where(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else postings


def section_search(postings: DataFrame, sections: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", tokens=bm25.tokenize) -> DataFrame:
    """bm25.section_search() over a written index; sections: key, section."""
    return bm25.section_ranked(terms_only(postings, bm25.query_terms(queries, tokens)), sections, queries, k, key, tokens)


def search(postings: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", title_weight: float | Column = bm25.TITLE_WEIGHT) -> DataFrame:
    """bm25.search() over a written index; no row for each pair of query and document, unless the weight of title words is a column."""
    rows = terms_only(postings, bm25.query_terms(queries))
    return bm25.search(rows, queries, k, key, title_weight) if isinstance(title_weight, Column) else batch.search_postings(rows, queries, k, key, title_weight)


def migrate_vectors(rows: DataFrame, root: str, dimension: int, model: str, snapshot: str = "", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Legacy vectors (key, text, embedding), checked for dimension, finite values and norm, as a dense index."""
    from ..sources.readers import unit_vectors

    return build_dense(unit_vectors(rows, dimension), root, None, model, snapshot, key, text)


@dataclass
class Session:
    """Indexes that are open in this session, by root and version: a new version is opened anew, the old one is given up."""

    spark: SparkSession
    _open: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)

    def get(self, root: str, warm: bool = False) -> DataFrame:
        """The index at root; warm keeps it in the executors' memory, or on their disks where memory is short."""
        version, _ = artifacts.manifest(self.spark, root)
        if root not in self._open or self._open[root][0] != version:
            self.drop(root)
            frame = artifacts.load(self.spark, root)
            self._open[root] = (version, frame.persist() if warm else frame)
        return self._open[root][1]

    def drop(self, root: str) -> None:
        if root in self._open:
            self._open.pop(root)[1].unpersist()
