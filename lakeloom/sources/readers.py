"""Sources: documents, papers, feeds and reports as DataFrames, with checks that fail closed."""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from .datasource import register

PAPER = "paper_id string, title string, abstract string, source_url string, evidence_scope string, published_at string, year int, doi string, primary_category string, categories array<string>, authors array<string>, pdf_url string"
PARENT = "paper_id string, corpusid string, title string, abstract string, full_text string, full_paper string, source_url string, evidence_scope string"


def require(frame: DataFrame, key: str, *fields: str) -> DataFrame:
    """The frame, after one aggregation found no row without a field and one found no repeated key; an empty frame is an error.

    The error names the first row at fault in order of the key, and its file where one was read.
    """
    blank = F.exists(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *fields))), lambda x: F.trim(x) == "")
    bad = frame.agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("blank")).first()
    if not bad.n:
        raise ValueError("no rows")
    if bad.blank:
        worst = frame.where(blank).select(F.col(key).cast("string").alias("k"), F.input_file_name().alias("f")).orderBy("k").first()
        raise ValueError(f"{bad.blank} rows lack one of {(key, *fields)}, the first {key} {worst.k!r} in {worst.f or 'memory'}")
    twice = frame.groupBy(key).count().where("count > 1").orderBy(key).first()
    if twice is not None:
        raise ValueError(f"repeated {key}: {twice[0]!r}")
    return frame


def papers(spark: SparkSession, path: str) -> DataFrame:
    """JSONL papers; id, address and scope are required and ids are unique."""
    rows = spark.read.schema(PAPER).json(path)
    return require(rows, "paper_id", "source_url", "evidence_scope")


def parents(spark: SparkSession, path: str, default_url: str = "") -> DataFrame:
    """JSONL documents with their field aliases merged; rows without an address get default_url, the address of their data set."""
    rows = spark.read.schema(PARENT).json(path)
    empty = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    out = rows.withColumns({"paper_id": F.coalesce(empty("paper_id"), empty("corpusid")), "full_text": F.coalesce(empty("full_text"), empty("full_paper")), "source_url": F.coalesce("source_url", F.lit(default_url))})
    return require(out.drop("full_paper"), "paper_id", "full_text").withColumns({"parent_id": F.col("paper_id"), "doc_type": F.lit("parent")})


def shards(spark: SparkSession, paths: str | list[str], limit: int | None = None) -> DataFrame:
    """Parquet shards: only id and nested text are read; rows without text go, a repeated id is an error."""
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    names = set(rows.columns)
    text = [F.nullif(F.col(c), F.lit("")) for c, top in (("content.text", "content"), ("full_paper", "full_paper")) if top in names]
    out = rows.select(F.col("corpusid").cast("string").alias("paper_id"), F.coalesce(*text, F.lit("")).alias("full_text")).where("full_text <> ''")
    return require(out if limit is None else out.limit(limit), "paper_id")


def with_metadata(texts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join of title and abstract, blanks where unknown."""
    return texts.join(metadata.select("paper_id", "title", "abstract"), "paper_id", "left").fillna("", ["title", "abstract"])


def pilot(rows: DataFrame, gold: DataFrame, key: str, order: str, n_gold: int = 50, n: int = 100) -> DataFrame:
    """Up to n_gold gold rows in query order, then other rows in their order up to n."""
    first = rows.join(gold.groupBy(key).agg(F.min("query_order").alias("_o")), key).orderBy("_o", key).limit(n_gold).withColumn("_g", F.lit(0))
    rest = rows.join(gold, key, "left_anti").withColumn("_o", F.col(order)).orderBy(order).limit(n).withColumn("_g", F.lit(1))
    return first.unionByName(rest).orderBy("_g", "_o").limit(n).drop("_g", "_o")


def benchmark_papers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers with collapsed title and abstract, and one row that counts empty titles, empty abstracts and rows without either."""
    out = rows.withColumns({c: collapse(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "abstract")})
    bare = {c: F.col(c) == "" for c in ("title", "abstract")}
    return out, out.agg(F.count_if(bare["title"]).alias("empty_title"), F.count_if(bare["abstract"]).alias("empty_abstract"), F.count_if(bare["title"] & bare["abstract"]).alias("empty_both"))


def benchmark_queries(rows: DataFrame, corpus: DataFrame, prefix: str = "query") -> tuple[DataFrame, DataFrame]:
    """Queries renumbered <prefix>_001.. by position, and gold ids that the corpus lacks (should be empty). rows: question, gold_paper_ids, position (unique).

    A query's number is one more than the queries before it: counts by ranges of positions are added up, so no task sees all of them.
    """
    block = F.floor(F.col("position") / 4096)
    counts = rows.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    begin = counts.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("begin"))  # one row a block
    nth = F.row_number().over(Window.partitionBy("block").orderBy("position")) + F.col("begin")
    queries = rows.withColumn("block", block).join(begin, "block").select(F.format_string(f"{prefix}_%03d", nth).alias("id"), collapse(F.col("question")).alias("question"), "gold_paper_ids")
    missing = queries.select(F.explode("gold_paper_ids").alias("paper_id")).distinct().join(corpus.select("paper_id"), "paper_id", "left_anti")
    return queries, missing


def atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files: id and version split, the first entry of an id (by file, then by place in it) wins, then entries without title or abstract go."""
    rows = register(spark).read.format("atom_feed").load(path).where("fault is null")
    return papers_of_entries(rows)


def papers_of_entries(rows: DataFrame) -> DataFrame:
    """Papers from the rows of the format atom_feed."""
    full = F.regexp_extract("id", r"arxiv\.org/abs/(.+?)(?:v\d+)?$", 1)
    named = rows.withColumns({"paper_id": full, "version": F.regexp_extract("id", r"(v\d+)$", 1)}).where("paper_id <> ''")
    whole = F.struct(*(F.col(c) for c in named.columns))
    first = named.groupBy("paper_id").agg(F.min_by(whole, F.struct("file", "place")).alias("e")).select("e.*")
    out = first.select("paper_id", "version", collapse(F.col("title")).alias("title"), collapse(F.col("summary")).alias("abstract"), F.transform("author", lambda a: collapse(a)).alias("authors"), "published", F.substring("published", 1, 4).cast("int").alias("year"), F.col("id").alias("source_url"))
    return out.where("title <> '' and abstract <> ''")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text) of md and txt files below a directory; 16 hex digits of the path name a document."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt}").load(path)
    text = F.regexp_replace(F.decode("content", "utf-8"), "^﻿", "")
    return rows.select(F.substring(F.sha2("path", 256), 1, 16).alias("doc_id"), "path", text.alias("text"))


def pdf_units(spark: SparkSession, path: str) -> DataFrame | None:
    """(doc_id, path, section, text) of the pages of pdf files, section "第 n 页"; null where no pdf reader is installed."""
    if importlib.util.find_spec("pypdf") is None:
        return None
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pypdf import PdfReader

        for pdf in frames:
            pages = [(p, n, page.extract_text() or "") for p, content in zip(pdf["path"], pdf["content"], strict=True) for n, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]
            yield pd.DataFrame([(p, f"第 {n} 页", t) for p, n, t in pages if t.strip()], columns=["path", "section", "text"])

    units = rows.select("path", "content").mapInPandas(run, "path string, section string, text string")
    return units.select(F.substring(F.sha2(F.concat_ws("\0", "path", "section"), 256), 1, 16).alias("doc_id"), "path", "section", "text")


def reports(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(valid reports, paths of invalid files): a broken file is noted, not fatal."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    parsed = files.select("path", F.from_json(F.regexp_replace("value", "^\ufeff", ""), f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    return parsed.where(good).select("path", "r.*").drop("_corrupt"), parsed.where(~good).select("path")


def by_ids(rows: DataFrame, ids: list[str], key: str) -> DataFrame:
    """Point lookups of a stated list of ids."""
    return rows.where(F.col(key).isin(ids)) if len(ids) <= 400 else rows.join(rows.sparkSession.createDataFrame([(x,) for x in ids], f"{key} string"), key, "left_semi")


def unit_vectors(rows: DataFrame, dimension: int) -> DataFrame:
    """Legacy vectors after checks of dimension, finite values and unit norm (to 1e-3)."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bad = rows.where((F.size("embedding") != dimension) | F.isnan(norm) | (F.abs(norm - 1) > 1e-3))
    if not bad.isEmpty():
        raise ValueError("a vector has the wrong dimension or norm")
    return rows


def paper_chunks(chunks: DataFrame, parent_id: str) -> DataFrame:
    """One paper's chunks in reading order."""
    return chunks.where(F.col("parent_id") == parent_id).orderBy("chunk_index", "chunk_id")


def probes(questions: DataFrame, translations: dict[str, str]) -> DataFrame:
    """Questions under their translations, ids suffixed _zh; a question without one is an error."""
    rows = questions.sparkSession.createDataFrame(list(translations.items()), "id string, translated string")
    joined = questions.join(rows, "id")
    if joined.count() != questions.count() or len(translations) != questions.count():
        raise ValueError("questions and translations differ")
    return joined.withColumns({"id": F.concat("id", F.lit("_zh")), "question": F.col("translated")}).drop("translated")
