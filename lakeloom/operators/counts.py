"""Counted words of documents: one pass over the texts, without a shuffle, and the same laid out by term in blocks.

A document's words are counted inside its row. By term they travel as blocks of up to BLOCK postings, so that what is shuffled
for an index is a few bytes a posting and not a row for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bm25 import B, K1, tokenize

#: Words that a task works on at once, postings of a block.
STEP_WORDS, BLOCK = 1 << 21, 1024


def steps(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to `most`, or single rows above it."""
    end, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def listed(to: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), values)


def sizes_of(column: pa.Array) -> np.ndarray:
    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _by_document(key: str):
    """key, w, tw (words of text, title) -> key, dl, words (all different), tfs, titled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in steps(sizes_of(batch.column("w")), STEP_WORDS):
                part, n = batch.slice(i, j - i), j - i
                dl, coded = sizes_of(part.column("w")), part.column("w").flatten().dictionary_encode()
                v = max(1, len(coded.dictionary))
                pairs, tf = np.unique(np.repeat(np.arange(n), dl) * v + coded.indices.to_numpy(), return_counts=True)
                at = pc.fill_null(pc.index_in(part.column("tw").flatten(), value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                titled = np.isin(pairs, (np.repeat(np.arange(n), sizes_of(part.column("tw"))) * v + at)[at >= 0])
                to = np.searchsorted(pairs, np.arange(n + 1) * v)
                lists = (coded.dictionary.take(pa.array(pairs % v)), pa.array(tf.astype(np.int32)), pa.array(titled))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(dl), *(listed(to, x) for x in lists)], [key, "dl", "words", "tfs", "titled"])

    return run


def by_document(docs: DataFrame, key: str = "doc_id", text: Column | None = None, title: Column | None = None, tokens=tokenize) -> DataFrame:
    """(key, dl, words, tfs, titled): one row a document, arrays of its different words with their counts."""
    none = F.array().cast("array<string>")
    title_words = none if title is None else F.coalesce(F.array_distinct(tokens(title)), none)
    words = docs.select(key, tokens(F.concat_ws(" ", F.lit("") if title is None else title, F.col("text") if text is None else text)).alias("w"), title_words.alias("tw"))
    return words.mapInArrow(_by_document(key), f"{key} {docs.schema[key].dataType.simpleString()}, dl long, words array<string>, tfs array<int>, titled array<boolean>")


def _by_term(key: str, layers: int, average: float, plain: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in steps(sizes_of(batch.column("words")), STEP_WORDS):
                part = batch.slice(i, j - i)
                coded = part.column("words").flatten().dictionary_encode()
                if not len(coded):
                    continue
                v, doc = len(coded.dictionary), np.repeat(np.arange(j - i), sizes_of(part.column("words")))
                tf, titled = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("tfs", "titled"))
                dl = part.column("dl").to_numpy()[doc]
                weight = tf / (tf + K1 * (1 - B + B * dl / average)) * np.where(titled, 1.0, plain)
                layer = np.minimum(np.floor((1 - weight) * layers), layers - 1).astype(np.int64)
                group = layer * v + coded.indices.to_numpy()
                order = np.argsort(group, kind="stable")
                group = group[order]
                new = np.concatenate(([True], group[1:] != group[:-1]))
                place = np.arange(len(group))
                first = np.flatnonzero(new | ((place - np.maximum.accumulate(np.where(new, place, 0))) % BLOCK == 0))
                to = np.append(first, len(group))
                lists = (part.column(key).take(pa.array(doc[order])), pa.array(tf[order]), pa.array(dl[order]), pa.array(titled[order]))
                terms = coded.dictionary.take(pa.array(group[first] % v))
                yield pa.RecordBatch.from_arrays([pa.array((group[first] // v).astype(np.int32)), terms, *(listed(to, x) for x in lists)], ["layer", "term", "keys", "tfs", "dls", "titled"])

    return run


def by_term(counted: DataFrame, key: str = "doc_id", layers: int = 1, average: float = 1.0, plain: float = 1.0) -> DataFrame:
    """(layer, term, keys, tfs, dls, titled) from by_document(): blocks of postings; layer 0 has those of greatest weight, `plain` is that of words outside titles."""
    kind = counted.schema[key].dataType.simpleString()
    return counted.mapInArrow(_by_term(key, layers, average, plain), f"layer int, term string, keys array<{kind}>, tfs array<int>, dls array<long>, titled array<boolean>")


def laid_out(blocks: DataFrame, key: str, *first: str) -> DataFrame:
    """(term, key, tf, dl, in_title, more columns of blocks), in files by ranges of first, term and key; blocks are sorted, not their rows."""
    ranged = blocks.withColumn("_at", F.col("keys")[0])
    ranged = ranged.repartitionByRange(*first, "term", "_at").sortWithinPartitions(*first, "term", "_at")
    more = [c for c in blocks.columns if c not in ("term", "keys", "tfs", "dls", "titled")]
    rows = ranged.select("term", F.inline(F.arrays_zip("keys", "tfs", "dls", "titled")), *more)
    return rows.select("term", F.col("keys").alias(key), F.col("tfs").cast("long").alias("tf"), F.col("dls").alias("dl"), F.col("titled").alias("in_title"), *more)


def term_rows(counted: DataFrame, *more: str) -> DataFrame:
    """One row for each document and word: term, tf, in_title, dl and more columns of by_document()."""
    rows = counted.select(*more, "dl", F.inline(F.arrays_zip("words", "tfs", "titled")))
    return rows.select(*more, F.col("words").alias("term"), F.col("tfs").cast("long").alias("tf"), "dl", F.col("titled").alias("in_title"))
