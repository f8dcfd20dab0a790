"""Operator 4: removal of repeated line runs by a suffix array over line ids, built by distributed prefix doubling.

A document is a sequence of lines, and each line begins a suffix. The suffixes of all documents are
ranked together: first by their first line, whose rank is the place (doc_id, row key, line) of the
line's first copy; then by the pair of the ranks at a suffix and as many lines on as the ranks already
reach, whose rank is again the place of the pair's first copy. So ranks of depth 1, 2, 4, ... name the
same prefixes in the same order everywhere (the last step overlaps when the least run is no power of
two). A suffix that is alone in its bucket has no longer common prefix with any other and leaves, and so
do its later pairs: only repeated suffixes are shuffled after the first round, never the text.

At the depth of the least run, a bucket is an interval of the suffix array whose longest common prefix
is at least that. Its suffixes but the first are later copies; touching ones form the maximal runs that
are deleted. Deeper rounds could only split the intervals: every window of a longer repeated run is
itself in an interval of this depth, so the union of the deleted windows is the same. Lines of an
interval's first suffix stay, even where a later copy of another run (or of itself) overlaps
them: every repeated run stands somewhere whole.

With `alone`, a single line of at least so many words is a run too: intervals of depth one whose line has
as many words are added, by the same rule. The pipeline, op4_line_dedup and its SQL do so with ALONE_WORDS.

Lines are told apart by 128 bits of two independent digests, longer prefixes by places, which do not collide.

Defined results: a null text is an empty one and stays null; lines are split at \n only and blank
lines are lines; a null id orders first; rows alike in id and text are one document (both get its
result); an empty table gives no rows; other columns are kept by deduplicated() and ignored else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernels as K
from .lineage import fresh_names, written

#: Production parameter: lines that a repeated run has at least.
LEAST_LINES = 2
#: Production parameter: words of a line that is a run by itself.
ALONE_WORDS = 5

def line_spans(data: np.ndarray, offsets: np.ndarray):
    """(start, end, first): byte spans of the lines of all texts, and the number of lines before each text."""
    breaks = np.flatnonzero(data == 10)
    first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    opens, closes = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    opens[first[:-1]] = True
    closes[first[1:] - 1] = True
    start, end = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    start[opens], start[~opens] = offsets[:-1], breaks + 1
    end[closes], end[~closes] = offsets[1:], breaks
    return start, end, first


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, did, text -> rid, did, pos, words, h1, h2 of every line."""
    for batch in batches:
        data, offsets = K.flat(batch.column("text"))
        rid, did = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "did"))
        for i, j in K.chunks(offsets):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            start, end, first = line_spans(part, own)
            begins = K.words(part, own)[0]
            doc = np.repeat(np.arange(j - i), np.diff(first))
            hashes = [K.digests(part, start, end, seed).view(np.int64) for seed in (1, 2)]
            words = np.searchsorted(begins, end) - np.searchsorted(begins, start)
            columns = [rid[i:j][doc], did[i:j][doc], (np.arange(len(doc)) - first[doc]).astype(np.int32), words.astype(np.int32), *hashes]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["rid", "did", "pos", "words", "h1", "h2"])


def _ranked(suffixes: DataFrame, *key: str) -> DataFrame:
    """The suffixes (rid, did, pos, words, key) whose key repeats, ranked by the place of its first copy (written, so that a hot key's join can be split)."""
    place = F.struct("did", "rid", "pos")
    firsts = suffixes.groupBy(*key).agg(F.min(place).alias("place"), F.max(place).alias("last")).where("place <> last").drop("last")
    return suffixes.join(written(firsts), [*key]).select("rid", "did", "pos", "words", F.col("place").alias("rank"))


def _doubled(suffixes: DataFrame, step: int) -> DataFrame:
    """Ranks of depth d to ranks of depth d + step (step at most d)."""
    later = suffixes.select("rid", "did", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next")).dropDuplicates(["rid", "did", "pos"])
    return _ranked(suffixes.join(later, ["rid", "did", "pos"]), "rank", "next")


def intervals(rows: DataFrame, least: int, alone: int | None = None) -> DataFrame:
    """did, rid, pos, lines, rank of the suffixes in intervals of at least `least` common lines, and of those of one line with `alone` words.

    rows: rid, did, text. rank is the place of the interval's first suffix.
    """
    lines = rows.mapInArrow(_lines, "rid long, did long, pos int, words int, h1 long, h2 long")
    single = suffixes = written(_ranked(lines, "h1", "h2"))
    depth = 1
    while depth < least:
        step = min(depth, least - depth)
        suffixes, depth = _doubled(suffixes, step), depth + step
        suffixes = written(suffixes) if depth < least else suffixes
    found = suffixes.select("did", "rid", "pos", F.lit(least).alias("lines"), "rank")
    if alone is not None and least > 1:
        found = found.unionByName(single.where(F.col("words") >= alone).select("did", "rid", "pos", F.lit(1).alias("lines"), "rank"))
    return found


def _removed(keyed: DataFrame, rid: str, did: str, gone: str, least: int, alone: int | None) -> DataFrame:
    """rid and gone: windows of intervals that the row begins, later copies and first ones."""
    rows = keyed.select(F.col(rid).alias("rid"), F.col(did).alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    later = F.struct("did", "rid", "pos") != F.struct(F.col("rank.did"), F.col("rank.rid"), F.col("rank.pos"))
    found = intervals(rows, least, alone).select("rid", F.struct("did", "pos", "lines", later.alias("later")).alias("w"))
    return found.groupBy(F.col("rid").alias(rid)).agg(F.collect_set("w").alias(gone)).where(F.exists(gone, lambda x: x["later"]))


def deduplicated(docs: DataFrame, least: int = LEAST_LINES, alone: int | None = None) -> DataFrame:
    """The rows of docs, all columns, with later copies of repeated line runs, and of single lines of `alone` words or more, cut from text (n_chars follows if present).

    Three columns are added: n_lines, n_removed and n_runs; a column of docs with such a name gives way.
    """
    docs = docs.drop("n_lines", "n_removed", "n_runs")
    rid, did, gone_name = fresh_names(docs, "rid", "did", "gone")
    keyed = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), rid: F.xxhash64("doc_id", "text")})
    dealt = keyed.repartition(rid).join(_removed(keyed, rid, did, gone_name, least, alone), rid, "left")
    out = StructType(list(docs.schema.fields))
    for name in ("n_lines", "n_removed", "n_runs"):
        out = out.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dids, gone = batch.column("text").to_pylist(), batch.column(did).to_pylist(), batch.column(gone_name).to_pylist()
            counts = []
            for k, text in enumerate(texts):
                lines = (text or "").split("\n")
                drop, first = (
                    {p for x in gone[k] or () if x["did"] == dids[k] and x["later"] is later for p in range(x["pos"], x["pos"] + x["lines"])} for later in (True, False)
                )
                drop -= first
                if drop:
                    texts[k] = "\n".join(x for i, x in enumerate(lines) if i not in drop)
                counts.append((len(lines), len(drop), sum(i - 1 not in drop for i in drop)))
            columns = []
            for field in out.names[:-3]:
                if field == "text":
                    columns.append(pa.array(texts, pa.string()))
                elif field == "n_chars":
                    columns.append(pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(batch.column("n_chars").type))
                else:
                    columns.append(batch.column(field))
            columns += [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays(columns, out.names)

    return dealt.mapInArrow(run, out)


def line_digests(docs: DataFrame, least: int = LEAST_LINES, alone: int | None = ALONE_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_sha256 of every row."""
    cut = deduplicated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least, alone)
    return cut.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), runs AS (
  SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next_line FROM lines
), windows AS (
  SELECT doc_id, pos, 2 AS size, row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, pos) AS place, count(*) OVER (PARTITION BY line, next_line) AS copies FROM runs WHERE next_line IS NOT NULL
  UNION ALL
  SELECT doc_id, pos, 1 AS size, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS place, count(*) OVER (PARTITION BY line) AS copies
  FROM lines WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 5
), covered AS (
  SELECT doc_id, unnest(generate_series(pos, pos + size - 1)) AS pos, place > 1 AS again FROM windows WHERE copies > 1
), gone AS (
  SELECT doc_id, pos FROM covered WHERE again EXCEPT SELECT doc_id, pos FROM covered WHERE NOT again
), marked AS (
  SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS cut, lag(g.pos IS NOT NULL, 1, false) OVER (PARTITION BY l.doc_id ORDER BY l.pos) AS cut_before
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE cut AND NOT cut_before) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
