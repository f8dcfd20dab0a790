"""Exact repeats of long windows: the frame of the suffix-array and the fixed-block operators.

Both operators remove what is covered by a window (200 bytes, 35 words) that also starts anywhere
else. The frame finds candidates without sending every window over the network:

1. anchors: every window elects the least-hashed gram inside it; equal windows elect equal grams,
   so a window whose gram is unique in the corpus is unique. About 2 / (window - gram) anchors a
   position are counted by hash (map-side combined); the rest of the text takes no further part.
2. contexts: for each anchor that is not unique, the bytes of the windows that it serves go to the
   task of the gram. Contexts that occur twice in one Arrow batch are settled at once, and one
   copy goes on, so a hot passage costs a gram's task one row a batch and not one a copy.
3. solving: inside a gram's group the named method (a solver) marks the starts that repeat. What it finds by
   hashes is compared with the group's first copy, value by value, before it counts.
4. marks return to the documents by row key, where the text is cut.

The text is shuffled once, by row key; both later reads use the same exchange. Rows alike in id and text share
their key: what one of them marks all marked, so marks and spans are sets, and n such rows cost n times one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .lineage import written

def same_spans(values: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Mask of the pairs of starts whose `width` values are equal."""
    same = np.ones(len(a), bool)
    for i in range(width):
        same &= values[a + i] == values[b + i]
    return same


def equal_first(ids: np.ndarray) -> np.ndarray:
    """For each entry the number of the first one with the same id."""
    _, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
    return first[inverse]


def repeats_of(ids: np.ndarray, weight: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Mask of the entries whose equals, itself included, weigh more than 1 together.

    Entries of one id are compared with the id's first one by equal(entries, firsts); those that differ (their ids collide) go
    through it again among themselves.
    """
    out, rest = weight > 1, np.arange(len(ids))
    while len(rest):
        leader = equal_first(ids[rest])
        same = equal(rest, rest[leader])
        times = np.bincount(leader[same], weights=weight[rest[same]], minlength=len(rest))
        out[rest[same]] |= times[leader[same]] > 1
        rest = rest[~same]
    return out


Unit = Callable[[np.ndarray, np.ndarray], tuple]

#: Bytes of contexts that a solver takes at a time (one gram's group is never split).
SOLVE_BYTES = 1 << 19


def byte_units(data: np.ndarray, offsets: np.ndarray):
    """Values are bytes: (prefix sums, offsets, byte start of unit, byte end of unit)."""
    at = np.arange(len(data) + 1)
    return K.prefix(data), offsets, at[:-1], at[1:]


def word_units(data: np.ndarray, offsets: np.ndarray):
    """Values are digests of words."""
    start, end, first = K.words(data, offsets)
    return K.prefix(K.word_hashes(data, start, end)), first, start, end


def _keyed(docs: DataFrame) -> DataFrame:
    """rid is equal only for rows that are alike in id and text, whose results are alike too."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))


def _anchors(units: Unit, width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column("text"))
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            for i, j in K.chunks(offsets):
                o = offsets[i : j + 1] - offsets[i]
                sums, first, _, _ = units(data[offsets[i] : offsets[j]], o)
                doc, pos, _, _, h = K.minimizer_runs(sums, first, width, gram)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rid[i:j][doc]), pa.array((pos - first[doc]).astype(np.int32))], ["h", "rid", "pos"])

    return run


def _contexts(units: Unit, width: int, gram: int):
    names = ["h", "rid", "did", "s", "e", "w", "ctx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column("text"))
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            did = batch.column("did").to_numpy(zero_copy_only=False)
            marks = batch.column("marks")
            at = np.asarray(marks.offsets).astype(np.int64)
            flat_marks = np.asarray(marks.values)
            parts, seen = [], []
            for i, j in K.chunks(offsets):
                o = offsets[i : j + 1] - offsets[i]
                piece = data[offsets[i] : offsets[j]]
                sums, first, begin, end = units(piece, o)
                doc, pos, a, b, h = K.minimizer_runs(sums, first, width, gram)
                wanted = (np.repeat(np.arange(j - i), np.diff(at[i : j + 1])) << 32) | flat_marks[at[i] : at[j]]
                keep = np.isin((doc << 32) | (pos - first[doc]), wanted)
                doc, a, b, h = doc[keep], a[keep], b[keep], h[keep]
                parts.append((h, rid[i:j][doc], did[i:j][doc], (a - first[doc]).astype(np.int32), (b - first[doc]).astype(np.int32), offsets[i] + begin[a], offsets[i] + end[b + width - 1]))
                seen.append(K.mix(K.span_hash(sums, a, b + width) ^ K.mix(h)))
            if not parts or not sum(map(len, seen)):
                continue
            h, r, d, s, e, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            first = equal_first(np.concatenate(seen))
            # equal hashes count after a look at the bytes
            copy = np.flatnonzero((first != np.arange(len(h))) & (end - begin == (end - begin)[first]))
            length = (end - begin)[copy]
            differ = data[K.ranges(begin[copy], length)] != data[K.ranges(begin[first[copy]], length)]
            copy = copy[np.add.reduceat(differ, np.cumsum(length) - length) == 0] if len(copy) else copy
            first_of = np.ones(len(h), bool)
            first_of[copy] = False
            twice = ~first_of
            twice[first[copy]] = True
            t = np.flatnonzero(twice)  # settled here; any key that spreads them will do
            yield pa.RecordBatch.from_arrays([pa.array(r[t]), pa.array(r[t]), pa.array(d[t]), pa.array(s[t]), pa.array(e[t]), pa.array(np.full(len(t), 2, np.int32)), pa.nulls(len(t), pa.binary())], names)
            t = np.flatnonzero(first_of)
            w = np.where(twice[t], 2, 1).astype(np.int32)
            for x in range(0, len(t), 20_000):
                u = t[x : x + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(h[u].view(np.int64)), pa.array(r[u]), pa.array(d[u]), pa.array(s[u]), pa.array(e[u]), pa.array(w[x : x + 20_000]), K.binary(data, begin[u], end[u])], names)

    return run


def _solved(solver: Callable, units: Unit, width: int):
    """solver(sums, first, weight, starts, row of start, bytes, byte starts and ends of units) -> mask of the starts whose window repeats."""
    names = ["rid", "did", "s", "e"]

    def solve(table: pa.Table) -> pa.RecordBatch:
        data, offsets = K.flat(table.column("ctx"))
        sums, first, opens, closes = units(data, offsets)
        w, s = table.column("w").to_numpy(), table.column("s").to_numpy()
        served = np.maximum(np.diff(first) - width + 1, 0)
        starts = K.ranges(first[:-1], served)
        row = np.repeat(np.arange(len(served)), served)
        hit = solver(sums, first, w, starts, row, data, opens, closes)
        begin, stop = K.runs(hit, np.concatenate(([True], row[1:] != row[:-1])) if len(row) else None)
        own = row[begin]
        rel = starts[begin] - first[own] + s[own]
        return pa.RecordBatch.from_arrays([pa.array(table.column("rid").to_numpy()[own]), pa.array(table.column("did").to_numpy()[own]), pa.array(rel.astype(np.int32)), pa.array((rel + stop - begin - 1).astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            known = batch.filter(pc.is_null(batch.column("ctx")))
            if len(known):
                yield known.select(names)
            batch = batch.filter(pc.is_valid(batch.column("ctx")))
            while len(batch):
                h = batch.column("h").to_numpy(zero_copy_only=False)
                if size >= SOLVE_BYTES:  # up to the end of the open group
                    to = int(np.searchsorted(h, held[-1].column("h")[-1].as_py(), "right"))
                    if to:
                        held.append(batch.slice(0, to))
                        batch = batch.slice(to)
                    if len(batch):
                        yield solve(pa.Table.from_batches(held))
                        held, size = [], 0
                    continue
                take = batch.slice(0, 1_000)
                held.append(take)
                size += take.column("ctx").nbytes
                batch = batch.slice(len(take))
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def cover(n: int, spans: list, width: int) -> np.ndarray:
    """Mask of the units covered by the windows that start in the spans (first, last start)."""
    step = np.zeros(n + 1, np.int32)
    for s, e in spans:
        step[s] += 1
        step[e + width] -= 1
    return np.cumsum(step[:-1]) > 0


def repeat_spans(docs: DataFrame, units: Unit, solver: Callable, width: int, gram: int) -> DataFrame:
    """Rows (doc_id, text, rid, did, spans): spans has the first and last start of repeated windows, by id.

    A document without any has spans null. Null texts count as empty, null ids are ids like others,
    repeated rows are copies of one another, and other columns of docs are ignored.
    """
    keyed = _keyed(docs)
    anchors = keyed.select("rid", "text").mapInArrow(_anchors(units, width, gram), "h long, rid long, pos int")
    common = written(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))  # on its own, so that the join of a hot gram can be split
    marks = anchors.join(common, "h").groupBy("rid").agg(F.collect_set("pos").alias("marks"))  # sets: rows alike in id and text have the same marks and spans, once
    dealt = keyed.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("did"), "text", "rid").repartition("rid")
    contexts = dealt.join(marks, "rid").select("doc_id", "did", "text", "rid", "marks")  # all columns: the exchange is reused
    contexts = contexts.mapInArrow(_contexts(units, width, gram), "h long, rid long, did long, s int, e int, w int, ctx binary")
    spans = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_solved(solver, units, width), "rid long, did long, s int, e int")
    grouped = spans.groupBy("rid").agg(F.collect_set(F.struct("did", "s", "e")).alias("spans"))
    return dealt.join(grouped, "rid", "left")


def digests(frame: DataFrame, cut: Callable, schema: str) -> DataFrame:
    """cut(text bytes, spans) gives the values after doc_id of the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column("text"))
            raw, spans = memoryview(data), batch.column("spans").to_pylist()
            dids = batch.column("did").to_pylist()
            rows = [cut(bytes(raw[offsets[i] : offsets[i + 1]]), [(x["s"], x["e"]) for x in spans[i] or () if x["did"] == dids[i]]) for i in range(len(dids))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, zip(*rows, strict=True))], names) if rows else pa.RecordBatch.from_pylist([])

    names = [x.split()[0] for x in schema.split(", ")]
    return frame.select("doc_id", "did", "text", "spans").mapInArrow(lambda it: (b for b in run(it) if len(b)), schema)


def sha256(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
