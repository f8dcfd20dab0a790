"""Operator 9: benchmark decontamination by greedy string tiling.

The different texts of the benchmark come to the tasks in blocks of bounded size; every document is
read against every block. Seeds are hashes of SEED consecutive words. Tiles that cover the asked share
of an item of n words hold at least q = share x n / SEED of its seeds, so of each item's seeds the q - 1
that most items of the block have need no place in the index: a document without any of the others
cannot reach the share. Documents and items that meet there are joined on all their seeds, and if these
cover the share together, they are tiled: running Karp-Rabin finds the longest matches between
unmarked words of both sides, marks them and goes on with shorter ones down to SEED words.

The tiling is strict: the longest match goes first, of equally long ones that with the least start in the text,
then in the item; what a tile leaves of an overlapped match counts by its own length. Tiles do not
overlap and may stand in any order, so passages whose sentences were moved are caught as well. A document
is contaminated by an item when tiles cover at least COVERAGE of the item's words.

Words are maximal runs of letters, digits and other characters beyond ASCII, in lower case.
Defined results: null texts and null items have no words and match nothing; items under SEED words
match nothing; repeated rows and items give repeated results; an empty table gives no rows; other
columns are ignored (decontaminated() keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .lineage import written

#: Production parameters: least tile in words, share of an item's words, bytes of items in a block.
SEED, COVERAGE, BLOCK_BYTES = 4, 0.5, 8 << 20

_BREAK = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])


def word_ids(column: pa.Array):
    """(hash of each word, number of words before each text)."""
    data, offsets = K.flat(pc.utf8_lower(column))
    ids, firsts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in K.chunks(offsets):
        part = data[offsets[i] : offsets[j]]
        start, end, first = K.words(part, offsets[i : j + 1] - offsets[i], _BREAK)
        ids.append(K.word_hashes(part, start, end))
        firsts.append(first[1:] + firsts[-1][-1])
    return np.concatenate(ids), np.concatenate(firsts)


class Items:
    """One block of the benchmark: its texts' keys and words, and its seeds; the rarer ones in order, as an index."""

    def __init__(self, keys: list, texts: list, coverage: float):
        self.keys = keys
        self.words, self.first = word_ids(pa.array(texts, pa.string()))
        n = np.diff(self.first)
        n_seeds = np.maximum(n - SEED + 1, 0)
        at = K.ranges(self.first[:-1], n_seeds)
        self.seeds = K.rolling(K.prefix(self.words), SEED)[at] if len(at) else np.zeros(0, np.uint64)
        self.first_seed = np.concatenate(([0], np.cumsum(n_seeds)))
        item = np.repeat(np.arange(len(n)), n_seeds)
        _, inverse, count = np.unique(self.seeds, return_inverse=True, return_counts=True)
        order = np.lexsort((-count[inverse], item)) if len(item) else np.zeros(0, np.int64)  # an item's commonest first
        place = np.arange(len(order)) - self.first_seed[item[order]]
        spared = np.ceil(coverage * n / SEED - 1e-9).astype(np.int64) - 1
        kept = order[place >= spared[item[order]]]
        kept = kept[np.argsort(self.seeds[kept], kind="stable")]
        self.index, self.item = self.seeds[kept], item[kept]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.index >> np.uint64(44)).astype(np.int64)] = True


def _candidates(text: np.ndarray, item: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(-length, text start, item start) of the maximal matches of unmarked words that have at least `length` of them.

    Matches that go on to the left are left out, which in a text of few different words are nearly all.
    """
    sides = []
    for x, free in ((text, free_a), (item, free_b)):
        starts = np.flatnonzero(K.sliding_min(free.astype(np.int8), length)) if len(x) >= length else np.zeros(0, np.int64)
        h = K.rolling(K.prefix(x), length)
        follows = np.concatenate(([False], np.diff(starts) == 1)) if len(starts) else np.zeros(0, bool)
        sides.append((starts, h[starts], x[np.maximum(starts - 1, 0)] if len(starts) else h[:0], follows))  # with the word before
    (at_a, ha, before_a, follows_a), (at_b, hb, before_b, follows_b) = sides
    places: dict[int, dict[int, list[int]]] = {}
    for h, j, before, follows in zip(hb.tolist(), at_b.tolist(), before_b.tolist(), follows_b.tolist(), strict=True):
        places.setdefault(h, {}).setdefault(before if follows else -1, []).append(j)
    out = []
    hit = np.isin(ha, hb)
    for h, i, before, follows in zip(ha[hit].tolist(), at_a[hit].tolist(), before_a[hit].tolist(), follows_a[hit].tolist(), strict=True):
        for other, js in places[h].items():
            if follows and other == before:
                continue
            for j in js:
                k = length
                if not np.array_equal(text[i : i + k], item[j : j + k]):  # equal hashes of unequal words
                    continue
                while i + k < len(text) and j + k < len(item) and free_a[i + k] and free_b[j + k] and text[i + k] == item[j + k]:
                    k += 1
                out.append((-k, i, j))
    return out


def tiles(text: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (text start, item start, length) of non-overlapping matches, longest first."""
    free_a, free_b = np.ones(len(text), bool), np.ones(len(item), bool)
    found: list[tuple[int, int, int]] = []
    length = max(least, len(item))
    while True:
        heap = _candidates(text, item, free_a, free_b, length)
        heapify(heap)
        while heap:
            k, i, j = heappop(heap)
            k = -k
            free = free_a[i : i + k] & free_b[j : j + k]
            if free.all():
                found.append((i, j, k))
                free_a[i : i + k] = free_b[j : j + k] = False
            else:
                for a, b in zip(*K.runs(free), strict=True):
                    if b - a >= length:
                        heappush(heap, (int(a - b), i + int(a), j + int(a)))
        if length == least:
            return found
        length = max(least, length // 2)


def matches(column: pa.Array, items: Items, coverage: float = COVERAGE) -> list[tuple[int, int, float, int]]:
    """(row, item number, share of the item's words, tiles) of all contaminations of a column of texts, some MB at a time."""
    out = []
    for i, j in K.chunks(K.flat(column)[1], 4 << 20):
        out += [(i + r, m, share, n) for r, m, share, n in _matches(column.slice(i, j - i), items, coverage)]
    return out


def _matches(column: pa.Array, items: Items, coverage: float) -> list[tuple[int, int, float, int]]:
    words, first = word_ids(column)
    if len(words) < SEED or not len(items.index):
        return []
    h = K.rolling(K.prefix(words), SEED)
    maybe = np.flatnonzero(items.filter[(h >> np.uint64(44)).astype(np.int64)])
    row = np.searchsorted(first, maybe, "right") - 1
    inside = maybe + SEED <= first[row + 1]
    maybe, row = maybe[inside], row[inside]
    # a seed counts once for a document: its repeats add no candidate
    once = np.unique(np.stack((row.astype(np.uint64), h[maybe])), axis=1) if len(maybe) else np.zeros((2, 0), np.uint64)
    left, right = (np.searchsorted(items.index, once[1], side) for side in ("left", "right"))
    pairs = np.unique(np.repeat(once[0].astype(np.int64), right - left) * len(items.keys) + items.item[K.ranges(left, right - left)])
    found = []
    for r, m in zip((pairs // len(items.keys)).tolist(), (pairs % len(items.keys)).tolist(), strict=True):
        item, own = items.words[items.first[m] : items.first[m + 1]], items.seeds[items.first_seed[m] : items.first_seed[m + 1]]
        seeds = h[first[r] : max(first[r], first[r + 1] - SEED + 1)]
        met = np.isin(own, seeds)
        reach = np.unique(K.ranges(np.flatnonzero(met), np.full(int(met.sum()), SEED)))
        if len(reach) < coverage * len(item):
            continue
        # only words under common seeds can be tiled; a barrier stands between separate stretches
        at = first[r] + np.flatnonzero(np.isin(seeds, own))
        spots = np.unique(K.ranges(at, np.full(len(at), SEED)))
        stretch = np.split(words[spots], np.flatnonzero(np.diff(spots) > 1) + 1)
        barrier = np.zeros(1, np.uint64)
        text = np.concatenate([x for s in stretch for x in (s, barrier)])
        got = tiles(text, item)
        share = sum(k for _, _, k in got) / len(item)
        if share >= coverage:
            found.append((r, m, share, len(got)))
    return found


def _keys() -> tuple[Column, Column]:
    """128 bits that name an item's text."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def _blocks(benchmark: DataFrame, coverage: float) -> Iterator[tuple[Items, bool]]:
    """The stated set's different texts in blocks whose size is checked, one at a time on the driver; and whether there are several."""
    rows = benchmark.select(*_keys(), F.coalesce("text", F.lit("")).alias("text")).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-total // (BLOCK_BYTES // 2)))
    for k in range(n):
        block = rows.where(F.pmod("k1", F.lit(n)) == k).orderBy("k1", "k2").collect()
        yield Items([(x.k1, x.k2) for x in block], [x.text for x in block], coverage), n > 1


def contaminations(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles of each document and item that share enough."""
    names, kinds = ["doc_id", "k1", "k2", "coverage", "n_tiles"], (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
    found = None
    for items, several in _blocks(benchmark, coverage):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[r], *items.keys[m], share, n) for r, m, share, n in matches(batch.column("text"), items, coverage)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, k1 long, k2 long, coverage double, n_tiles long")
        part = written(part) if several else part  # then the block can leave the driver
        found = part if found is None else found.unionByName(part)
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), *_keys())
    return found.join(named, ["k1", "k2"]).select("doc_id", "item_id", "coverage", "n_tiles")


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates."""
    for items, several in _blocks(benchmark, coverage):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[r for r, _, _, _ in matches(batch.column("text"), items, coverage)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        docs = written(docs) if several else docs
    return docs
