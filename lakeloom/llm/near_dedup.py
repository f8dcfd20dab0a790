"""Operator 2: near-duplicate classes by DartMinHash signatures and banded joining.

A text is a weighted set: its five-word shingles, each with its count as weight. DartMinHash throws
darts at the plane of weight x rank: for each element, each unit of its weight and each interval of
ranks, a Poisson number of darts that depends on nothing but their hash. The ranks' intervals are
[0, 2**-10), then doubling up to 1, then of length 1; counts are whole numbers, so a dart's weight
coordinate always lies inside the element's region. A text reads intervals until about
k ln k + 2 k darts have fallen, which costs the same for any total weight; each dart names one of k
coordinates, the earliest dart of each coordinate stays, and coordinates without any read on. Two
texts agree in a coordinate with the probability of their weighted Jaccard similarity.

Joining: 32 bands of 7 coordinates (a pair at 0.8 meets in some band with probability 0.9995). The
bands are the only estimate; what meets in a bucket is decided on the shingles themselves, exactly.
Nobody meets everybody in a bucket:

1. Every member is compared with the bucket's leader, the member that meets most others over all
   bands (of a group of copies, their source). Sizes that differ too much need no comparison.
2. What is left are strays, members outside the leader's component. A shingle is open if it occurs in
   two components. All that a stray shares with a text of another component is open, so one with fewer open
   shingles than the least overlap that any size in its bucket needs has no further link and leaves.
3. Take open shingles in one order for all, rarest first. Of two texts with o and p open shingles whose sizes
   need an overlap of x, the first that they share is among the o - x + 1 first of the one and the p - x + 1
   first of the other. So strays and members meet on these prefixes only, and nobody brings more.

So each pair in a bucket is in one component, was compared, or is ruled out by a proven bound: no
link that the bands have found is lost. Copies near their source join in step 1, those with changes of
their own leave in step 2, and in step 3 the shingles of the source are rarely among the rarest: if a
stray lacked only few of them it would be linked to the source. So rows grow with the members of a
bucket. What can still grow faster are the pairs compared in step 3, where many strays share one rare
change: this is what the exact decision costs.

Texts are told apart by 128 bits of hash, shingles by 64.

Defined results: a null text is an empty one; texts without words are near only to identical texts;
a text under five words is one shingle; identical texts are one class; a null id is an id like
others and is class id only if its class has no other; repeated rows get the same class; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import contract
from .lineage import fresh_names, written

#: Production parameters.
SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 32, 7
COORDINATES = BANDS * BAND_ROWS
#: Bits of the filter that keeps most texts without a bucket from being shingled again; too few only cost time.
FILTER_BITS = 1 << 23

#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1

U = np.uint64
_GOLD, _LEVEL, _DART = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03), U(0x8CB92BA72F3D8DD7)
_START = [0.0] + [2.0**-k for k in range(10, 0, -1)]
_WIDTH = [2.0**-10] + [2.0**-k for k in range(10, 0, -1)]


def _cdf(mean: float) -> np.ndarray:
    p, total, out = np.exp(-mean), 0.0, []
    for j in range(1, 40):
        total += p
        out.append(total)
        p *= mean / j
    return np.array(out)


_CDFS = [_cdf(w) for w in _WIDTH]
_UNIT = _cdf(1.0)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """(cells, document of each): one hash for each shingle and each unit of its count, in order of documents."""
    start, end, first = K.words(data, offsets)
    sums = K.prefix(K.word_hashes(data, start, end))
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = K.ranges(first[:-1], count)
    doc = np.repeat(np.arange(len(n)), count)
    h = K.span_hash(sums, at, np.minimum(at + size, first[doc + 1]))
    # the m-th copy of a shingle in its document is a cell of its own
    own = K.mix(h ^ (doc.astype(U) * _GOLD))
    dup = np.flatnonzero(K.repeated(own, np.ones(len(own), np.int64)))
    if len(dup):
        order = dup[np.argsort(own[dup], kind="stable")]
        new = np.concatenate(([True], own[order][1:] != own[order][:-1]))
        place = np.arange(len(order))
        h[order] += (place - np.maximum.accumulate(np.where(new, place, 0))).astype(U) * _GOLD
    return K.mix(h), doc


def signatures(cells: np.ndarray, doc: np.ndarray, n_docs: int, k: int = COORDINATES) -> np.ndarray:
    """n_docs x k earliest darts, each named by its rank in fixed point; documents without cells keep the largest value."""
    none = (U(1) << U(48)) - U(1)
    sig = np.full(n_docs * k, none, U)
    weight = np.bincount(doc, minlength=n_docs)
    darts = k * np.log(k) + 2 * k
    lo, hi = np.zeros(n_docs), darts / np.maximum(weight, 1)
    pending = weight > 0

    def throw(cell, d, level, counts, begin, width):
        cell, d, level, begin = (np.repeat(x, counts) for x in (cell, d, level, begin))
        ends = np.cumsum(counts)
        nth = np.arange(len(cell)) - np.repeat(ends - counts, counts)
        x = K.mix(cell ^ (level * _DART + nth.astype(U) * _GOLD))
        coordinate = ((x >> U(40)) * U(k)) >> U(24)
        y = K.mix(x)
        rank = ((begin + width * ((y >> U(11)) * 2.0**-53)) * 2.0**36).astype(U)
        return ((d.astype(U) * U(k) + coordinate) << U(48)) | np.minimum(rank, none - U(1))

    while pending.any():
        keys = []
        here = pending[doc]
        c, d = cells[here], doc[here]
        for i, (begin, width) in enumerate(zip(_START, _WIDTH, strict=True)):
            use = (begin < hi[d]) & ((begin >= lo[d]) | (lo[d] == 0))
            cc, dd = (c, d) if use.all() else (c[use], d[use])
            if not len(cc):
                continue
            u = (K.mix(cc ^ U((i + 1) * int(_LEVEL) & 0xFFFFFFFFFFFFFFFF)) >> U(11)) * 2.0**-53
            some = np.flatnonzero(u >= _CDFS[i][0])
            counts = np.searchsorted(_CDFS[i], u[some], "right")
            keys.append(throw(cc[some], dd[some], np.full(len(some), i + 1, U), counts, np.full(len(some), begin), width))
        first = np.maximum(np.ceil(lo), 1).astype(np.int64)
        units = np.maximum(np.ceil(hi).astype(np.int64) - first, 0)[d]
        if units.any():
            cc, dd = np.repeat(c, units), np.repeat(d, units)
            unit = K.ranges(first[d], units)
            level = unit.astype(U) + U(16)
            u = (K.mix(cc ^ (level * _LEVEL)) >> U(11)) * 2.0**-53
            some = np.flatnonzero(u >= _UNIT[0])
            counts = np.searchsorted(_UNIT, u[some], "right")
            keys.append(throw(cc[some], dd[some], level[some], counts, unit[some].astype(float), 1.0))
        if keys:
            key = np.concatenate(keys)
            key.sort()
            slot = (key >> U(48)).astype(np.int64)
            new = np.concatenate(([True], slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, bool)
            sig[slot[new]] = np.minimum(sig[slot[new]], key[new] & none)
        pending &= (sig.reshape(n_docs, k) == none).any(axis=1)
        lo = np.where(pending, hi, lo)
        hi = np.where(pending, hi * 1.5 + 2.0**-10, hi)
    return sig.reshape(n_docs, k)


def _docs_in_steps(offsets: np.ndarray):
    for i, j in K.chunks(offsets):
        for x in range(i, j, 256):
            yield x, min(j, x + 256)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k1, k2, did, text -> k1, k2, did, m (shingles), bands (null without words)."""
    for batch in batches:
        data, offsets = K.flat(batch.column("text"))
        for i, j in _docs_in_steps(offsets):
            cells, doc = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = j - i
            sig = K.mix(signatures(cells, doc, n))
            band = np.zeros((n, BANDS), U)
            for r in range(BAND_ROWS):
                band = K.mix(band * _GOLD + sig[:, r::BAND_ROWS])
            band = K.mix(band ^ (np.arange(1, BANDS + 1, dtype=U) * _LEVEL))
            m = np.bincount(doc, minlength=n)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(band.view(np.int64).ravel()))
            bands = pc.if_else(pa.array(m == 0), pa.scalar(None, bands.type), bands)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, n) for c in ("k1", "k2", "did")), pa.array(m), bands], ["k1", "k2", "did", "m", "bands"])


def _cells(bits):
    """k1, k2, did, text -> k1, k2, did, cells (64-bit cell hashes, all different) of the rows that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((words[at >> 6] >> (at & 63).astype(U)) & U(1) == U(1)))
            data, offsets = K.flat(batch.column("text"))
            for i, j in _docs_in_steps(offsets):
                cells, doc = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                to = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(to), pa.array(cells.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("k1", "k2", "did")), listed], ["k1", "k2", "did", "cells"])

    return run


def _filter_place() -> Column:
    return F.pmod(F.xxhash64("k1", "k2", "did"), F.lit(FILTER_BITS)).alias("at")


def _cells_of(needed: DataFrame, rows: DataFrame) -> DataFrame:
    """t, cells of the texts of needed (k1, k2, did, t), written.

    Texts are not shuffled for it: a filter of fixed size, whose false hits leave in the join, decides which are shingled again.
    """
    filled = needed.select(_filter_place()).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[filled.column("w").to_numpy()] = filled.column("bits").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bits.view(U))
    cells = rows.select("k1", "k2", "did", "text", _filter_place()).mapInArrow(_cells(shared), "k1 long, k2 long, did long, cells array<long>")
    return written(cells.join(needed, ["k1", "k2", "did"]).groupBy("t").agg(F.first("cells").alias("cells")))


def _near(pairs: DataFrame, cells: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose weighted Jaccard similarity reaches the threshold."""
    for c in "ab":
        pairs = pairs.join(cells.select(F.col("t").alias(c), F.col("cells").alias(f"c{c}")), c)
    sized = pairs.select("a", "b", F.size(F.array_intersect("ca", "cb")).alias("x"), (F.size("ca") + F.size("cb")).alias("n"))
    return sized.where(F.col("x") >= similarity * (F.col("n") - F.col("x")) - 1e-9).select("a", "b")


def _id_key() -> Column:
    """doc_id, null ids last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _text_keys() -> tuple[Column, Column]:
    """128 bits that name a text."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least id of the class) of every row."""
    joined = _components(docs, similarity)
    classes = joined.join(joined.groupBy("c").agg(F.min("did").alias("class_did")), "c").select("k1", "k2", "class_did")
    k1, k2 = _text_keys()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2")).join(classes, ["k1", "k2"])
    return named.select("doc_id", F.when(F.col("class_did") != NO_ID, F.col("class_did")).alias("class_id"))


def _components(docs: DataFrame, similarity: float) -> DataFrame:
    """k1, k2, did (least id of the text), c (component of near texts) of every different text."""
    k1, k2 = _text_keys()
    rows = docs.select(_id_key().alias("did"), k1.alias("k1"), k2.alias("k2"), F.coalesce("text", F.lit("")).alias("text"))
    signed = rows.select("k1", "k2", "did", "text").mapInArrow(_sign, "k1 long, k2 long, did long, m long, bands array<long>")
    # identical texts become one; the map-side merge meets hot ones
    texts = signed.groupBy("k1", "k2").agg(F.min("did").alias("did"), F.first("m").alias("m"), F.first("bands").alias("bands"))
    texts = written(texts.withColumn("t", F.monotonically_increasing_id()))

    buckets = texts.where("bands is not null").select(F.explode("bands").alias("bucket"), "t", "m")
    shared = written(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))  # sums are written before they are joined: a hot bucket's join can be split then
    members = written(buckets.join(shared, "bucket"))
    # the text that most others meet leads: in a group of copies that is the one they were made from
    met = members.groupBy("t").agg(F.sum("n").alias("met"))
    leaders = members.join(met, "t").groupBy("bucket").agg(F.max(F.struct("met", "t", "m")).alias("x")).select("bucket", F.col("x.t").alias("leader"), F.col("x.m").alias("leader_m"))
    members = written(members.join(written(leaders), "bucket").drop("n"))
    needed = written(members.select("t").distinct().join(texts.select("k1", "k2", "did", "t"), "t"))
    cells = _cells_of(needed, rows)

    sizes_fit = F.least("m", "leader_m") >= similarity * F.greatest("m", "leader_m") - 1e-9
    pairs = members.where(sizes_fit & (F.col("t") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("t").alias("b")).distinct()
    labels = contract(needed.select("t", F.col("t").alias("c")), _near(pairs, cells, similarity))
    labels = _with_strays(members.drop("leader_m"), labels, cells, similarity)
    return texts.select("k1", "k2", "did", "t").join(labels, "t", "left").withColumn("c", F.coalesce("c", "t")).drop("t")


def _with_strays(members: DataFrame, labels: DataFrame, cells: DataFrame, similarity: float) -> DataFrame:
    """labels (t, c) of members (bucket, t, m, leader), with the links of those outside their leaders' components."""
    named = members.join(labels, "t")
    mixed = named.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max_by("c", F.col("t") == F.col("leader")).alias("head"), F.min("m").alias("least_m"))
    rest = named.join(written(mixed.where("lo < hi").drop("lo", "hi")), "bucket").select("bucket", "t", "m", "c", "least_m", (F.col("c") != F.col("head")).alias("stray"))
    rest = written(rest)
    if rest.isEmpty():
        return labels
    who = written(rest.groupBy("t").agg(F.first("c").alias("c"), F.first("m").alias("m"), F.max("stray").alias("stray"), F.min("least_m").alias("least_m")))
    spread = who.select("t", "c").join(cells, "t").select("t", "c", F.explode("cells").alias("cell"))
    open_cells = spread.groupBy("cell").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("cell", "n")
    own = Window.partitionBy("t")
    ranked = spread.join(open_cells, "cell").select("t", "cell", F.count(F.lit(1)).over(own).alias("o"), F.row_number().over(own.orderBy("n", "cell")).alias("k"))
    need = lambda m, other: F.ceil(similarity / (1 + similarity) * (F.col(m) + other) - 1e-9)
    # the least overlap with a text of the least size that the bucket has and the similarity lets
    prefixes = ranked.join(who, "t").where(F.col("k") <= F.col("o") - need("m", F.greatest(similarity * F.col("m"), F.col("least_m"))) + 1)
    prefixes = written(prefixes.select("t", "c", "m", "o", "k", "stray", "cell"))
    asks = prefixes.where("stray").drop("stray")
    if asks.isEmpty():
        return labels
    theirs = prefixes.select("cell", *(F.col(x).alias(f"b_{x}") for x in ("t", "c", "m", "o", "k")))
    overlap = need("m", F.col("b_m"))
    both = (F.col("k") <= F.col("o") - overlap + 1) & (F.col("b_k") <= F.col("b_o") - overlap + 1)
    able = both & (F.col("c") != F.col("b_c")) & (F.least("m", "b_m") >= similarity * F.greatest("m", "b_m") - 1e-9)
    pairs = asks.join(theirs, "cell").where(able).select(F.least("t", "b_t").alias("a"), F.greatest("t", "b_t").alias("b")).distinct()
    return contract(labels, _near(written(pairs), cells, similarity))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """One row of docs, all columns, of each class: the one with its least id (null ids last) and, of several texts with it, the least text hash.

    Ids may repeat or be null, so rows are chosen by id and text; of rows equal in both one stays.
    """
    i, h, g = fresh_names(docs, "id", "h", "g")
    k1, k2 = _text_keys()
    keyed = docs.withColumns({i: _id_key(), h: k1, g: k2})
    least = _components(docs, SIMILARITY).groupBy("c").agg(F.min(F.struct("did", "k1", "k2")).alias("x"))
    least = least.select(F.col("x.did").alias(i), F.col("x.k1").alias(h), F.col("x.k2").alias(g))
    chosen = written(keyed.select(i, h, g).join(least, [i, h, g], "left_semi").groupBy(i, h, g).agg(F.count(F.lit(1)).alias("n")))
    once, more = (keyed.join(chosen.where(how), [i, h, g], "left_semi") for how in ("n = 1", "n > 1"))
    return once.unionByName(more.dropDuplicates([i, h, g])).drop(i, h, g)
