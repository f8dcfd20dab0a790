"""Operator 3: hierarchical multi-length packing.

A document's ids are routed by length to context-size tiers (256 to 4096 ids); what is longer than
the widest window is cut into whole windows first and its rest is routed. Windows are packed from
the widest tier down: the longest waiting piece opens a window of its tier, the gap is filled by the
longest pieces of shorter tiers that fit, and one piece is cut to close the window exactly. So every
window is a power of two long and carries no padding; what is left at the end of a task (under one
window) is closed as windows of descending powers of two, which may be narrower than the narrowest tier.

Each task packs the documents that it reads: no text is shuffled, and memory holds a few thousand
documents. Sequence ids start from the partition's number, so a task that runs again
gives the same rows. The pieces (a few numbers each) are written once; then the windows of a tier are
numbered over all tasks, by adding up one count a task, and dealt to step groups of STEP_IDS ids: all groups of a
tier but its last are full.

Defined results: a null text is an empty one, whose only id is the closing id; repeated rows are
packed each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

#: Production parameters: widest window, narrowest routed tier, ids in a step group, closing id.
WINDOW, LEAST_TIER, STEP_IDS, END_ID = 4096, 256, 1 << 18, 2
VOCABULARY = "word_bpe_49k.json"

#: Words whose ids a worker keeps; and bytes of text that are packed together.
CACHED_WORDS, POOL_BYTES = 800_000, 6 << 20

_SPLIT = bytes(32 if x in (9, 10, 13) else x for x in range(256))
#: Letters a-z and those of Latin-1 (composed, each with one lower-case form), then other ASCII characters than letters, digits, ' < > |.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-;=?@\[-`{}~]*)")
_cache: dict[bytes, bytes] = {}
_coders: dict[str, tuple] = {}


def _coder(path: str) -> tuple:
    """(tokenizer, encoder of plain words) of a vocabulary file.

    The second is the same byte-pair vocabulary as ranks for a faster library: the mark of a word's
    end is byte 255, which no UTF-8 text has, and ids are in order of the merges. It takes words of
    plain letters only, of which the tokenizer's normaliser and splitter make one lower-case piece; it
    is used only if the file has the layout that this needs.
    """
    if path not in _coders:
        from tokenizers import Tokenizer

        _coders.clear()
        _cache.clear()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, plain = model["vocab"], None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
        merges = [x if isinstance(x, str) else " ".join(x) for x in model["merges"]]
        first = len(vocabulary) - len(merges)
        in_order = all(vocabulary.get(x.replace(" ", "", 1)) == first + i for i, x in enumerate(merges))
        if in_order and first == 512 and model.get("end_of_word_suffix") == "</w>" and all(vocabulary.get(f"{c}</w>", -1) >= 256 for c in byte_of):
            import tiktoken

            ranks = {}
            for token, i in vocabulary.items():
                ends = i >= 256 and token.endswith("</w>")
                ranks[bytes(byte_of[c] for c in (token[:-4] if ends else token)) + b"\xff" * ends] = i
            plain = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        _coders[path] = Tokenizer.from_file(path), plain
    return _coders[path]


def _learn(words: list[bytes], path: str) -> None:
    """Puts the ids of words that are not cached into the cache."""
    tokenizer, plain = _coder(path)
    rest = []
    for w in words:
        m = _PLAIN.fullmatch(w) if plain else None
        if m is None:
            rest.append(w)
            continue
        ids = _cache.get(m[1]) if m[2] else None
        if ids is None:
            letters = m[1] if m[1].isalpha() else m[1].decode().lower().encode()
            ids = array("I", plain(letters + b"\xff")).tobytes()
        if m[2]:
            if m[2] not in _cache:
                _cache[m[2]] = array("I", tokenizer.encode(m[2].decode(), add_special_tokens=False).ids).tobytes()
            ids += _cache[m[2]]
        _cache[w] = ids
    if rest:
        for w, e in zip(rest, tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            _cache[w] = array("I", e.ids).tobytes()


def encode(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers.

    The vocabulary's normaliser and splitter never look across white space, so the ids of a text
    are those of its blank-separated words, which are looked up and tokenised once.
    """
    _coder(path)  # the cache belongs to this vocabulary
    out = []
    for raw in texts:
        words = raw.lower().translate(_SPLIT).split(b" ")  # bytes.lower changes A-Z only, as the normaliser would
        if b"<|" in raw:  # special tokens are matched before the normaliser
            words = [w if b"<|" in w else low for w, low in zip(raw.translate(_SPLIT).split(b" "), words, strict=True)]
        ids = list(map(_cache.get, words))
        if None in ids:
            if len(_cache) > CACHED_WORDS:
                _cache.clear()
            new = [i for i, x in enumerate(ids) if x is None]
            _learn(list({words[i] for i in new}), path)
            for i in new:
                ids[i] = _cache[words[i]]
        out.append(b"".join(ids))
    return out


class Packer:
    """Packs one task's documents; windows come out as soon as they are closed."""

    def __init__(self, partition: int, window: int = WINDOW, least: int = LEAST_TIER):
        self.window, self.least = window, least
        self.next_sequence = partition << 40
        self.pool: list[tuple[int, int]] = []  # (length, key), sorted
        self.pieces: dict[int, tuple] = {}  # key -> (doc_id, ids, start)
        self.waiting = self.keys = 0
        self.closed: dict[int, int] = {}  # tier -> windows
        self.rows: list[tuple] = []

    def tier(self, length: int) -> int:
        return max(self.least, 1 << (length - 1).bit_length())

    def put(self, doc_id, ids: bytes, start: int, length: int) -> None:
        self.keys += 1
        self.pieces[self.keys] = (doc_id, ids, start)
        insort(self.pool, (length, self.keys))
        self.waiting += length

    def take(self, at: int) -> tuple:
        length, key = self.pool.pop(at)
        self.waiting -= length
        return (*self.pieces.pop(key), length)

    def close(self, size: int, parts: list[tuple]) -> None:
        nth = self.closed.get(size, 0)
        self.closed[size] = nth + 1
        offset = 0
        for doc_id, ids, start, length in parts:
            self.rows.append((doc_id, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, self.next_sequence, offset, size, nth))
            offset += length
        self.next_sequence += 1

    def add(self, doc_id, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        while n - at >= self.window:
            self.close(self.window, [(doc_id, ids, at, self.window)])
            at += self.window
        if at < n:
            self.put(doc_id, ids, at, n - at)

    def fill(self, size: int) -> None:
        """Closes a window of `size` ids from the pool, which holds as many: longest fitting pieces first, then one cut."""
        parts, gap = [], size
        while gap:
            at = bisect_right(self.pool, (gap, self.keys + 1)) - 1
            if at >= 0:
                part = self.take(at)
                gap -= part[3]
                parts.append(part)
            else:  # all that wait are longer than the gap: cut the shortest
                doc_id, ids, start, length = self.take(0)
                parts.append((doc_id, ids, start, gap))
                self.put(doc_id, ids, start + gap, length - gap)
                gap = 0
        self.close(size, parts)

    def pack(self) -> None:
        while self.pool and self.waiting >= self.tier(self.pool[-1][0]):
            self.fill(self.tier(self.pool[-1][0]))

    def finish(self) -> None:
        self.pack()
        while self.waiting:
            self.fill(min(self.window, 1 << (self.waiting.bit_length() - 1)))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, least: int = LEAST_TIER, step_ids: int = STEP_IDS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    vocabulary: path of a tokenizers file that every executor can read (default: the installed public one).
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, nth long"
    names, kinds = [x.split()[0] for x in schema.split(", ")], [pa.int64()] * 7 + [pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        packer = Packer(TaskContext.get().partitionId(), window, least)
        end = END_ID.to_bytes(4, "little")

        def out() -> Iterator[pa.RecordBatch]:
            if packer.rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*packer.rows, strict=True), kinds, strict=True)], names)
                packer.rows = []

        size = 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            for i in range(len(texts)):
                raw = texts[i].as_py() or b""
                packer.add(ids[i].as_py(), encode([raw], path)[0] + end)
                size += len(raw)
                if size >= POOL_BYTES:
                    packer.pack()
                    yield from out()
                    size = 0
        packer.finish()
        yield from out()

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return _with_step_groups(written(pieces.withColumn("task", F.shiftright("sequence_id", 40))), step_ids)


def _with_step_groups(pieces: DataFrame, step_ids: int) -> DataFrame:
    """Windows of a tier, numbered over all tasks, in groups of step_ids ids; the tier stands in a group id's high bits."""
    counts = pieces.groupBy("task", "tier").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    starts = counts.select("task", "tier", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    group = F.shiftleft(F.col("tier").cast("long"), 40) + F.floor((F.col("begin") + F.col("nth")) * F.col("tier") / F.lit(step_ids)).cast("long")
    return pieces.join(starts, ["task", "tier"]).select(*(c for c in pieces.columns if c not in ("nth", "task")), group.alias("step_group"))
