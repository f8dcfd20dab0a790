"""Operator 13: token ids in Arrow stream files of equal-length sequences.

Format. A file is one Arrow IPC stream whose columns are `ids` and `mask`, both fixed-size lists of
SEQUENCE_IDS values, in batches of BATCH_SEQUENCES rows. All batches but the last are equally long, so the place of a
sequence follows from its number; TokenFile maps the file and gives any sequence, or any range
of ids, as views of the mapped pages, without copying or scanning. Ids are unsigned 16-bit integers where the
vocabulary fits into them, else 32-bit; mask is false on the padding that ends a file. Beside each file stands an index, a stream of (doc_id,
start, n_tokens), start counted from the file's first id.

Writing. One range exchange by doc_id; each task tokenises what it reads, in order, and streams it into one file:
a task holds a batch, not a file. A file is written under a name of its own attempt and then renamed, so a
lost executor leaves nothing that is read: only files of the manifest are, a small table with one row a file. Numbers of
ids before each file are added up over the manifest.

Tokens. The tokenizers file defines the ids. Where it is a byte-level vocabulary whose ids are the order of its merges, a second
library that reads the same vocabulary as ranks gives the same ids in a third of the time; texts with special
strings, or with characters outside ALIKE that two libraries might class differently, and files of any other layout go through the
tokenizers library.

Defined results: a null text is an empty one, whose only id is the end id; a null doc_id comes first; rows of one doc_id stand in
order of the text's 64-bit hash, and repeated rows one after another, each with its own ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import shared_folder, written

#: Production parameters: ids of a sequence, sequences of a batch, closing id of a document.
SEQUENCE_IDS, BATCH_SEQUENCES, END_ID = 2048, 64, 0
VOCABULARY = "byte_bpe_50k.json"

#: The splitter of byte-level vocabularies (fixed value).
_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class (letter, number, blank, other) is old and certain: Latin, Cyrillic, kana, common Han, Hangul and punctuation.
ALIKE = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u2038\u3001-\u3003\u3008-\u3011\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]*")


def _ranks(layout: dict) -> dict[bytes, int] | None:
    """Bytes of each token -> id of a byte-level vocabulary file, if ids follow its merges and it does nothing else to a text."""
    model, splitter = layout["model"], layout.get("pre_tokenizer") or {}
    if layout.get("normalizer") or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
        return None
    if model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    merges = [x if isinstance(x, str) else " ".join(x) for x in model["merges"]]
    if any(model["vocab"].get(x.replace(" ", "", 1)) != 256 + i for i, x in enumerate(merges)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    special = {x["content"] for x in layout.get("added_tokens", ())}
    ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in model["vocab"].items() if token not in special}
    return ranks if sorted(ranks.values()) == list(range(256 + len(merges))) else None


class Coder:
    """Ids of texts as bytes of little-endian integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.special = [x["content"] for x in layout.get("added_tokens", ())]
        self.plain = None
        ranks = _ranks(layout)
        if ranks is not None:
            import tiktoken

            self.plain = tiktoken.Encoding("ranks", pat_str=_SPLITTER, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[bytes]:
        alike = [self.plain is not None and ALIKE.fullmatch(x) is not None and not any(s in x for s in self.special) for x in texts]
        rest = iter(self.tokenizer.encode_batch_fast([x for x, plain in zip(texts, alike, strict=True) if not plain], add_special_tokens=False))
        return [array(self.code, self.plain(x) if plain else next(rest).ids).tobytes() for x, plain in zip(texts, alike, strict=True)]


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders.clear()
        _coders[path] = Coder(path)
    return _coders[path]


def place(path: str) -> tuple[filesystems.FileSystem, str]:
    return filesystems.FileSystem.from_uri(path)


class SequenceWriter:
    """Streams ids into a file of equal-length sequences."""

    def __init__(self, sink, kind: np.dtype, length: int, rows: int):
        self.length, self.rows, self.kind = length, rows, kind
        value = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        told = {"sequence_ids": str(length), "batch_sequences": str(rows)}
        self.schema = pa.schema([pa.field("ids", pa.list_(value, length)), pa.field("mask", pa.list_(pa.bool_(), length))], metadata=told)
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.ids = self.sequences = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        size = self.length * self.rows
        if self.waiting >= size:
            ids = np.concatenate(self.held)
            for at in range(0, len(ids) - size + 1, size):
                self._write(ids[at : at + size], size)
            rest = ids[len(ids) - len(ids) % size :].copy()
            self.held, self.waiting = [rest], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        values = pa.array(ids), pa.array(mask)
        self.stream.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, self.length) for x in values], schema=self.schema))
        self.sequences += len(ids) // self.length

    def close(self) -> None:
        if self.waiting:
            ids = np.concatenate(self.held)
            self._write(np.concatenate((ids, np.zeros(-len(ids) % self.length, self.kind))), len(ids))
        self.stream.close()


class TokenFile:
    """Random access to a file of equal-length sequences; local files are mapped, and what is returned is a view of the mapped pages."""

    def __init__(self, path: str):
        store, name = place(path)
        self.source = pa.memory_map(name) if isinstance(store, filesystems.LocalFileSystem) else store.open_input_file(name)
        self.schema = pa.ipc.read_schema(self.source)
        self.length, self.rows = (int(self.schema.metadata[x]) for x in (b"sequence_ids", b"batch_sequences"))
        self.first = self.source.tell()
        self.stride = 0
        self._at, self._batch = -1, None

    def batch(self, number: int) -> pa.RecordBatch:
        """The number-th batch, read at its place."""
        if number != self._at:
            if not self.stride and number:
                self.batch(0)
            self.source.seek(self.first + number * self.stride)
            message = pa.ipc.read_message(self.source)
            if not number:
                self.stride = self.source.tell() - self.first
            self._at, self._batch = number, pa.ipc.read_record_batch(message, self.schema)
        return self._batch

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of a sequence; ids are a view, mask is unpacked from its bits."""
        batch, row = self.batch(number // self.rows), number % self.rows
        ids, mask = (x.flatten().slice(row * self.length, self.length) for x in batch.columns)
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, stop: int) -> list[np.ndarray]:
        """Views that together are the ids from start to stop."""
        size, out = self.length * self.rows, []
        while start < stop:
            number, at = divmod(start, size)
            take = min(stop - start, size - at)
            out.append(self.batch(number).column(0).flatten().slice(at, take).to_numpy())
            start += take
        return out


_INDEX = pa.schema([pa.field("doc_id", pa.int64()), pa.field("start", pa.int64()), pa.field("n_tokens", pa.int64())])
MANIFEST = "file long, path string, documents long, n_ids long, sequences long"


def _write_files(folder: str, vocabulary: str, end_id: int, length: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, file, documents = None, TaskContext.get().partitionId(), 0
        path, attempt = f"{folder}/tokens-{file:08d}", uuid.uuid4().hex
        for whole in batches:
            if not len(whole):
                continue
            code = coder(vocabulary)
            if made is None:
                store, name = place(path)
                opened = [store.open_output_stream(f"{name}.{attempt}.{x}") for x in ("arrow", "index")]
                made, index = SequenceWriter(opened[0], code.kind, length, rows), pa.ipc.new_stream(opened[1], _INDEX)
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                found = code.encode([x or "" for x in batch.column("text").to_pylist()])
                ids = [np.append(np.frombuffer(x, code.kind), code.kind.type(end_id)) for x in found]
                n = np.array([len(x) for x in ids])
                index.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.ids + np.cumsum(n) - n), pa.array(n)], schema=_INDEX))
                made.add(np.concatenate(ids))
                documents += len(n)
        if made is not None:
            made.close()
            index.close()
            for x, sink in zip(("arrow", "index"), opened, strict=True):
                sink.close()
                store.move(f"{name}.{attempt}.{x}", f"{name}.{x}")
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, path, documents, made.ids, made.sequences)], [x.split()[0] for x in MANIFEST.split(", ")])

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, length: int = SEQUENCE_IDS, rows: int = BATCH_SEQUENCES) -> DataFrame:
    """Writes the ids of docs (doc_id, text) in ascending doc_id order; returns the manifest, one row a file, in file order by `file`.

    folder is one that all executors share; vocabulary is the path of a tokenizers file.
    """
    store, name = place(folder)
    store.create_dir(name)
    order = ["doc_id", "hash", "tie"]  # the tie lets equal rows of several tasks lie in several files
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("hash", F.xxhash64("text")).withColumn("tie", F.spark_partition_id())
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(ordered.mapInArrow(_write_files(folder, vocabulary, end_id, length, rows), MANIFEST))


def with_first_id(manifest: DataFrame) -> DataFrame:
    """The manifest with `first`, the number of ids in all files before; one row a file."""
    return manifest.withColumn("first", F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["first"])


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for manifest in batches:
        for path, first in zip(manifest.column("path").to_pylist(), manifest.column("first").to_pylist(), strict=True):
            file, (store, name) = TokenFile(f"{path}.arrow"), place(f"{path}.index")
            with store.open_input_stream(name) as source:
                for index in pa.ipc.open_stream(source):
                    starts, n = (index.column(x).to_numpy() for x in ("start", "n_tokens"))
                    ids = [np.concatenate([np.zeros(0, "<u4"), *file.ids(int(a), int(a + k))]).astype("<u4").tobytes() for a, k in zip(starts, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([index.column("doc_id"), pa.array(first + starts), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) from the files of a manifest; ids are little-endian unsigned 32-bit integers."""
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number, or small tables of paths would be one task
    files = written(with_first_id(manifest).select("file", "path", "first")).repartition(tasks, "file")
    return files.select("path", "first").mapInArrow(_read_files, "doc_id long, start long, n_tokens long, ids binary")


def _read_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for asked in batches:
        open_path, file = None, None
        for row in asked.to_pylist():
            if row["path"] != open_path:
                open_path, file = row["path"], TokenFile(f"{row['path']}.arrow")
            ids, mask = file.sequence(row["sequence"])
            yield pa.RecordBatch.from_pylist([{"file": row["file"], "sequence": row["sequence"], "ids": ids.tolist(), "mask": mask.tolist()}], pa.schema([("file", pa.int64()), ("sequence", pa.int64()), ("ids", pa.list_(pa.int64())), ("mask", pa.list_(pa.bool_()))]))


def read_sequences(manifest: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (file, sequence, ids, mask) of the asked (file, sequence) pairs, each read at its place."""
    dealt = asked.select("file", "sequence").join(manifest.select("file", "path"), "file").repartition("file").sortWithinPartitions("file", "sequence")
    return dealt.mapInArrow(_read_sequences, "file long, sequence long, ids array<long>, mask array<boolean>")


def default_vocabulary() -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(VOCABULARY))


def token_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The contract's columns: files are written to the cluster's shared folder and read back."""
    folder = f"{shared_folder(docs)}/lakeloom-{uuid.uuid4().hex}"
    manifest = write_token_files(docs, folder, vocabulary or default_vocabulary())
    return read_documents(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
