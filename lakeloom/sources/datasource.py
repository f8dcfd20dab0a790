"""Spark data sources for files that have an order inside: spark.read.format(name).load(path), and the same as a stream of new files.

Each row carries its file and its place in it, so "the first entry" is a property of the data and not of how it was
split. Files are dealt to tasks by size; a file is read as a stream, so a task holds one entry. Names: atom_feed
(entries of Atom files), text_units (a text file is a unit, pages of a pdf are units), report_files (JSON objects, broken ones marked).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import ParseError, XMLPullParser

import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of files that one task reads, bytes read at a time, and rows of a batch.
TASK_BYTES, PIECE, ROWS = 64 << 20, 1 << 16, 500


@dataclass
class Part(InputPartition):
    paths: list[str]


class Files(DataSource):
    """Files below a path; a subclass says which, and how one becomes rows. columns is the schema after file and place."""

    endings: tuple[str, ...] = ()
    columns = ""

    def schema(self) -> str:
        return f"file string, place long, {self.columns}"

    def found(self) -> list[tuple[int, str, int]]:
        """(time, uri, size) of all files, oldest first and then by name."""
        root = self.options["path"]
        store, name = filesystems.FileSystem.from_uri(root)
        scheme = root[: len(root) - len(name)] if root.endswith(name) else ""
        info = store.get_file_info(name)
        every = [info] if info.type == filesystems.FileType.File else store.get_file_info(filesystems.FileSelector(name, recursive=True))
        named = [x for x in every if x.type == filesystems.FileType.File and x.base_name.lower().endswith(self.endings) and not x.base_name.startswith(("_", "."))]
        return sorted((x.mtime_ns or 0, f"{scheme}{x.path}", x.size) for x in named)

    def rows(self, uri: str, pieces: Iterator[bytes]) -> Iterator[tuple]:
        raise NotImplementedError

    def read_part(self, part: Part, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for uri in part.paths:
            store, name = filesystems.FileSystem.from_uri(uri)
            with store.open_input_stream(name) as stream:
                for place, row in enumerate(self.rows(uri, iter(lambda: stream.read(PIECE), b""))):
                    held.append((uri, place, *row))
                    if len(held) == ROWS:
                        yield _batch(held, schema)
                        held = []
        if held:
            yield _batch(held, schema)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self, schema)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _parts(found: list[tuple[int, str, int]]) -> list[Part]:
    """Files in tasks of about TASK_BYTES; a larger file is a task by itself."""
    out, size = [Part([])], 0
    for _, uri, n in found:
        if out[-1].paths and size + n > TASK_BYTES:
            out.append(Part([]))
            size = 0
        out[-1].paths.append(uri)
        size += n
    return out


class _Reader(DataSourceReader):
    def __init__(self, source: Files, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.source, self.schema = source, to_arrow_schema(schema)

    def partitions(self) -> list[Part]:
        return _parts(self.source.found())

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.source.read_part(partition, self.schema)


class _StreamReader(DataSourceStreamReader):
    """The offset is how many files, oldest first, were read; files are never changed once they are there."""

    def __init__(self, source: Files, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.source, self.schema = source, to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self.source.found())}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return _parts(self.source.found()[start["files"] : end["files"]])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.source.read_part(partition, self.schema)


class AtomFeed(Files):
    """Entries of Atom files, in their order. What follows a fault in a file is lost, and a row with the fault in `fault` says so."""

    endings = (".xml", ".atom", ".txt")
    columns = "id string, title string, summary string, published string, updated string, author array<string>, fault string"

    @classmethod
    def name(cls) -> str:
        return "atom_feed"

    def rows(self, uri: str, pieces: Iterator[bytes]) -> Iterator[tuple]:
        parser, first = XMLPullParser(["end"]), True
        parser.feed(b"<files>")  # one root, whether the file has one or a row of entries
        try:
            for piece in pieces:
                if first and piece.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"<?xml"):
                    piece = piece[piece.index(b"?>") + 2 :]
                first = False
                parser.feed(piece)
                yield from self._ended(parser)
            parser.feed(b"</files>")
            yield from self._ended(parser)
        except (ParseError, ValueError) as e:
            yield None, None, None, None, None, None, str(e)[:200]

    @staticmethod
    def _ended(parser: XMLPullParser) -> Iterator[tuple]:
        plain = lambda x: x.tag.rpartition("}")[2]
        for _, node in parser.read_events():
            if plain(node) != "entry":
                continue
            text = {plain(x): "".join(x.itertext()) for x in node if plain(x) != "author"}
            authors = ["".join(n.itertext()) for x in node if plain(x) == "author" for n in x if plain(n) == "name"]
            yield *(text.get(k) for k in ("id", "title", "summary", "published", "updated")), authors, None
            node.clear()


class TextUnits(Files):
    """Units of documents: a md or txt file is one, with undecodable bytes replaced; each page of a pdf is one, where pypdf is installed."""

    endings = (".md", ".txt", ".pdf")
    columns = "section string, text string"

    @classmethod
    def name(cls) -> str:
        return "text_units"

    def rows(self, uri: str, pieces: Iterator[bytes]) -> Iterator[tuple]:
        data = b"".join(pieces)
        if not uri.lower().endswith(".pdf"):
            yield None, data.decode("utf-8", "replace").removeprefix("﻿")
            return
        try:
            from pypdf import PdfReader
        except ImportError:
            return
        import io

        for n, page in enumerate(PdfReader(io.BytesIO(data)).pages, 1):
            yield f"第 {n} 页", page.extract_text() or ""


class ReportFiles(Files):
    """JSON reports: the object as text, or null and the reason where a file is no JSON object."""

    endings = (".json",)
    columns = "report string, fault string"

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def rows(self, uri: str, pieces: Iterator[bytes]) -> Iterator[tuple]:
        try:
            found = json.loads(b"".join(pieces).decode("utf-8-sig"))
            yield (json.dumps(found, ensure_ascii=False), None) if isinstance(found, dict) else (None, "not an object")
        except ValueError as e:
            yield None, type(e).__name__


def register(spark: SparkSession) -> SparkSession:
    """Makes the formats known to a session."""
    for source in (AtomFeed, TextUnits, ReportFiles):
        spark.dataSource.register(source)
    return spark
