"""Chunkers.

The lines of a text are classified inside the row by Catalyst expressions (see functions.text); the
batches that reach Python then are flat arrays of marked lines, in which a document's end is one more
border. Section paths are running minima over the headings, blocks are runs of lines between borders,
and only the greedy packing of neighbours is a loop. Nothing is shuffled: a document's chunks depend on
nothing but the document.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SIZE, OVERLAP = 1800, 240
# Names of a section without a heading, and the separators of unit windows in order of preference.
WHOLE, OPENING = "全文", "开头"
SEPARATORS = ("\n\n", "。", "！", "？", "\n", ". ")


def check_size(size: int, overlap: int) -> None:
    if size < 200 or not 0 <= overlap < size:
        raise ValueError("size must be at least 200 and overlap from 0 to less than size")


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Hard windows of `size` characters, one every size - overlap."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.char_length(text) <= size, F.array(text)).otherwise(F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size))))


def marked_lines(text: Column, breaks: str = "\n") -> Column:
    """The lines of a text, each with its collapsed form (bare)."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), breaks)
    return F.transform(lines, lambda x: F.struct(x.alias("line"), T.collapse(x).alias("bare")))


class Lines:
    """Marked lines of a batch: fields as arrays, the document of each line, and each document's first line."""

    def __init__(self, column: pa.ListArray):
        count = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        self.fields = column.flatten()
        self.first = np.concatenate(([0], np.cumsum(count)))
        self.doc = np.repeat(np.arange(len(count)), count)

    def texts(self, name: str) -> list[str]:
        return self.fields.field(name).to_pylist()

    def numbers(self, name: str) -> np.ndarray:
        """A field of numbers or flags, null as 0."""
        return self.fields.field(name).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)

    def flags(self, name: str) -> np.ndarray:
        return self.numbers(name) != 0

    def runs(self, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the runs of solid lines that stay in one document."""
        opens = np.zeros(len(solid) + 1, bool)
        opens[self.first] = True
        before, after = np.concatenate(([False], solid[:-1])), np.concatenate((solid[1:], [False]))
        return np.flatnonzero(solid & (~before | opens[:-1])), np.flatnonzero(solid & (~after | opens[1:])) + 1


def section_paths(level: np.ndarray, doc: np.ndarray) -> list[list[int]]:
    """For headings in order of documents: the numbers of the headings on each one's path.

    A heading of level l after one at depth d stands at depth min(l, d + 1). So the i-th heading of a document has
    depth i + min(0, the least l_j - j up to it), and at each depth the last heading so far is on the path.
    """
    n = len(level)
    if not n:
        return []
    nth = np.arange(n) - np.searchsorted(doc, doc) + 1
    apart = doc * (n + 1)  # documents follow one another with ever smaller values, so minima do not cross
    depth = nth + np.minimum.accumulate(np.minimum(level - nth, 0) - apart) + apart
    last = [np.maximum.accumulate(np.where(depth == d, np.arange(n), -1)) for d in range(1, int(depth.max()) + 1)]
    return [[int(last[d][i]) for d in range(depth[i])] for i in range(n)]


def pieces_of(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Sentences packed up to size; longer ones in hard windows; every piece after the first is led by the end of the one before."""
    if len(text) <= size:
        return [text]
    hard = lambda s: [s[i : i + size] for i in range(0, len(s), size - overlap)]
    sentences = [s for s in map(str.strip, T.SENTENCE_END.split(text)) if s]
    if len(sentences) == 1:
        return hard(text)
    whole: list[str] = []
    for s in sentences:
        if len(s) > size:
            whole += [*hard(s), ""]  # the empty one keeps later sentences away
        elif whole and whole[-1] and len(whole[-1]) + 1 + len(s) <= size:
            whole[-1] += f" {s}"
        else:
            whole.append(s)
    whole = [x for x in whole if x]
    leads = ["", *(f"{x[-overlap:]} " if overlap else "" for x in whole)]
    return [(lead + x).strip() for lead, x in zip(leads, whole, strict=False)]


def gathered(parts: list[tuple], size: int) -> list[tuple]:
    """Neighbours (key, text, first, last) of one key joined by a blank line up to size; a part without a key stays alone."""
    out: list[tuple] = []
    for key, text, first, last in parts:
        if out and key is not None and out[-1][0] == key and len(out[-1][1]) + 2 + len(text) <= size:
            _, before, begin, _ = out.pop()
            out.append((key, f"{before}\n\n{text}", begin, last))
        else:
            out.append((key, text, first, last))
    return out


def separator_windows(text: str, size: int = 700, overlap: int = 100) -> Iterator[str]:
    """Windows that end after the best separator of their second half; each next one begins a little back."""
    text = text.strip()
    places = [[m.start() for m in re.finditer(f"(?={re.escape(s)})", text)] for s in SEPARATORS]
    begin, end = 0, 0
    while end < len(text):
        end = begin + size
        if end < len(text):
            for s, at in zip(SEPARATORS, places, strict=True):
                k = bisect_right(at, end - len(s))
                if k > bisect_left(at, begin + size // 2):
                    end = at[k - 1] + len(s)
                    break
        if window := text[begin:end].strip():
            yield window
        begin = max(begin + 1, end - overlap)


# --- styles: each marks lines by expressions and turns a batch of them into rows ------------------------------------


def _structured_lines(docs: DataFrame) -> DataFrame:
    mark = lambda x: F.struct(
        x["line"].alias("line"), (x["bare"] == "").alias("blank"), T.heading(x["bare"]).alias("h"),
        T.is_equation(x["line"]).alias("equation"), T.is_tabular(x["line"]).alias("tabular"), (F.size(F.split(x["line"], r"\$\$")) - 1).alias("dollars"),
    )
    return docs.select("doc_id", "title", F.transform(marked_lines(F.col("text")), mark).alias("lines"))


def blocks(batch: pa.RecordBatch) -> list[tuple]:
    """(row, section path, kind, text, first line, last line) of the blocks of lines between blank lines and headings."""
    lines = Lines(batch.column("lines"))
    found = lines.fields.field("h")
    head = found.is_valid().to_numpy(zero_copy_only=False)
    numbered = head & found.field("numbered").fill_null(False).to_numpy(zero_copy_only=False)
    titles = found.field("title").to_pylist()
    # below a bibliography's heading, numbered lines are entries until another heading without a number comes
    named = np.maximum.accumulate(np.where(head & ~numbered, np.arange(len(head)), -1)) if len(head) else np.zeros(0, np.int64)
    is_references = np.array([x is not None and x.lower().rstrip(":") == "references" for x in titles], bool)
    head &= ~(numbered & (named >= lines.first[lines.doc]) & is_references[np.maximum(named, 0)])
    at = np.flatnonzero(head)
    paths = section_paths(np.minimum(found.field("level").fill_null(1).to_numpy(zero_copy_only=False)[at], 6).astype(np.int64), lines.doc[at])
    begin, end = lines.runs(~head & ~lines.flags("blank"))
    text, doc = lines.texts("line"), lines.doc
    equation, tabular, dollars = (lines.numbers(c) for c in ("equation", "tabular", "dollars"))
    out = []
    for a, b, h in zip(begin.tolist(), end.tolist(), (np.searchsorted(at, begin) - 1).tolist(), strict=True):
        path = [titles[at[i]] for i in paths[h]] if h >= 0 and doc[at[h]] == doc[a] else [WHOLE]
        is_table = b - a >= 2 and tabular[a:b].sum() >= 0.6 * (b - a)
        kind = "equation" if equation[a:b].any() or dollars[a:b].sum() >= 2 else "table" if is_table else "body"
        out.append((int(doc[a]), path, kind, "\n".join(text[a:b]).strip(), a - int(lines.first[doc[a]]) + 1, b - int(lines.first[doc[a]])))
    return out


def _structured(batch: pa.RecordBatch, size: int, overlap: int) -> list[tuple]:
    parts = []
    for row, path, kind, text, first, last in blocks(batch):
        cut = pieces_of(text, size, overlap)
        alone = len(text) > size
        parts += [((row, tuple(path), kind, len(parts) if alone else -1, k), x, first, last) for k, x in enumerate(cut)] if alone else [((row, tuple(path), kind, -1, 0), text, first, last)]
    return [(row, path[-1], list(path), kind, first, last, text) for (row, path, kind, _, _), text, first, last in gathered(parts, size)]


#: What ends a line in flat sections.
_ANY_BREAK = r"[\n\x0B\x0C\x1C-\x1E\x85  ]"


def _flat_lines(docs: DataFrame) -> DataFrame:
    """Title, then abstract, stand before a text that lacks them."""
    text = F.coalesce("text", F.lit(""))
    whole = text
    for c in ("title", "abstract"):
        extra = F.trim(F.coalesce(F.col(c), F.lit("")))
        whole = F.when((extra != "") & ~F.contains(F.lower(text), F.lower(extra)), F.concat(extra, F.lit("\n\n"), whole)).otherwise(whole)
    return docs.select("doc_id", "title", F.transform(marked_lines(whole, _ANY_BREAK), lambda x: F.struct(x["line"].alias("line"), x["bare"].alias("bare"), T.is_loose_heading(x["bare"]).alias("head"))).alias("lines"))


def _legacy(batch: pa.RecordBatch, size: int, overlap: int) -> list[tuple]:
    lines = Lines(batch.column("lines"))
    bare, head = lines.texts("bare"), lines.flags("head")
    at = np.flatnonzero(head)
    begin, end = lines.runs(~head & np.array([x != "" for x in bare], bool))
    parts = []
    for a, b, h in zip(begin.tolist(), end.tolist(), (np.searchsorted(at, begin) - 1).tolist(), strict=True):
        row = int(lines.doc[a])
        section = bare[at[h]] if h >= 0 and lines.doc[at[h]] == row else WHOLE
        parts += [((row, section, h), x, 0, 0) for x in pieces_of(" ".join(bare[a:b]), size, overlap)]
    return [(row, section, text) for (row, section, _), text, _, _ in gathered(parts, size)]


def line_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, section, text): flat sections by heading lines; sections without text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = Lines(batch.column("lines"))
            text, bare, head = lines.texts("line"), lines.texts("bare"), lines.flags("head")
            at = np.flatnonzero(head)
            begin, end = lines.runs(~head)
            rows = []
            for a, b, h in zip(begin.tolist(), end.tolist(), (np.searchsorted(at, begin) - 1).tolist(), strict=True):
                row = lines.doc[a]
                own = h >= 0 and lines.doc[at[h]] == row
                number = h + 1 - int(np.searchsorted(at, lines.first[row]))
                if body := "\n".join(text[a:b]).strip():
                    rows.append((int(row), number if own else 0, bare[at[h]] if own else WHOLE, body))
            if rows:
                row, number, section, body = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(number, pa.int64()), pa.array(section, pa.string()), pa.array(body, pa.string())], ["doc_id", "section_no", "section", "text"])

    bare = docs.select("doc_id", "text").withColumns({"title": F.lit(""), "abstract": F.lit("")})
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _flat_lines(bare).select("doc_id", "lines").mapInArrow(run, f"doc_id {kind}, section_no long, section string, text string")


def _unit_lines(docs: DataFrame) -> DataFrame:
    mark = lambda x: F.struct(x["line"].alias("line"), (x["bare"] != "").alias("filled"), F.nullif(F.regexp_extract(x["line"], r"^#{1,6}\s+(.+?)\s*$", 1), F.lit("")).alias("head"))
    return docs.select("doc_id", "title", F.transform(marked_lines(F.col("text"), _ANY_BREAK), mark).alias("lines"))


def _units(batch: pa.RecordBatch, size: int, overlap: int) -> list[tuple]:
    """Windows of the stretches that begin with a document or a heading, which belongs to its stretch."""
    lines = Lines(batch.column("lines"))
    text, heads, filled = lines.texts("line"), lines.texts("head"), lines.flags("filled")
    cut = np.array([x is not None for x in heads], bool)
    cut[lines.first[:-1]] = True
    begin = np.flatnonzero(cut).tolist()
    return [
        (int(lines.doc[a]), heads[a] or OPENING, window)
        for a, b in zip(begin, [*begin[1:], len(text)], strict=True)
        if filled[a:b].any()
        for window in separator_windows("\n".join(text[a:b]), size, overlap)
    ]


_PLAIN = "section string, text string"
_MORE = "section string, section_path array<string>, paragraph_type string, start_line long, end_line long, text string"
#: Style -> (lines, rows of a batch, their columns after the row's number, size, overlap, parts of a chunk's id, digits of it).
STYLES: dict[str, tuple[Callable, Callable, str, int, int, tuple, int]] = {
    "legacy": (_flat_lines, _legacy, _PLAIN, SIZE, OVERLAP, ("chunk_index", "section", "text"), 20),
    "structured": (_structured_lines, _structured, _MORE, SIZE, OVERLAP, ("path", "paragraph_type", "start_line", "end_line", "chunk_index", "text"), 20),
    "units": (_unit_lines, _units, _PLAIN, 700, 100, ("section", "chunk_index", "text"), 16),
}


def chunk(docs: DataFrame, style: str = "structured", size: int | None = None, overlap: int | None = None) -> DataFrame:
    """Chunks of docs (doc_id, text, and title and abstract if there): chunk_id, parent_id, chunk_index, title and the style's columns."""
    lines, make, columns, s, o, identity, digits = STYLES[style]
    s, o = size or s, o if overlap is None else overlap
    check_size(s, o)
    names = ["parent_id", "given", "chunk_index", *(x.split()[0] for x in columns.split(", "))]
    kinds = [pa.string(), pa.string(), pa.int64(), *({"string": pa.string(), "long": pa.int64()}.get(x.split()[1], pa.list_(pa.string())) for x in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = make(batch, s, o)
            if rows:
                own, *rest = zip(*rows, strict=True)
                index = np.arange(len(own)) - np.searchsorted(own, own)
                made = [batch.column("doc_id").take(pa.array(own)), batch.column("title").take(pa.array(own)), pa.array(index), *rest]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names)

    given = docs.withColumns({c: F.lit("") for c in ("title", "abstract") if c not in docs.columns}).withColumn("doc_id", F.col("doc_id").cast("string"))
    got = lines(given).mapInArrow(run, f"parent_id string, given string, chunk_index long, {columns}")
    path = F.array_join("section_path", " / ") if "section_path" in names else F.col("section")
    title = F.lit("") if style == "units" else F.regexp_replace(F.concat(F.trim(F.coalesce("given", F.lit(""))), F.lit(" — "), path), r"^[ —]+|[ —]+$", "")
    parts = {"path": path, "chunk_index": F.col("chunk_index") + 1}
    chunk_id = T.short_id(F.col("parent_id"), *(parts.get(c, F.col(c)) for c in identity), length=digits)
    return got.select(chunk_id.alias("chunk_id"), "parent_id", "chunk_index", title.alias("title"), *names[3:])


def chunk_windows(chunks: DataFrame, window_chars: int = 28000, max_windows: int = 8) -> DataFrame:
    """Whole chunks of a parent in greedy windows of at most window_chars: window_no (null beyond max_windows), and the parent's number of chunks left out.

    The running sum with resets folds over one parent's chunks in order.
    """
    one = F.struct("chunk_index", "chunk_id", F.char_length("text").alias("n"))
    ordered = chunks.groupBy("parent_id").agg(F.array_sort(F.collect_list(one)).alias("c"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + x["n"] > window_chars)
        no = acc["no"] + full.cast("int")
        return F.struct(no.alias("no"), (F.when(full, 0).otherwise(acc["used"]) + x["n"]).alias("used"), F.concat(acc["out"], F.array(F.struct(x["chunk_id"].alias("chunk_id"), no.alias("no")))).alias("out"))

    start = F.struct(F.lit(0).alias("no"), F.lit(0).alias("used"), F.array().cast("array<struct<chunk_id:string,no:int>>").alias("out"))
    folded = ordered.select("parent_id", F.aggregate("c", start, step)["out"].alias("out"))
    omitted = F.size(F.filter("out", lambda x: x["no"] >= max_windows)).cast("long")
    rows = folded.select("parent_id", omitted.alias("omitted_chunks"), F.explode("out").alias("x"))
    return rows.select("parent_id", F.col("x.chunk_id").alias("chunk_id"), F.when(F.col("x.no") < max_windows, F.col("x.no").cast("long")).alias("window_no"), "omitted_chunks")
