"""Operator 11: conversation structure repair by error-correcting Earley parsing.

A conversation's role initials have to form `(s?(ua)+)?`. The weighted grammar has that language's
productions and error productions beside them: a terminal may be reroled (u and a only), inserted (u
and a only), and any row may be deleted. A chart item keeps its least (cost, audit); audits are the
edits' initials, and equal costs take the ASCII-least one. The grammar is left-linear (a nonterminal
stands only at the head of a production), so every item starts at the conversation's beginning,
completion looks no further than the predicted items, and a chart set holds a handful of items
however long the conversation is.

Plan. Rows alike in conversation, turn, role and text are folded to one with a number of copies
(map-side combined); rows whose role and text stand earlier are found by one aggregate and a join that
the engine can split; then one range exchange by (conversation, turn, role, text hash) sorts the rows, and
each task parses what it reads. A conversation inside one task is done there. One that crosses tasks
or has more than PART_ROWS rows is cut into parts: for each part the chart is run from every item that can
be open at its start, which gives the least (cost, audit piece) from each item to each item; the parts'
tables are chained in order, holding one pointer an item and part, and the chosen pieces are joined back
to their parts. So neither a task nor a group ever holds a whole hot conversation.

Why chaining may compare by rank: audits at a part's end consume the same rows and end with a
consuming edit, so none is a proper prefix of another, and appending the same edits keeps their order.

Defined results: null role and text are one space each, a null turn comes first and is left out of
gaps, rows of one turn stand in order of role and then of the SHA-256 of their text; a null
conversation id is an id like others; an empty role has no initial and is never legal; repeated
rows are duplicates; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import written

#: Production parameters: folded rows and text characters of one part.
PART_ROWS, PART_CHARS = 1024, 1 << 20
#: Weights of the edits, and of a kept or reroled row that is cut off.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

#: (left side, right side); `$` ends the input. Terminals are s, u, a and $.
GRAMMAR = (
    ("goal", ("talk", "$")),
    ("talk", ()),
    ("talk", ("turns",)),
    ("turns", ("lead", "u", "a")),
    ("turns", ("turns", "u", "a")),
    ("lead", ()),
    ("lead", ("s",)),
)
#: Chart items are (production, dot); the items that prediction puts into the first set, and the one that accepts.
START = tuple((p, 0) for p in range(len(GRAMMAR)))
ACCEPT = (0, 1)
#: Items that can be in a set right after a row was consumed: entry -1 of a table is the first set.
ITEMS = tuple((p, d) for p, (_, right) in enumerate(GRAMMAR) for d in range(len(right) + 1))
NUMBER = {x: i for i, x in enumerate(ITEMS)}

Value = tuple[int, str]
Chart = dict[tuple[int, int], Value]


def next_symbol(item: tuple[int, int]) -> str | None:
    right = GRAMMAR[item[0]][1]
    return right[item[1]] if item[1] < len(right) else None


def closed(kernel: Chart) -> Chart:
    """A set with all that completion and insertion add to it, least values first."""
    done: Chart = {}
    heap = [(value, item) for item, value in kernel.items()]
    heapq.heapify(heap)
    while heap:
        value, item = heapq.heappop(heap)
        if item in done:
            continue
        done[item] = value
        symbol = next_symbol(item)
        if symbol is None:
            left = GRAMMAR[item[0]][0]
            for p, (_, right) in enumerate(GRAMMAR):
                if right[:1] == (left,):
                    heapq.heappush(heap, (value, (p, 1)))
        elif symbol in NAMES:
            heapq.heappush(heap, ((value[0] + INSERT, f"{value[1]}I"), (item[0], item[1] + 1)))
    return done


def scanned(chart: Chart, letter: str) -> Chart:
    """The kernel after a row; its letter is its role's initial or o, in upper case if the row is cut off."""
    initial, more = letter.lower(), CUT_OFF * letter.isupper()
    kernel: Chart = {}
    for item, (cost, audit) in chart.items():
        symbol = next_symbol(item)
        if symbol is None or symbol in ("talk", "turns", "lead"):
            continue
        found = [(item, (cost + DELETE, f"{audit}D"))]
        if symbol == initial:
            found.append(((item[0], item[1] + 1), (cost + KEEP + more, f"{audit}K")))
        elif symbol in NAMES:
            found.append(((item[0], item[1] + 1), (cost + REROLE + more, f"{audit}R")))
        for to, value in found:
            if to not in kernel or value < kernel[to]:
                kernel[to] = value
    return kernel


def passed(letters: str, kernel: Chart) -> Chart:
    for letter in letters:
        kernel = scanned(closed(kernel), letter)
    return kernel


def parsed(letters: str) -> Value:
    """Least (cost, audit) of a whole conversation."""
    return closed(passed(letters, {x: (0, "") for x in START}))[ACCEPT]


_short = lru_cache(1 << 16)(parsed)
#: From each item to acceptance without another row.
ENDINGS = {x: v for x in ITEMS if (v := closed({x: (0, "")}).get(ACCEPT))}


def table_of(letters: str) -> list[tuple[int, int, int, str]]:
    """(entry item, exit item, cost, audit piece) of a part; entry -1 is the beginning of a conversation."""
    out = []
    for entry in range(-1, len(ITEMS)):
        kernel = {ITEMS[entry]: (0, "")} if entry >= 0 else {x: (0, "") for x in START}
        for item, (cost, audit) in passed(letters, kernel).items():
            out.append((entry, NUMBER[item], cost, audit))
    return out


def with_deletions(audit: str, runs: list[int]) -> str:
    """The audit of all rows from that of the rows that may stay: runs[i] deletions follow the i-th of these (0: stand before the first)."""
    if not any(runs):
        return audit
    out, i = ["D" * runs[0]], 0
    for x in audit:
        out.append(x)
        if x != "I":
            i += 1
            out.append("D" * runs[i])
    return "".join(out)


def rendered(audit: str, rows: list[tuple[str, str]], role: str = "u") -> list[tuple[str, str]]:
    """Repaired (role, text) rows; rows are those that the audit consumes, role is what an insertion gives first."""
    out, at = [], 0
    for x in audit:
        if x == "K":
            out.append(rows[at])
            role = "a" if rows[at][0][:1] == "u" else "u"
        elif x in "RI":
            out.append((NAMES[role], rows[at][1] if x == "R" else ""))
            role = "a" if role == "u" else "u"
        at += x != "I"
    return out


class Part:
    """Rows of one conversation, in order, as far as they stand in one part."""

    def __init__(self, conv, first: bool, most: int):
        self.conv, self.first, self.most = conv, first, most
        self.letters, self.rows, self.runs, self.chars = [], [], [0], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.initials: list[str] = []

    def add(self, turn, role: str, text: str, n: int, blank: bool, later: bool, cut: bool) -> None:
        if turn is not None and n:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if not n:
            return
        initial = role[:1]
        self.illegal += n - 1
        if self.initials:
            self.illegal += self.initials[-1] + initial not in LEGAL
        self.initials = [*self.initials[:1], initial]
        if blank or later:
            self.blank += n * blank
            self.duplicate += n * (not blank)
            self.runs[-1] += n
            return
        self.duplicate += n - 1
        self.truncated += cut
        letter = initial if initial in ("s", "u", "a") else "o"
        self.letters.append(letter.upper() if cut else letter)
        self.rows.append((role, text))
        self.runs.append(n - 1)
        self.chars += len(text)

    @property
    def full(self) -> bool:
        return len(self.rows) >= self.most or self.chars >= PART_CHARS

    def row(self, part: int, last: bool) -> dict:
        letters, out = "".join(self.letters), {"conv_id": self.conv, "part": part, "low": self.low, "high": self.high}
        out |= {"turns": self.turns, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}
        out |= {"initials": [*self.initials[:1], *self.initials[-1:]]}
        if self.first and last:
            cost, audit = (_short if len(letters) < 64 else parsed)(letters)
            return out | {"cost": cost + DELETE * sum(self.runs), "audit": with_deletions(audit, self.runs), "repaired": rendered(audit, self.rows)}
        return out | {"cost": DELETE * sum(self.runs), "moves": table_of(letters), "rows": self.rows, "runs": self.runs}


_TURNS = "array<struct<role: string, text: string>>"
_COUNTS = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, initials array<string>"
_SUMS = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long"
_PASSED = f"part long, {_COUNTS}, cost long, audit string, repaired {_TURNS}, moves array<struct<entry: int, exit: int, cost: long, piece: string>>, rows {_TURNS}, runs array<long>"


def _parts(schema: pa.Schema, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, open_part, begun, out = TaskContext.get().partitionId() << 32, 0, None, False, []

        def close(last: bool):
            nonlocal number
            out.append(open_part.row(base + number, last))
            number += 1

        for batch in batches:
            for conv, turn, role, text, n, blank, later, cut in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if open_part is None or open_part.conv != conv:
                    if open_part is not None:
                        close(True)
                    # whether the first conversation of a task began in an earlier one is not known here
                    open_part, begun = Part(conv, begun, most), True
                elif open_part.full:
                    close(False)
                    open_part = Part(conv, False, most)
                open_part.add(turn, role, text, n, blank, later, cut)
            if len(out) >= 256 or sum(len(x.get("rows", ())) for x in out) >= PART_ROWS:
                yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in schema.names} for x in out], schema)
                out.clear()
        if open_part is not None:
            close(False)  # nor whether the last one goes on in the next
        if out:
            yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in schema.names} for x in out], schema)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """(begins a conversation, row) of rows sorted by conversation."""
    held, any_yet = None, False
    for batch in batches:
        for row in batch.to_pylist():
            yield not any_yet or row["conv_id"] != held, row
            held, any_yet = row["conv_id"], True


def _chained(schema: pa.Schema):
    """Parts of a conversation in order -> the entry and exit item of each, with the conversation's sums on its last part."""

    def finish(sums: dict, state: dict, backs: list) -> list[dict]:
        item = min((x for x in state if ITEMS[x] in ENDINGS), key=lambda x: (state[x][0] + ENDINGS[ITEMS[x]][0], state[x][1], ENDINGS[ITEMS[x]][1]))
        cost, tail = ENDINGS[ITEMS[item]]
        parts = len(backs)
        out = [{"conv_id": sums["conv_id"], "parts": parts, "low": sums["low"], "high": sums["high"], **{k: sums[k] for k in ("turns", "blank", "duplicate", "truncated", "illegal")}, "cost": sums["cost"] + state[item][0] + cost, "tail": tail}]
        for part, back in reversed(backs):
            entry = back[item]
            out.append({"conv_id": sums["conv_id"], "parts": parts, "part": part, "entry": entry, "exit": item})
            item = entry
        out[0] |= {k: out[1][k] for k in ("part", "entry", "exit")}
        del out[1]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, state, backs = None, {}, []
        for new, row in _grouped(batches):
            if new:
                if sums is not None:
                    yield from batched(finish(sums, state, backs), schema)
                sums, state, backs = dict(row) | {"initials": []} | {k: 0 for k in ("turns", "blank", "duplicate", "truncated", "illegal", "cost")} | {"low": None, "high": None}, {-1: (0, 0)}, []
            sums["turns"] += row["turns"] - (row["low"] is not None and row["low"] == sums["high"])
            sums["low"] = row["low"] if sums["low"] is None else sums["low"]
            sums["high"] = row["high"] if row["high"] is not None else sums["high"]
            for k in ("blank", "duplicate", "truncated", "illegal", "cost"):
                sums[k] += row[k]
            if row["initials"]:
                sums["illegal"] += bool(sums["initials"]) and sums["initials"][-1] + row["initials"][0] not in LEGAL
                sums["initials"] = row["initials"]
            best: dict[int, tuple] = {}
            for move in row["moves"]:
                if (at := state.get(move["entry"])) is not None:
                    found = (at[0] + move["cost"], at[1], move["piece"], move["entry"])
                    if move["exit"] not in best or found < best[move["exit"]]:
                        best[move["exit"]] = found
            ranks = {x: i for i, x in enumerate(sorted({x[1:3] for x in best.values()}))}
            state = {k: (x[0], ranks[x[1:3]]) for k, x in best.items()}
            backs.append((row["part"], {k: x[3] for k, x in best.items()}))
        if sums is not None:
            yield from batched(finish(sums, state, backs), schema)

    return run


def batched(rows: list[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in schema.names} for x in rows[i : i + size]], schema)


def _chosen(schema: pa.Schema):
    """Parts with their entry and exit items -> audit piece and repaired rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                audit = next(x["piece"] for x in row["moves"] if (x["entry"], x["exit"]) == (row["entry"], row["exit"])) + (row["tail"] or "")
                rows = [(x["role"], x["text"]) for x in row["rows"]]
                role = "a" if row["entry"] >= 0 and next_symbol(ITEMS[row["entry"]]) == "a" else "u"
                row |= {"audit": with_deletions(audit, row["runs"]), "repaired": rendered(audit, rows, role), "last": row["tail"] is not None}
                yield from batched([row], schema)

    return run


def arrow_schema(frame: DataFrame, ddl: str) -> pa.Schema:
    """Arrow form of a schema given as DDL after the column conv_id of frame."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(frame.sparkSession.createDataFrame([], f"conv_id {frame.schema['conv_id'].dataType.simpleString()}, {ddl}").schema)


def repaired(rows: DataFrame, copies: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """One row for each part of a conversation; most have one part.

    rows: conv_id, turn, role, text; copies names a column with the number of times that a row stands there (0: it
    only says that the conversation exists). Returns conv_id, part (ascending inside a conversation),
    parts (their number), last, audit, repaired (array of role and text), and on the last part the conversation's sums low, high, turns,
    blank, duplicate, truncated, illegal and cost.
    """
    n = F.col(copies) if copies else F.lit(1)
    there = n > 0
    kept = rows.select("conv_id", F.when(there, F.col("turn").cast("long")).alias("turn"), *(F.when(there, F.coalesce(F.col(x).cast("string"), F.lit(" "))).otherwise("").alias(x) for x in ("role", "text")), n.cast("long").alias("n"))
    kept = kept.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    kept = kept.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("hash", F.sha2("text", 256))
    again = kept.where("not blank and n > 0").groupBy("conv_id", "role", "hash").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("turn")).alias("first")).where("places > 1")
    again = written(again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), F.col("first.turn").alias("first"), F.lit(True).alias("found")))
    kept = kept.join(again, kept.conv_id.eqNullSafe(again.c) & (kept.role == again.r) & (kept.hash == again.h), "left")
    kept = kept.select(
        "conv_id", "turn", "role", "text", "n", "blank",
        F.coalesce(F.col("found") & ~F.col("turn").eqNullSafe(F.col("first")), F.lit(False)).alias("later"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"), F.left("hash", F.lit(16)).alias("tie"),
    )
    order = ["conv_id", "turn", "role", "tie"]
    kept = kept.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("tie")
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, "
    parts = written(kept.mapInArrow(_parts(arrow_schema(rows, _PASSED), part_rows), ddl + _PASSED))
    whole = parts.where("moves is null")
    pending = parts.where("moves is not null")
    chosen = f"part long, parts long, entry int, exit int, tail string, {_SUMS}"
    narrow = pending.drop("rows", "runs", "repaired", "audit").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    chosen_parts = narrow.mapInArrow(_chained(arrow_schema(rows, chosen)), ddl + chosen).drop("conv_id")
    final = f"part long, parts long, last boolean, audit string, repaired {_TURNS}, {_SUMS}"
    cut = pending.select("conv_id", "part", "moves", "rows", "runs").join(chosen_parts, "part").mapInArrow(_chosen(arrow_schema(rows, final)), ddl + final)
    return whole.select("conv_id", "part", F.lit(1).cast("long").alias("parts"), F.lit(True).alias("last"), "audit", "repaired", *(x.split()[0] for x in _SUMS.split(", "))).unionByName(cut)


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's damage: conv_id, turn, role, text, copies; what it does to a row follows from crc32(`conv_id:turn`) % 20."""
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(x).cast("string"), space) for x in ("conv_id", "turn")))
    text, role, hit = F.coalesce("text", space), F.coalesce("role", space), F.crc32(key.cast("binary")) % 20
    return conversations.select(
        "conv_id", "turn",
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"),
    )


def _digests(schema: pa.Schema):
    """Parts in order -> one row a conversation: audit pieces joined, SHA-256 taken as the parts come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, sha, any_row = [], hashlib.sha256(), False
        for new, row in _grouped(batches):
            if new:
                audit, sha, any_row = [], hashlib.sha256(), False
            audit.append(row["audit"])
            if row["repaired"]:
                sha.update((b"\n" if any_row else b"") + "\n".join(f"{x['role']}:{x['text']}" for x in row["repaired"]).encode())
                any_row = True
            if row["last"]:
                yield from batched([row | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema)

    return run


def repair_digests(conversations: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The contract's columns for every original conv_id, from the repaired turns of the damaged table.

    SHA-256 has no parallel form, so the repaired text of a conversation of several parts runs through one task, as a
    stream of parts.
    """
    found = written(repaired(damaged(conversations), "copies", part_rows))
    out = f"audit string, repaired_sha256 string, {_SUMS}"
    ddl = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, "
    text = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    one = found.where("parts = 1").withColumn("repaired_sha256", F.sha2(text, 256))
    many = found.where("parts > 1").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_digests(arrow_schema(conversations, out)), ddl + out)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    columns = ["conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return one.select(*columns).unionByName(many.select(*columns))


#: The same rows in SQL: crc32 by its rule, the cheapest path over the states of the pattern (0 nothing yet, 1 after s, 2 after u, 3 after a) row by row.
ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS t),
hit AS (
  SELECT c.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS h
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations) c, crc),
damaged AS (
  SELECT conv_id, turn, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy,
    CASE h WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM hit WHERE h <> 0),
marked AS (
  SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before, left(role, 1) AS initial,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS later,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
moves(src, dst, sees, letters, cost) AS (
  VALUES (0, 0, '', 'D', 4), (1, 1, '', 'D', 4), (2, 2, '', 'D', 4), (3, 3, '', 'D', 4),
    (0, 1, 's', 'K', 0), (0, 2, 'u', 'K', 0), (1, 2, 'u', 'K', 0), (3, 2, 'u', 'K', 0), (2, 3, 'a', 'K', 0),
    (0, 2, '', 'R', 3), (1, 2, '', 'R', 3), (3, 2, '', 'R', 3), (2, 3, '', 'R', 3),
    (0, 3, 'a', 'IK', 3), (1, 3, 'a', 'IK', 3), (3, 3, 'a', 'IK', 3), (2, 2, 'u', 'IK', 3),
    (0, 3, '', 'IR', 6), (1, 3, '', 'IR', 6), (3, 3, '', 'IR', 6), (2, 2, '', 'IR', 6)),
ends(src, letters, cost) AS (VALUES (0, '', 0), (1, 'II', 6), (2, 'I', 3), (3, '', 0)),
paths AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {'c': 0::BIGINT, 'a': ''} AS v FROM conversations
  UNION ALL
  SELECT p.conv_id, p.i + 1, m.dst, min({'c': p.v.c + m.cost + CASE WHEN r.cut AND m.letters <> 'D' THEN 3 ELSE 0 END, 'a': p.v.a || m.letters})
  FROM paths p JOIN marked r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
  JOIN moves m ON m.src = p.state AND (m.sees = '' OR m.sees = r.initial) AND (m.letters = 'D' OR NOT (r.blank OR r.later))
  GROUP BY p.conv_id, p.i, m.dst),
best AS (
  SELECT p.conv_id, min({'c': p.v.c + e.cost, 'a': p.v.a || e.letters}) AS v
  FROM paths p JOIN ends e ON e.src = p.state
  WHERE p.i = (SELECT count(*) FROM marked r WHERE r.conv_id IS NOT DISTINCT FROM p.conv_id)
  GROUP BY p.conv_id),
steps AS (
  SELECT conv_id, pos, letter, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS place, length(replace(a, 'D', '')) AS size
  FROM (SELECT conv_id, v.a AS a, unnest(range(1, length(v.a) + 1)) AS pos, substr(v.a, pos, 1) AS letter FROM best)
  WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
repaired AS (
  SELECT s.conv_id, string_agg(CASE WHEN letter = 'K' THEN r.role WHEN (s.size - s.place) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY pos) AS text
  FROM steps s LEFT JOIN marked r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i WHERE letter <> 'D' GROUP BY s.conv_id),
sums AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND later) AS duplicate,
    count(*) FILTER (NOT blank AND NOT later AND cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id)
SELECT b.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate,
  coalesce(s.truncated, 0)::BIGINT AS truncated, coalesce(s.illegal, 0)::BIGINT AS illegal, b.v.c::BIGINT AS cost, b.v.a AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM best b LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM b.conv_id
"""
