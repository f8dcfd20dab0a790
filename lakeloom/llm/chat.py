"""Operator 8: transcript parsing by a hidden Markov model, then canonical turns.

A transcript is plain text in which some turns begin with a speaker marker ("User:", "### Assistant",
"[system]", ...) and others with none. Each line has a hidden state: a role, and whether the line opens
a turn or goes on with one. Observed are the line's marker, whether it stands first or after a blank
line, its length class and its last character's class; they are taken as independent given the
state. Start, transition and emission counts (plus one each) come from labelled turns of a whole table by
one aggregation whose result has a fixed number of rows, whatever the input. Viterbi's path gives
roles and turn borders; a turn is rendered as its role tag, its text without the marker, and an end tag.

A conversation is cut into parts of SEGMENT turns so that no group grows without bound, but its path is that of the
whole: of conversations with several parts, each part first gives its transfer matrix (the best score from any state
before it to any state at its end), a pass over these small matrices finds the scores with which each
part begins and the state in which it ends, and then each part is parsed between them. The result equals one Viterbi
pass over all lines. A turn that runs over a part's end comes in pieces, the later ones marked `continued`.

Defined results: null texts are empty ones; an empty transcript has one empty turn of the likeliest
role; null and other roles train nothing, and their turns come back as one of the three; ties go to the first state in
order; repeated rows of a conversation are turns like others; a row with a null turn has no place in its conversation
and is a transcript of its own (part null); a null conv_id is an id like others; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import written

ROLES = ("system", "user", "assistant")
STATES = [(role, opens) for role in ROLES for opens in (True, False)]

#: Production parameter: turns of one conversation that are parsed together.
SEGMENT = 512

#: Marker words by role, in lower case.
MARKERS = {"system": ("system", "context", "instructions"), "user": ("user", "human", "question", "prompter"), "assistant": ("assistant", "ai", "bot", "answer", "model")}
_WORDS = {w: r for r, ws in MARKERS.items() for w in ws}
_MARKER = re.compile(r"^(?:#{1,6} *|\[|<\|?|\*\*)?(" + "|".join(_WORDS) + r")(?:\]|\|?>|:?\*\*|)(?: *:|(?=\s*$)|(?<=[\]>*]))[ \t]*", re.I)

FEATURES = {"marker": 4, "place": 3, "length": 5, "ending": 4}


def observe(lines: list[str], before: bool | None = None) -> np.ndarray:
    """One row a line: marker (0 none, else 1 + role), place (0 first, 1 after a blank line, 2 else), length class, ending class.

    before: whether the line before the first one is blank; None if there is none.
    """
    out, blank = np.zeros((len(lines), len(FEATURES)), np.int64), bool(before)
    for i, line in enumerate(lines):
        m = _MARKER.match(line)
        out[i, 0] = 1 + ROLES.index(_WORDS[m[1].lower()]) if m else 0
        out[i, 1] = 0 if i == 0 and before is None else 1 if blank else 2
        n = len(line)
        out[i, 2] = 0 if n == 0 else 1 if n < 20 else 2 if n < 80 else 3 if n < 300 else 4
        end = line[-1:]
        out[i, 3] = 0 if not end else 1 if end in ".!…" else 2 if end == "?" else 3
        blank = n == 0
    return out


class Model:
    """Log probabilities from counts."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        norm = lambda x: np.log((x + 1.0) / (x + 1.0).sum(axis=-1, keepdims=True))
        allowed = np.array([[b_open or (a_role == b_role) for b_role, b_open in STATES] for a_role, _ in STATES])
        opening = np.array([o for _, o in STATES])
        self.start = np.where(opening, norm(start), -np.inf)
        self.step = np.where(allowed, norm(step), -np.inf)
        self.emit = [norm(e) for e in emit]

    def scores(self, seen: np.ndarray) -> np.ndarray:
        return sum(e[:, seen[:, k]] for k, e in enumerate(self.emit)).T

    def path(self, seen: np.ndarray, entry: np.ndarray | None = None, end: int | None = None) -> np.ndarray:
        """Viterbi: the likeliest states; after the scores of the states before (entry), and up to a given last state (end)."""
        score = self.scores(seen)
        back = np.zeros((len(seen), len(STATES)), np.int64)
        now = (self.start if entry is None else (entry[:, None] + self.step).max(axis=0)) + score[0]
        for i in range(1, len(seen)):
            ways = now[:, None] + self.step
            back[i] = ways.argmax(axis=0)
            now = ways.max(axis=0) + score[i]
        state = np.zeros(len(seen), np.int64)
        state[-1] = now.argmax() if end is None else end
        for i in range(len(seen) - 1, 0, -1):
            state[i - 1] = back[i, state[i]]
        return state

    def transfer(self, seen: np.ndarray, opening: bool) -> np.ndarray:
        """Best scores from each state before the lines to each state at their end; of a conversation's first lines all rows are alike."""
        score = self.scores(seen)
        now = (np.broadcast_to(self.start, self.step.shape) if opening else self.step) + score[0]
        for row in score[1:]:
            now = (now[:, :, None] + self.step[None]).max(axis=1) + row
        return now

    def chain(self, parts: list[tuple[bool, np.ndarray, np.ndarray]]) -> list[tuple[bool | None, np.ndarray | None, int]]:
        """For parts in order (blank at the end, transfers after a line that isn't blank and after a blank one): the line before, entry scores and last state of each."""
        entries, used, blank, now = [], [], None, None
        for ends_blank, plain, after_blank in parts:
            matrix = after_blank if blank else plain
            entries.append((blank, now))
            used.append(matrix)
            now = matrix[0] if now is None else (now[:, None] + matrix).max(axis=0)
            blank = ends_blank
        out, state = [], int(now.argmax())
        for (blank, entry), matrix in zip(reversed(entries), reversed(used), strict=True):
            out.append((blank, entry, state))
            state = state if entry is None else int((entry + matrix[:, state]).argmax())
        return out[::-1]


def parse(model: Model, transcript: str, before: bool | None = None, entry: np.ndarray | None = None, end: int | None = None) -> list[tuple[str, str, bool]]:
    """(role, text without its marker, whether it goes on from before) of each turn."""
    lines = transcript.split("\n")
    turns: list[list] = []
    for line, state in zip(lines, model.path(observe(lines, before), entry, end), strict=True):
        role, opens = STATES[state]
        if opens or not turns:
            turns.append([role, [_MARKER.sub("", line, count=1) if opens else line], not opens])
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(x).strip("\n"), continued) for role, x, continued in turns]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, part, transcript, and labels (role and number of lines of each turn): plain transcripts of labelled turns.

    Turns get one of several marker styles or none, by a hash of their conversation and number; a turn
    without a marker stands after a blank line.
    """
    text = F.coalesce("text", F.lit(""))
    style = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6))
    role = F.col("role")
    marked = F.when(role.isNull() | (style == 0), F.concat(F.lit("\n"), text))
    for k, (before, after, names) in enumerate([("", ": ", None), ("### ", ":\n", None), ("[", "] ", None), ("", ": ", ("context", "human", "ai")), ("**", ":** ", ("instructions", "question", "answer"))], 1):
        name = F.initcap(role) if names is None else F.element_at(F.create_map(*(F.lit(x) for p in zip(ROLES, names, strict=True) for x in p)), role)
        marked = marked.when(style == k, F.concat(F.lit(before), F.coalesce(name, role), F.lit(after), text))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), marked.alias("line"))
    one = F.struct("turn", "line", "role")
    placed = turns.where("turn is not null").withColumn("part", F.floor(F.col("turn") / SEGMENT))
    alone = turns.where("turn is null").select("conv_id", F.lit(None).cast("long").alias("part"), F.array(one).alias("t"))
    whole = placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(one)).alias("t")).unionByName(alone)
    return whole.select("conv_id", "part", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("transcript"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.size(F.split(x["line"], "\n")).alias("n"))).alias("labels"))


def train(labelled: DataFrame) -> Model:
    """Counts over all rows of transcripts(); each task sends its sums, whose number is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(STATES)
        total = np.zeros(size + size * size + size * sum(FEATURES.values()), np.int64)
        start, step, emit = total[:size], total[size : size + size * size].reshape(size, size), total[size + size * size :].reshape(size, -1)
        shift = np.cumsum([0, *FEATURES.values()])[:-1]
        for batch in batches:
            for text, labels in zip(batch.column("transcript").to_pylist(), batch.column("labels").to_pylist(), strict=True):
                lines, states = text.split("\n"), []
                for x in labels:
                    k = 2 * ROLES.index(x["role"]) if x["role"] in ROLES else -1
                    blank = 1 if len(states) < len(lines) and lines[len(states)] == "" and x["n"] > 1 else 0  # the blank line goes with the turn before
                    states += [states[-1] | 1 if states and states[-1] >= 0 else -1] * blank + [k] + [k + 1 if k >= 0 else -1] * (x["n"] - 1 - blank)
                seen, s = observe(lines), np.array(states)
                known = s >= 0
                for f in range(len(FEATURES)):
                    np.add.at(emit, (s[known], shift[f] + seen[known, f]), 1)
                both = known[1:] & known[:-1]
                np.add.at(step, (s[:-1][both], s[1:][both]), 1)
                if len(s) and s[0] >= 0:
                    start[s[0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "n"])

    sums = labelled.select("transcript", "labels").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    size, width = len(STATES), sum(FEATURES.values())
    flat = np.zeros(size + size * size + size * width)
    for row in sums.collect():  # as many rows as the model has cells
        flat[row.k] = row.n
    emit = flat[size + size * size :].reshape(size, width)
    cuts = np.cumsum([0, *FEATURES.values()])
    return Model(flat[:size], flat[size : size + size * size].reshape(size, size), [emit[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _transfers(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, first in zip(batch.column("transcript").to_pylist(), batch.column("first").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                both = [model.transfer(observe(lines, None if first else blank), first).ravel().tolist() for blank in (False, True)]
                rows.append((lines[-1] == "", *both))
            if rows:
                made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.bool_(), *[pa.list_(pa.float64())] * 2), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), *made], ["conv_id", "part", "blank", "plain", "after"])

    return run


def _borders(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                square = lambda x: np.array(x).reshape(len(STATES), len(STATES))
                chained = model.chain([(p["blank"], square(p["plain"]), square(p["after"])) for p in parts])
                rows += [(conv, p["part"], before, None if entry is None else entry.tolist(), end) for p, (before, entry, end) in zip(parts, chained, strict=True)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.float64()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["whose", "which", "before", "entry", "end"])

    return run


def parse_transcripts(plain: DataFrame, model: Model) -> DataFrame:
    """conv_id, part, turn (from 0 in a part), role, text, rendered, continued of every turn that the model finds."""
    plain = plain.select("conv_id", "part", "transcript")
    spans = plain.groupBy(F.col("conv_id").alias("whose")).agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most")
    several = plain.join(spans, F.col("conv_id").eqNullSafe(F.col("whose"))).where("part is not null").select("conv_id", "part", "transcript", (F.col("part") == F.col("least")).alias("first"))
    matrices = several.mapInArrow(_transfers(model), "conv_id long, part long, blank boolean, plain array<double>, after array<double>")
    chains = matrices.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "blank", "plain", "after"))).alias("parts"))
    borders = written(chains.mapInArrow(_borders(model), "whose long, which long, before boolean, entry array<double>, end long"))
    known = plain.join(borders, F.col("conv_id").eqNullSafe(F.col("whose")) & F.col("part").eqNullSafe(F.col("which")), "left").drop("whose", "which")
    names = ["conv_id", "part", "turn", "role", "text", "rendered", "continued"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, part, text, before, entry, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "transcript", "before", "entry", "end")), strict=True):
                found = parse(model, text or "", before, None if entry is None else np.array(entry), end)
                rows += [(conv, part, i, role, x, render(role, x), continued) for i, (role, x, continued) in enumerate(found)]
            if rows:
                kinds = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return known.mapInArrow(run, "conv_id long, part long, turn long, role string, text string, rendered string, continued boolean")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, part, turn, role, n_chars, rendered_sha256, continued of every turn found in transcripts(conversations)."""
    plain = written(transcripts(conversations))  # read for training, for borders and for parsing
    got = parse_transcripts(plain, train(plain))
    return got.select("conv_id", "part", "turn", "role", F.char_length("text").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"), "continued")
