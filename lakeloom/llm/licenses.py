"""Operator 1: licence scan by Aho-Corasick and a shunting-yard expression evaluator.

One automaton finds notice phrases and the identifier tag in the normalised words of a whole text.
Where the tag stands, however its words are separated, and a colon or equals sign follows, the rest of
its line is a licence expression: identifiers joined by AND, OR and WITH, with parentheses. A tag
without either sign is only mentioned and gives no label. A shunting-yard parser (WITH before AND before OR) evaluates it to
identifiers and a restriction degree: OR lets the reader choose (minimum), AND binds to both
(maximum), WITH softens copyleft by its exception. All findings of a text apply together.

Defined results: a null text is an empty one (no words, no labels, score 0, null places); a broken
expression adds the label `invalid-expression`; labels are distinct, sorted and comma-joined;
repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further phrases, in words; the longest of those that start at one place names the licence best, but each one counts.
NOTICE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "proprietary and confidential": "proprietary",
}
TAG = "spdx license identifier"

#: Restriction degree of a licence family, by the longest prefix of the label; others get UNKNOWN.
DEGREES = {
    "0bsd": 0.0, "cc0": 0.0, "public-domain": 0.0, "unlicense": 0.0,
    "mit": 0.1, "bsd": 0.1, "isc": 0.1, "apache": 0.2, "cc-by": 0.2,
    "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.5,
    "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.8, "cc-by-nc": 0.9,
    "reserved": 1.0, "proprietary": 1.0,
}
UNKNOWN, SOFTENED = 0.5, 0.4
_ORDER = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_AFTER_TAG = re.compile(rb"[ \t]*[:=][ \t]*([^\r\n]*)")

_LOWER_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if x >= 0x80 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def degree(label: str) -> float:
    fits = [k for k in DEGREES if label == k or label.startswith((f"{k}-", f"{k} "))]
    return DEGREES[max(fits, key=len)] if fits else UNKNOWN


def evaluate(expression: str) -> tuple[frozenset[str], float] | None:
    """(identifiers, restriction degree) of a licence expression, or None if it is malformed.

    Text after a complete expression (a comment's end, say) is ignored.
    """
    output: list[tuple[frozenset[str], float]] = []
    stack: list[str] = []
    operand_next, at, text = True, 0, expression.strip()

    def reduce() -> bool:
        op = stack.pop()
        if op == "(" or len(output) < 2:
            return False
        (right, y), (left, x) = output.pop(), output.pop()
        if op == "with":
            output.append((frozenset(f"{a} with {b}" for a in left for b in right), min(x, SOFTENED)))
        else:
            output.append((left | right, max(x, y) if op == "and" else min(x, y)))
        return True

    while m := _TOKEN.match(text, at):
        bracket, name = m.groups()
        word = (bracket or name).lower()
        if operand_next:
            if word in _ORDER or word == ")":
                return None
            if word == "(":
                stack.append(word)
            else:
                output.append((frozenset((word,)), degree(word)))
                operand_next = False
        elif word == ")":
            while stack and stack[-1] != "(":
                if not reduce():
                    return None
            if not stack:
                break
            stack.pop()
        elif word in _ORDER:
            while stack and _ORDER.get(stack[-1], 0) >= _ORDER[word]:
                if not reduce():
                    return None
            stack.append(word)
            operand_next = True
        else:
            break
        at = m.end()
    while stack:
        if not reduce():
            return None
    return output[0] if len(output) == 1 and not operand_next else None


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in NOTICE_PHRASES.items():
        found.add_word(f" {phrase} ", (False, label, phrase.count(" ") + 1))
    for phrase, label in BASE_PHRASES.items():
        found.add_word(f" {phrase} ", (True, label, phrase.count(" ") + 1))
    found.add_word(f" {TAG} ", (False, "", TAG.count(" ") + 1))
    found.make_automaton()
    return found


def _scan(automaton, raw: bytes) -> tuple:
    words = raw.translate(_LOWER_WORDS).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")  # a byte a character: the phrases are ASCII
    n_base, first, last, base, labels, risk = 0, None, None, set(), set(), 0.0
    seen, n_before, tags = 0, 0, set()  # blanks before a hit's end are counted on from the hit before
    for end, (is_base, label, n) in automaton.iter(line):
        n_before += line.count(" ", seen, end)
        seen = end
        if not label:
            tags.add(n_before - 1)  # number of the tag's last word
            continue
        labels.add(label)
        risk = max(risk, degree(label))
        if is_base:
            place = n_before - n
            first, last = place if first is None else min(first, place), place if last is None else max(last, place)
            n_base += 1
            base.add(label)
    for m in (w for i, w in enumerate(_WORD.finditer(raw)) if i in tags) if tags else ():
        if rest := _AFTER_TAG.match(raw, m.end()):
            got = evaluate(rest[1].decode("utf-8", "replace"))
            ids, x = got if got else (("invalid-expression",), UNKNOWN)
            labels.update(ids)
            risk = max(risk, x)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), risk


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            if len(texts):
                rows = [_scan(automaton, x.as_py() or b"") for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


#: The base columns of license_scan(); expressions have no SQL form.
BASE_ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases AS (SELECT unnest([['cc', 'by'], ['general', 'public', 'license'], ['all', 'rights', 'reserved']]) AS p, unnest(['cc-by', 'gpl', 'reserved']) AS label),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM w),
hits AS (SELECT doc_id, i - 1 AS place, label FROM starts JOIN phrases ON w[i:i + len(p) - 1] = p)
SELECT doc_id, len(w) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM w LEFT JOIN hits USING (doc_id) GROUP BY doc_id, w
"""
