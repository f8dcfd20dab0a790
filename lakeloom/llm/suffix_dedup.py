"""Operator 6: removal of repeated substrings by bucket-pointer refinement of suffixes.

A gram's group (see repeats.py) is an initial bucket of suffixes. The solver refines it: suffixes
start in buckets of their first 50 bytes; a refined bucket is the pair of a suffix's bucket and the
bucket of its later offset (50, then 100 bytes on), and the identifiers made by one refinement are
the pointers read by the next, so two rounds reach 200 bytes. A suffix alone in its bucket is
settled and leaves. Bucket identifiers are 64-bit fingerprints, not dense ranks: tasks then need
not agree on a numbering. What is left in a bucket at 200 bytes is sorted by its identifier and compared with
the bucket's first suffix, byte by byte, before it counts.

Defined results: a null text is an empty one (no bytes, nothing removed, the digest of b"");
texts under 200 bytes lose nothing; repeated rows remove one another whole; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import kernels as K
from . import repeats as R

#: Production parameters.
WINDOW, GRAM = 200, 24


def refine(sums, first, weight, starts, row, data, opens, closes, width: int) -> np.ndarray:
    """Mask of starts whose `width` values occur at another start too."""
    if not len(starts):
        return np.zeros(0, bool)
    step = max(1, width // 4)
    bucket = K.rolling(sums, step)
    alive = np.arange(len(starts))
    depth = step
    while True:
        alive = alive[K.repeated(bucket[starts[alive]], weight[row[alive]])]
        if depth >= width or not len(alive):
            break
        jump = min(depth, width - depth)  # the last jump overlaps where width isn't a power of two times step
        n = len(bucket) - jump
        bucket = K.mix(bucket[:n] * K.U64(0x9E3779B97F4A7C15) ^ K.mix(bucket[jump:]))
        depth += jump
    out = np.zeros(len(starts), bool)
    if len(alive):
        text, at = K.eights(data), starts[alive]
        steps = [*range(0, width - 7, 8), max(0, width - 8)] if width >= 8 else []

        def equal(some: np.ndarray, firsts: np.ndarray) -> np.ndarray:
            if not steps:
                return R.same_spans(data, at[some], at[firsts], width)
            same = np.ones(len(some), bool)
            for i in steps:
                same &= text[at[some] + i] == text[at[firsts] + i]
            return same

        out[alive] = R.repeats_of(bucket[at], weight[row[alive]], equal)
    return out


def removed_bytes(docs: DataFrame, width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text, did, spans of repeated `width`-byte strings (see repeats.repeat_spans)."""
    return R.repeat_spans(docs, R.byte_units, lambda *x: refine(*x, width), width, gram)


def suffix_dedup(docs: DataFrame, width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def cut(text: bytes, spans: list):
        if not spans:
            return len(text), 0, 0, R.sha256(text)
        gone = R.cover(len(text), spans, width)
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return len(text), len(text) - len(kept), len(K.runs(gone)[0]), R.sha256(kept)

    return R.digests(removed_bytes(docs, width, gram), cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(generate_series(0, length(x) // 2 - 200)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM starts) WHERE n > 1),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM again)) GROUP BY doc_id, g),
cut AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed FROM spans GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN x ELSE substr(x, 1, 2 * a[1]) || array_to_string(list_transform(generate_series(1, len(a)), lambda j: substr(x, 2 * b[j] + 1, 2 * (coalesce(a[j + 1], length(x) // 2) - b[j]))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
