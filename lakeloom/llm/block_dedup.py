"""Operator 10: removal of repeated word windows by fixed-block anchors.

Every context of a gram's group (see repeats.py) is cut into non-overlapping reference blocks of
half a window, whose hashes form the index; every rolling window of the block's length, of all
contexts of the group, probes the index. A window of 35 words holds a whole block of 18, so a
repeated window always has a hit. The windows around a hit meet their equals by the hash of the whole
window; then a hit is extended: from the block to both ends the words of each window are compared with those
of the first of its equals, word by word, and what holds to a window's length counts. Runs of such windows
that touch are the maximal repeats. A block that thousands of contexts share costs one extension a window,
never a pair of contexts.

Defined results: a null text has no words (nothing removed, the digest of b""); texts under 35
words lose nothing; repeated rows remove one another whole; an empty table gives no rows; other
columns are ignored. White space is [\\x20\\x09-\\x0D] only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import kernels as K
from . import repeats as R

#: Production parameters, in words.
WINDOW, GRAM = 35, 8

_SPACE = bytes(32 if x in (9, 10, 11, 12, 13, 32) else x for x in range(256))


def block_hits(sums, first, weight, starts, row, data, opens, closes, width: int) -> np.ndarray:
    """Mask of starts whose `width` words occur at another start too."""
    if not len(starts):
        return np.zeros(0, bool)
    size = (width + 1) // 2
    n = np.diff(first)
    probe_at = K.ranges(first[:-1], np.maximum(n - size + 1, 0))
    probe_row = np.searchsorted(first, probe_at, "right") - 1
    probe = K.rolling(sums, size)[probe_at]
    is_block = (probe_at - first[probe_row]) % size == 0
    index = np.unique(probe[is_block])  # reference blocks
    near = np.minimum(np.searchsorted(index, probe), len(index) - 1)
    hit = index[near] == probe
    times = np.bincount(near[hit], weights=weight[probe_row[hit]], minlength=len(index))
    anchored = np.zeros(len(sums) + size, bool)
    anchored[probe_at[is_block & (times[near] > 1)]] = True
    # a start is a candidate if one of its own blocks, whole inside its window, was hit elsewhere
    count = np.concatenate(([0], np.cumsum(anchored)))
    rest = np.flatnonzero(count[starts + width - size + 1] > count[starts])
    out = np.zeros(len(starts), bool)
    words = K.exact_ids(data, opens, closes)
    whole, at = K.rolling(sums, width)[starts[rest]], starts[rest]
    out[rest] = R.repeats_of(whole, weight[row[rest]], lambda some, firsts: R.same_spans(words, at[some], at[firsts], width))
    return out


def removed_words(docs: DataFrame, width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text, did, spans of repeated `width`-word windows (see repeats.repeat_spans)."""
    return R.repeat_spans(docs, R.word_units, lambda *x: block_hits(*x, width), width, gram)


def block_dedup(docs: DataFrame, width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def cut(text: bytes, spans: list):
        words = [w for w in text.translate(_SPACE).split(b" ") if w]
        if not spans:
            return len(words), 0, R.sha256(b" ".join(words))
        gone = R.cover(len(words), spans, width).tolist()
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        return len(words), len(words) - len(kept), R.sha256(b" ".join(kept))

    return R.digests(removed_words(docs, width, gram), cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM starts) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(generate_series(0, 34)) AS j FROM again)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS line FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
