"""Vectorised byte and word kernels shared by the text operators.

Everything here works on one flat ``uint8`` buffer that holds many texts plus an offsets array,
so that NumPy's per-call cost is paid once for about a megabyte of text and not once a document.
Rolling hashes are polynomials modulo 2**64 with an odd base (so every prefix difference can be divided
back to position 0) followed by a 64-bit finaliser. Such sums have equal values for some pairs of
long unequal sequences (Thue-Morse words), so they only ever find candidates; words and lines are named by
digests(), which mixes eight bytes at a time, and what windows have in common is compared value by value.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}

#: Bytes of text that one vectorised step handles (longer single texts are handled whole).
CHUNK_BYTES = 1 << 18

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables are kept up to a million entries."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 20:
            _tables[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; equal inputs give equal outputs and nearby inputs scatter."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() takes the hash of any span of values."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * _powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _powers(_INVERSE, len(sums))[start] + (end - start).astype(U64))


def rolling(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every span of `width` values, by start."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, U64)
    return mix((sums[width:] - sums[:-width]) * _powers(_INVERSE, n) + U64(width))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each `width` consecutive entries, in log2(width) passes."""
    k = 1
    while k * 2 <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """(first, last) ranges of texts that together have about `size` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(n, to)
        at = min(n, to)


def words(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = _WHITE):
    """(start, end, first) of the words of all texts: byte starts and ends, and the number of words before each text."""
    solid = ~white[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid))
    after = np.concatenate((solid, [False]))
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return start, end, np.searchsorted(start, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros after the end)."""
    out = np.zeros(len(data) + 8, U64)
    for i in range(min(8, len(data))):
        out[: len(data) - i] |= data[i:].astype(U64) << U64(8 * i)
    return out


#: Longer spans are digested one by one.
_BLOCKS = 32


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit name of each span of bytes, mixed eight bytes at a time (a chain, no sum); other seeds give independent names."""
    length = end - start
    out = mix(length.astype(U64) * U64(BASE) + U64(seed))
    blocks, odd = eights(data), U64(0xD6E8FEB86659FD93)
    at, open_spans = start, np.flatnonzero((length > 0) & (length <= 8 * _BLOCKS))
    for done in range(0, 8 * _BLOCKS, 8):
        if not len(open_spans):
            break
        left = length[open_spans] - done
        cut = np.where(left < 8, (U64(1) << (U64(8) * np.clip(left, 0, 7).astype(U64))) - U64(1), ~U64(0))
        block = blocks[at[open_spans] + done] & cut
        out[open_spans] = mix((out[open_spans] ^ mix(block + U64(seed))) * odd)
        open_spans = open_spans[left > 8]
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(length > 8 * _BLOCKS):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=key).digest(), "little")
    return out


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return digests(data, start, end)


def exact_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each span, equal where the bytes are: equal digests count after a look at the bytes."""
    _, first, ids = np.unique(digests(data, start, end), return_index=True, return_inverse=True)
    length, lead = end - start, first[ids]
    same = length == length[lead]
    rows = np.flatnonzero(same & (length > 0))
    sizes = length[rows]
    differ = data[ranges(start[rows], sizes)] != data[ranges(start[lead[rows]], sizes)]
    if len(rows):
        same[rows] = np.add.reduceat(differ, np.cumsum(sizes) - sizes) == 0
    for k in np.flatnonzero(~same):  # digests that collide: named by their bytes
        ids[k] = len(first) + int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=7).digest(), "little")
    return ids


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start[i], start[i] + length[i])."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)


def minimizer_runs(sums: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """Anchors of all windows of `width` values that lie inside one text.

    A window's anchor is the leftmost of its grams with the least hash, so equal windows have the
    same anchor at the same place, wherever they stand. Returns for each anchor: text, position,
    first and last window start that it serves (absolute positions), and the gram's hash.
    """
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U64),)
    n = len(sums) - 1
    if n < width:
        return empty
    h = rolling(sums, gram)
    bits = U64(max(20, int(len(h)).bit_length()))
    key = ((h >> bits) << bits) | np.arange(len(h), dtype=U64)
    least = sliding_min(key, width - gram + 1)
    served = np.maximum(offsets[1:] - offsets[:-1] - width + 1, 0)
    starts = ranges(offsets[:-1], served)
    if not len(starts):
        return empty
    pos = (least[starts] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (starts[1:] != starts[:-1] + 1))))
    last = np.concatenate((new[1:], [len(pos)])) - 1
    p, a, b = pos[new], starts[new], starts[last]
    return np.searchsorted(offsets, a, "right") - 1, p, a, b, h[p]


def repeated(ids: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mask of the entries whose equals, itself included, weigh more than 1 together (weights are 1 or more).

    The entry's number rides in the low bits, so one sort of plain integers does; neighbours are
    then compared in all 64 bits.
    """
    n = len(ids)
    out = weight > 1
    if n < 2:
        return out
    bits = U64(int(n).bit_length())
    key = ((ids >> bits) << bits) | np.arange(n, dtype=U64)
    key.sort()
    order = (key & ((U64(1) << bits) - U64(1))).astype(np.int64)
    key >>= bits
    full = ids[order]
    same = full[1:] == full[:-1]
    if ((key[1:] == key[:-1]) & ~same).any():  # unequal ids that agree in the high bits may stand between equal ones
        order = np.argsort(ids, kind="stable")
        full = ids[order]
        same = full[1:] == full[:-1]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def runs(flags: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of maximal runs of True; cut marks places where a run has to end and another may begin."""
    f = np.concatenate(([False], flags, [False]))
    begin, stop = f[1:-1] & ~f[:-2], f[1:-1] & ~f[2:]
    if cut is not None:
        c = np.concatenate((cut, [True]))
        begin |= flags & cut
        stop |= flags & c[1:]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def binary(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Arrow binary column of data[start[i]:end[i]]."""
    length = end - start
    to = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=to[1:])
    got = data[ranges(start, length)]
    return pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(to), pa.py_buffer(got)]).cast(pa.binary())
