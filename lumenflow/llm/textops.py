"""Vectorised text kernels shared by the training-data operators.

Everything here works on the UTF-8 buffers of Arrow string columns with numpy,
block by block, so the memory of a task is bounded by ``BLOCK`` bytes of text
(or one document, where a document is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time.
BLOCK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SHINGLE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=_U)
#: Space and \x09 to \x0D divide words.
_WORD = np.ones(256, dtype=bool)
_WORD[[32, *range(9, 14)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, the usual shift-multiply rounds."""
    x = np.asarray(x, dtype=_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(salt * 1_000_003)) * _U(_BASE))


_BYTE = seeds(256, 1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each; no more than BLOCK of them are kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    found = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, b, dtype=_U)
        steps[0] = 1
        found.append(np.multiply.accumulate(steps))
    if n <= BLOCK + 1:
        _powers[:] = found
    return found[0], found[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], by differences of one running polynomial."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets within them) of runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _WORD[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all rows, and where each row's words begin among them.

    Texts over ``size`` bytes are worked on in pieces that end at white space.
    """
    table, found, at, n = _LOWER if lower else _BYTE, [], 0, len(data)
    starts_all = []
    while at < n:
        to = min(n, at + size)
        if to < n:
            back = data[at:to][::-1]
            gap = np.argmin(_WORD[back])
            if _WORD[back[gap]]:  # one word fills the piece: go on to its end
                rest = np.flatnonzero(~_WORD[data[to:]])
                to = to + int(rest[0]) if len(rest) else n
            else:
                to -= int(gap)
        piece = data[at:to]
        own = offsets[(offsets >= at) & (offsets <= to)] - at
        starts, ends = _word_bounds(piece, own)
        found.append(span_hashes(table[piece], starts, ends))
        starts_all.append(starts + at)
        at = to
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, dtype=np.int64)
    hashes = np.concatenate(found) if found else np.zeros(0, dtype=_U)
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Of every n consecutive word hashes."""
    if len(hashes) < n:
        return np.zeros(0, dtype=_U)
    total = np.zeros(len(hashes) - n + 1, dtype=_U)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * _SHINGLE[k % 5] * _U(2 * (k // 5) + 1)
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its n-word shingles; fewer words count as one shingle, no word as none."""
    hashes, begins = words(data, offsets)
    every = shingle_hashes(hashes, n)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(every[a : b - n + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix(np.array([int((hashes[a:b] * _SHINGLE[: b - a]).sum()) ^ (b - a)], dtype=_U)))
        else:
            out.append(hashes[:0])
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The text of a block, its code points, and the offsets in code points."""
    text = data.tobytes().decode("utf-8", "replace")
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return text, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), lead[offsets]
