"""Token ids of whole texts by a byte-level BPE of the ``tokenizers`` library.

The library's own pre-tokeniser is the slow part and most pieces repeat, so the
pieces are found with numpy, and the library encodes each distinct piece once
per worker process; a fixed-size direct-mapped table keeps the ids of pieces.
Byte-level BPE never joins two pieces, so the ids equal those of the whole text.
With ``added``, the strings of added tokens (``<|endoftext|>``) are split off
first, as the library does by default, and give the token's own id.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from lumenflow.llm.textops import blocks, code_points, seeds, span_hashes

_U = np.uint64
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
# The code points of Unicode's White_Space property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions that the pattern of this vocabulary splits off.
_CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
_APOSTROPHE = 0x27
#: Code points that are worked on at a time in very long texts.
_SPAN = 1 << 19


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = _LETTER
        elif kind == "N":
            table[c] = _NUMBER
    table[_WHITE] = _SPACE
    return table


@lru_cache(1)
def _values() -> np.ndarray:
    return seeds(0x110000, 2)


def pieces(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the pre-tokeniser begin; rows begin at ``offsets``.

    A run of letters, of numbers or of other signs is a piece, with one space
    before it; white space but for its last sign is one; a contraction is one
    where it begins a piece.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _classes()[cps]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = 9, kind[:-1]
    before[first[:n]] = 9  # no sign of this row
    space = kind == _SPACE
    blank = cps == 0x20
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = blank[:-1]
    blank_before[first[:n]] = False
    last = np.empty(n, dtype=bool)  # the last white space before another sign of the row
    last[-1] = False
    last[:-1] = space[:-1] & ~space[1:]
    last &= ~first[1:]
    begins = (kind != before) & ~(~space & blank_before)
    begins |= last  # split off, alone or with what follows
    marks = np.flatnonzero((cps == _APOSTROPHE) & (before != _OTHER) & ~blank_before)
    if len(marks):
        ends = np.append(offsets[1:], n)
        end = ends[np.searchsorted(offsets, marks, side="right") - 1]
        for m, e in zip(marks.tolist(), end.tolist(), strict=True):
            after = "".join(map(chr, cps[m + 1 : min(e, m + 3)]))
            for x in _CONTRACTIONS:
                if after.startswith(x):
                    if (stop := m + 1 + len(x)) < e:
                        begins[stop] = True
                    begins[m + 1] = False
                    if len(x) == 2:
                        begins[m + 2] = False
                    break
    return np.flatnonzero(begins)


class Encoder:
    """Encodes columns of texts; one for each worker process and tokenizer file.

    Without ``added`` the strings of added tokens are ordinary text, as with the
    library's ``encode_special_tokens``.
    """

    def __init__(self, path: str, bits: int = 20, room: int = 1 << 22, added: bool = False):
        # tasks are the unit of parallel work; threads of the library would keep memory of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits, self.room = bits, room
        self.added = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()} if added else {}
        if added and any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that strip, need word bounds or are normalized are not matched here")
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, dtype=_U)
        self.at = np.zeros(1 << self.bits, dtype=np.int32)
        self.size = np.zeros(1 << self.bits, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def _learn(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Appends the ids of the texts; where they are and how many. The library gets few at a time, as its own results are large."""
        size, parts = np.zeros(len(texts), dtype=np.int32), []
        for k in range(0, len(texts), 2048):
            rows = [x.ids for x in self.tokenizer.encode_batch_fast(texts[k : k + 2048], add_special_tokens=False)]
            size[k : k + len(rows)] = own = list(map(len, rows))
            parts.append(np.fromiter((i for r in rows for i in r), dtype=np.uint32, count=sum(own)))
        flat = np.concatenate(parts)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(flat)] = flat
        at = (self.used + np.cumsum(size, dtype=np.int64) - size).astype(np.int32)
        self.used += len(flat)
        return at, size

    def _span(self, text: str, cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a span and, for each of its offsets, how many ids lie before it."""
        starts = pieces(cps, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        ends = np.append(starts[1:], len(cps))
        h = span_hashes(_values()[cps], starts, ends)
        slot = (h >> _U(64 - self.bits)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        missed = np.flatnonzero(self.keys[slot] != h)
        if len(missed):
            new, where, back = np.unique(h[missed], return_index=True, return_inverse=True)
            where = missed[where]
            at_new, size_new = self._learn([text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            at[missed], size[missed] = at_new[back], size_new[back]
            s = slot[where]
            self.keys[s], self.at[s], self.size[s] = new, at_new, size_new
        before = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=before[1:])
        out = self.ids[np.repeat(at - before[:-1], size) + np.arange(before[-1])]
        if self.used > self.room:
            self._clear()
        return out, before[np.searchsorted(starts, offsets)]

    def _whole(self, text: str, cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _span; very long rows are worked on in spans that end at a lone space."""
        if len(cps) <= 2 * _SPAN:
            return self._span(text, cps, offsets)
        found, before, n = [np.zeros(0, dtype=np.uint32)], [0], 0
        for lo, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            while lo < end:
                hi = min(end, lo + _SPAN)
                while hi < end and not (cps[hi] == 0x20 and not chr(cps[hi - 1]).isspace() and not chr(cps[min(hi + 1, end - 1)]).isspace()):
                    hi += 1
                found.append(self._span(text[lo:hi], cps[lo:hi], np.array([0, hi - lo]))[0])
                n += len(found[-1])
                lo = hi
            before.append(n)
        return np.concatenate(found), np.array(before)

    def _marks(self, text: str, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of the added tokens within rows."""
        if not any(x in text for x in self.added):
            return []
        return [(*m.span(), self.added[m.group()]) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.pattern.finditer(text, lo, hi)]

    def _with_added(self, text: str, cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _whole, with the ids of added tokens for their strings."""
        marks = self._marks(text, offsets)
        if not marks:
            return self._whole(text, cps, offsets)
        starts, ends, own = (np.array(x, dtype=np.int64) for x in zip(*marks, strict=True))
        cuts = np.sort(np.concatenate((offsets, starts, ends)))
        ids, before = self._whole(text, cps, cuts)
        size = np.diff(before)
        at = np.searchsorted(cuts, starts, side="right") - 1
        token = np.zeros(len(size), dtype=bool)
        token[at] = True
        after = np.zeros(len(before), dtype=np.int64)
        np.cumsum(np.where(token, 1, size), out=after[1:])
        part = np.repeat(np.arange(len(size)), size)
        plain = np.flatnonzero(~token[part])
        out = np.zeros(after[-1], dtype=np.uint32)
        out[plain - before[part[plain]] + after[part[plain]]] = ids[plain]
        out[after[at]] = own
        return out, after[np.searchsorted(cuts, offsets)]

    def encode(self, column: pa.Array):
        """Yields (first row, row after the last, ids of all these rows, offsets of the rows among the ids)."""
        for a, b, data, offsets in blocks(column):
            yield a, b, *self._with_added(*code_points(data, offsets))


@lru_cache(2)
def encoder(path: str, added: bool = False) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(path, added=added)
