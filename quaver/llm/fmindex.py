"""A compressed full-text index (FM-index) over records of notes, for batches of backward searches.

The text is every record's bars, each note a symbol of ``BITS`` bits, with a symbol between bars and
an end after each record.  The Burrows-Wheeler transform of the text is kept as a wavelet matrix of
packed bits.  All steps work on whole arrays.  As notes are hashed to symbols, matches are evidence
of equal notes, not proof.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np

BITS = 10
END, BAR = 0, 1
#: Shortest match that counts, in symbols.
LEAST = 3
_WORD = np.uint64(1)


class Symbols(dict):
    """Note to symbol; forgets when it has seen too many."""

    def __missing__(self, note: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        s = BAR if note == "|" else END if note == "\n" else crc32(note.encode()) % ((1 << BITS) - 2) + 2
        self[note] = s
        return s


def encode(records: list[str], symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all records, ``| bar | bar |`` and an end each, and the place where each begins (and the last ends)."""
    parts = [("| " + r.replace("|", " | ") + " | \n").split(" ") for r in records]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    text = np.fromiter((symbols[n] for p in parts for n in p), np.int64, int(starts[-1]))
    return text, starts


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; ends are told apart, so no order depends on what follows one."""
    n = len(text)
    ends = text == END
    rank = text + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + 1 + (1 << BITS)) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = fresh
        width *= 2
        if n == 0 or int(rank.max()) == n - 1 or width >= n:
            return order


class FMIndex:
    """``records`` are texts of bars parted by ``|``."""

    def __init__(self, records: list[str], symbols: Symbols):
        self.text, self.starts = encode(records, symbols)
        self.n = len(self.text)
        self.order = suffix_array(self.text)
        last = self.text[self.order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.text, minlength=1 << BITS))))[:-1]
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(BITS - 1, -1, -1):
            bit = ((last >> level) & 1).astype(np.uint8)
            pad = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            pad[: self.n] = bit
            words = np.packbits(pad, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.bits.append(words)
            self.ranks.append(np.cumsum(ones) - ones)
            self.zeros.append(self.n - int(ones.sum()))
            last = np.concatenate((last[bit == 0], last[bit == 1]))
        every = np.arange(1 << BITS)
        self.base = self._walk(every, np.zeros(len(every), np.int64))
        # suffixes by record, in order: whether a range holds one of a record's is one look-up
        owner = np.searchsorted(self.starts, self.order, side="right") - 1
        self.owned = np.sort(owner * self.n + np.arange(self.n))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        at = at.copy()
        for k, level in enumerate(range(BITS - 1, -1, -1)):
            word = at >> 6
            mask = (_WORD << (at & 63).astype(np.uint64)) - _WORD
            ones = self.ranks[k][word] + np.bitwise_count(self.bits[k][word] & mask)
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of ``symbol`` + pattern from the ranges of the patterns."""
        shift = self.first[symbol] - self.base[symbol]
        both = self._walk(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        return both[: len(lo)] + shift, both[len(lo) :] + shift

    def matches(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Maximal matches ``(query, place in text, place in the index's text, length)``.

        Query k is ``text[begin[k] : end[k]]``, asked against ``record[k]``.  It is read backward: a
        match is lengthened as long as the record holds it, over bar lines too, and the next one
        ends where it could not go on.  Matches shorter than ``LEAST`` are passed over.
        """
        out: list[tuple[np.ndarray, ...]] = []
        tail = end - 1  # last symbol of the match at hand
        length = np.zeros(len(begin), np.int64)
        lo, hi = np.zeros(len(begin), np.int64), np.full(len(begin), self.n, np.int64)
        at = np.zeros(len(begin), np.int64)  # a suffix of the record that begins with the match
        active = np.flatnonzero(tail >= begin)
        while len(active):
            place = tail[active] - length[active]
            inside = place >= begin[active]
            l, h = self.step(text[np.where(inside, place, 0)], lo[active], hi[active])
            base = record[active] * self.n
            k = np.minimum(np.searchsorted(self.owned, base + l), self.n - 1)
            goes_on = inside & (self.owned[k] >= base + l) & (self.owned[k] < base + h)
            on, off = active[goes_on], active[~goes_on]
            lo[on], hi[on], at[on] = l[goes_on], h[goes_on], (self.owned[k] - base)[goes_on]
            length[on] += 1
            long = length[off] >= LEAST
            done = off[long]
            out.append((done, tail[done] - length[done] + 1, self.order[at[done]], length[done]))
            tail[off] -= np.where(long, length[off], 1)
            length[off], lo[off], hi[off] = 0, 0, self.n
            active = active[tail[active] >= begin[active]]
        if not out:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))
