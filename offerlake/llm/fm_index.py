"""FM-index of a sequence of words: ranks in a wavelet matrix, sampled suffix positions."""

from __future__ import annotations

import numpy as np

from offerlake.llm.suffixes import suffix_ranks


class WaveletMatrix:
    """Rank and access on a sequence of numbers, one level of bits after the other."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(int(len(values) - ones[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def ranks(self, symbols: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs before each place."""
        start = np.zeros(len(symbols), np.int64)
        moved = [p.copy() for p in places]
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbols >> (self.bits - 1 - k) & 1).astype(bool)
            for p in (start, *moved):
                up = ones[p]
                p[:] = np.where(bit, zeros + up, p - up)
        return [p - start for p in moved]

    def access(self, places: np.ndarray) -> np.ndarray:
        at, symbols = places.copy(), np.zeros(len(places), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            up = ones[at]
            bit = ones[at + 1] > up
            symbols = symbols << 1 | bit
            at = np.where(bit, zeros + up, at - up)
        return symbols


class FMIndex:
    """Index of a text of symbols 1 to ``top``; 0 separates passages and ends the text.

    Separators differ from each other in the order of suffixes, so no comparison and no
    pattern runs over one. Suffix positions are kept for every ``sample``-th place and for
    the first place of each passage, so that no walk crosses a separator.
    """

    def __init__(self, text: np.ndarray, top: int, sample: int = 8) -> None:
        n = len(text)
        marks = text == 0
        shifted = text.astype(np.int64) + n
        shifted[marks] = np.arange(int(marks.sum()))
        rank = suffix_ranks(shifted)
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(top).bit_length()))
        counts = np.bincount(text, minlength=top + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        starts = np.empty(n, bool)
        starts[0] = True
        starts[1:] = marks[:-1]
        kept = starts | (np.arange(n) % sample == 0)
        self.sampled = kept[order]
        self.before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]
        self.size = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with each pattern: first, and one past the last.

        ``patterns`` has a row per pattern, filled up on the left. All patterns go back one
        symbol at a time together; those without a row are left behind.
        """
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        width = patterns.shape[1] if len(patterns) else 0
        for step in range(width):
            live = np.flatnonzero((high > low) & (lengths > step))
            if not len(live):
                break
            symbols = patterns[live, width - 1 - step]
            up, down = self.bwt.ranks(symbols, low[live], high[live])
            low[live], high[live] = self.first[symbols] + up, self.first[symbols] + down
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            symbols = self.bwt.access(rows[walking])
            (up,) = self.bwt.ranks(symbols, rows[walking])
            rows[walking] = self.first[symbols] + up
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.positions[self.before[rows]] + steps
