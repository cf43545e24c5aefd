"""Subsequence string kernel of words against a few landmark strings.

Two strings are compared by the triples of letters they have in common, in order and with
letters in between; each letter in between makes a triple weigh less. So an insult still looks
like itself with letters pushed in, doubled or left out.
"""

from __future__ import annotations

import unicodedata

import numpy as np

#: Letters between the three of a triple, at most, and what each makes of its weight.
GAPS, DECAY = 2, 0.6
#: Offsets of the second and third letter, and the weight of such a triple.
OFFSETS = tuple(
    (a, b, DECAY ** (b - 2)) for b in range(2, 3 + GAPS) for a in range(1, b)
)
SYMBOLS = 32
#: Letters of words that are compared at a time, and words whose triples are weighed at a time.
LETTERS, WEIGHED = 1 << 16, 512
#: Likeness under which a word counts as unlike a landmark, whatever its chance triples are.
FLOOR = 0.45


def letters(token: str) -> str:
    """Lower-case letters of a token without accents, punctuation and digits."""
    low = token.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low)
    return low if low.isascii() and low.isalpha() else "".join(c for c in low if c.isalpha())


def symbols(word: str) -> np.ndarray:
    """1 to 26 for a to z, 27 to 31 for other letters."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where((codes >= 97) & (codes <= 122), codes - 96, 27 + codes % 5)


def triples(word: str) -> list[tuple[int, float]]:
    codes = symbols(word).tolist()
    return [
        (codes[k] << 10 | codes[k + a] << 5 | codes[k + b], weight)
        for a, b, weight in OFFSETS
        for k in range(len(codes) - b)
    ]


def cosine(one: str, two: str) -> float:
    """Kernel value of two strings, 1 for equal ones."""
    sums = []
    for word in (one, two):
        own: dict[int, float] = {}
        for triple, weight in triples(word):
            own[triple] = own.get(triple, 0.0) + weight
        sums.append(own)
    norms = [sum(w * w for w in own.values()) ** 0.5 for own in sums]
    shared = sum(w * sums[1].get(t, 0.0) for t, w in sums[0].items())
    return shared / (norms[0] * norms[1]) if all(norms) else 0.0


class Landmarks:
    """Kernel values of words against landmarks, from one table of triples."""

    def __init__(self, strings: list[str]) -> None:
        self.strings = strings
        self.table = np.zeros((SYMBOLS**3, len(strings)), np.float32)
        for k, text in enumerate(strings):
            for triple, weight in triples(text):
                self.table[triple, k] += weight
        self.known = self.table.any(1)
        #: Of a landmark with itself, so that its likeness with itself is 1.
        self.own = (self.table.astype(np.float64) ** 2).sum(0)

    def likeness(self, words: list[str]) -> dict[int, np.ndarray]:
        """For the words that are like some landmark: place in the list, and a squared likeness
        per landmark. At most ``LETTERS`` letters are compared at a time."""
        result: dict[int, np.ndarray] = {}
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= LETTERS):
                size += len(words[end])
                end += 1
            if size > LETTERS:
                values = self._long(words[at])
                found = {} if values is None else {0: values}
            else:
                found = self._together(words[at:end])
            result.update((at + k, values) for k, values in found.items())
            at = end
        return result

    def _long(self, word: str) -> np.ndarray | None:
        """Likeness of a word of any length, whose triples are counted before they are weighed."""
        sums, count = np.zeros(SYMBOLS**3), 0
        reach = OFFSETS[-1][1]
        for low in range(0, len(word), LETTERS):
            codes = symbols(word[low : low + LETTERS + reach])
            for a, b, weight in OFFSETS:
                n = min(LETTERS, len(codes) - b)
                if n > 0:
                    found = codes[:n] << 10 | codes[a : a + n] << 5 | codes[b : b + n]
                    found = found[self.known[found]]
                    count += len(found)
                    sums += weight * np.bincount(found, minlength=len(sums))
        if count < 2:
            return None
        values = np.minimum(1.0, sums @ self.table / self.own)
        values = np.where(values < FLOOR, 0, values**2)
        return values.astype(np.float32) if values.any() else None

    def _together(self, words: list[str]) -> dict[int, np.ndarray]:
        """The words are put after each other with a gap no triple spans."""
        gap = 2 + GAPS
        sizes = np.array([len(w) + gap for w in words], np.int64)
        codes = symbols((" " * gap).join(words) + " " * gap)
        # White space becomes symbol 0, which no landmark has.
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes[inside >= sizes[owner] - gap] = 0
        found_triples, weights, owners = [], [], []
        for a, b, weight in OFFSETS:
            n = len(codes) - b
            if n <= 0:
                continue
            found = codes[:n] << 10 | codes[a : a + n] << 5 | codes[b : b + n]
            hits = np.flatnonzero(self.known[found])
            found_triples.append(found[hits])
            weights.append(np.full(len(hits), weight, np.float32))
            owners.append(owner[hits])
        if not found_triples:
            return {}
        triple, weight, who = map(np.concatenate, (found_triples, weights, owners))
        if not len(who):
            return {}
        by = np.argsort(who, kind="stable")
        triple, weight, who = triple[by], weight[by], who[by]
        starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        # Fewer than two of a landmark's triples are chance.
        many = np.diff(np.concatenate([starts, [len(who)]])) >= 2
        result: dict[int, np.ndarray] = {}
        for at in range(0, len(starts), WEIGHED):
            part = starts[at : at + WEIGHED]
            end = starts[at + WEIGHED] if at + WEIGHED < len(starts) else len(who)
            values = self.table[triple[part[0] : end]] * weight[part[0] : end, None]
            sums = np.minimum(1.0, np.add.reduceat(values, part - part[0]) / self.own)
            sums = np.where(sums < FLOOR, 0, sums**2)
            for k in np.flatnonzero(sums.any(1) & many[at : at + WEIGHED]):
                result[int(who[part[k]])] = sums[k].astype(np.float32)
        return result
