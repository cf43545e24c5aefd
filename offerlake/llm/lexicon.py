"""Minimal acyclic automaton of words: each word's path also yields its number."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """One block of bytes holding the automaton of the words and their id lists.

    Words are added in order; a state whose words have all been read is replaced by an equal
    one met before, so suffixes are shared. The number of words that end before a transition
    is kept beside it; their sum along a path numbers the words, and the number finds the ids.
    The empty word is not allowed.
    """
    words = sorted(entries)
    labels: list[list[int]] = [[]]
    targets: list[list[int]] = [[]]
    final = [False]
    register: dict[tuple, int] = {}

    def settle(path: list[int], down_to: int) -> None:
        while len(path) - 1 > down_to:
            state = path.pop()
            parent = path[-1]
            key = (final[state], tuple(labels[state]), tuple(targets[state]))
            targets[parent][-1] = register.setdefault(key, state)

    path, last = [0], b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(path, common)
        for byte in word[common:]:
            labels.append([])
            targets.append([])
            final.append(False)
            labels[path[-1]].append(byte)
            targets[path[-1]].append(len(labels) - 1)
            path.append(len(labels) - 1)
        final[path[-1]] = True
        last = word
    settle(path, 0)

    # Number the states that can be reached, children before parents.
    order: list[int] = []
    seen: set[int] = set()
    stack = [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            order.append(state)
        elif state not in seen:
            seen.add(state)
            stack.append((state, True))
            stack.extend((t, False) for t in targets[state] if t not in seen)
    number = {state: k for k, state in enumerate(order)}
    below: dict[int, int] = {}
    starts, label_of, target_of, skip_of = [0], bytearray(), [], []
    for state in order:
        count = int(final[state])
        for byte, to in zip(labels[state], targets[state], strict=True):
            label_of.append(byte)
            target_of.append(number[to])
            skip_of.append(count)
            count += below[to]
        below[state] = count
        starts.append(len(label_of))
    ids = [entries[w] for w in words]
    ends = np.cumsum([0] + [len(x) for x in ids])
    parts = [
        np.array(starts, np.uint32),
        np.array(target_of, np.uint32),
        np.array(skip_of, np.uint32),
        ends.astype(np.uint32),
        np.array([i for x in ids for i in x], np.uint32),
    ]
    head = np.array([len(order), len(label_of), len(words), sum(map(len, ids))], np.uint32)
    flags = bytes(final[s] for s in order)
    return b"".join([head.tobytes(), *(p.tobytes() for p in parts), bytes(label_of), flags])


class Lexicon:
    """The automaton, mapped from a file that has no name any more once it is open."""

    def __init__(self, block: bytes) -> None:
        with tempfile.TemporaryFile() as file:
            file.write(block)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        states, edges, words, ids = view[:16].cast("I")
        at = 16

        def take(n: int) -> memoryview:
            nonlocal at
            at += 4 * n
            return view[at - 4 * n : at].cast("I")

        self.starts = take(states + 1)
        self.targets, self.skips = take(edges), take(edges)
        self.ends, self.ids = take(words + 1), take(ids)
        self.labels = self.map[at : at + edges]
        self.final = self.map[at + edges :]
        self.root, self.states = states - 1, states
        # The same tables for walks of many words side by side.
        firsts = np.frombuffer(self.starts, np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(states), np.diff(firsts))
        self.edges = owner << 8 | np.frombuffer(self.labels, np.uint8)
        self.all_targets, self.all_skips, self.all_ends, self.all_ids = (
            np.frombuffer(x, np.uint32) for x in (self.targets, self.skips, self.ends, self.ids)
        )
        self.all_final = np.frombuffer(self.final, np.uint8)

    def numbers(self, words: list[bytes], longest: int) -> np.ndarray:
        """Number of each word, -1 for those that are not there; none is longer than ``longest``.

        Every step takes one byte of all words that are still on a path.
        """
        found = np.full(len(words), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        which = np.flatnonzero(sizes <= longest)
        if not len(which) or not len(self.edges):
            return found
        raw = b"".join([words[k].ljust(longest, b"\0") for k in which.tolist()])
        letters = np.frombuffer(raw, np.uint8).reshape(-1, longest).astype(np.int64)
        row = np.arange(len(which))
        state, number = np.full(len(row), self.root), np.zeros(len(row), np.int64)
        for step in range(longest + 1):
            over = sizes[which[row]] == step
            ended = over & (self.all_final[state] > 0)
            found[which[row[ended]]] = number[ended]
            row, state, number = (x[~over] for x in (row, state, number))
            if not len(row):
                break
            edge = state << 8 | letters[row, step]
            at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            on = self.edges[at] == edge
            row, at = row[on], at[on]
            state, number = self.all_targets[at].astype(np.int64), number[on] + self.all_skips[at]
        return found

    def spans(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of numbered words begin in ``all_ids``, and how many they are."""
        starts = self.all_ends[numbers].astype(np.int64)
        return starts, self.all_ends[numbers + 1].astype(np.int64) - starts

    def get(self, word: bytes) -> tuple[int, ...] | None:
        state, number = self.root, 0
        starts, labels = self.starts, self.labels
        for byte in word:
            at = labels.find(byte, starts[state], starts[state + 1])
            if at < 0:
                return None
            number += self.skips[at]
            state = self.targets[at]
        if not self.final[state]:
            return None
        return tuple(self.ids[self.ends[number] : self.ends[number + 1]])
