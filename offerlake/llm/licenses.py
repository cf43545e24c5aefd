"""Licence scans: texts are streamed through a suffix automaton of licence wording.

The automaton holds every run of words of every template. A text's matching statistics (the
longest run of template words that ends at each word) give maximal matches; matches in the
same order as in a template, a few words apart, are chained into spans of that template.

Defined results: a null or empty text has no words and no labels, score 0; repeated rows are
scanned one by one; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from offerlake.llm.common import ALNUM_WORD, lower_bytes, map_arrow
from offerlake.llm.license_texts import PHRASES, TEMPLATES

#: Words of the shortest match that may join a chain, and words of text that a chain may skip.
MIN_MATCH, MAX_GAP = 3, 12
#: Share of a template's words that a span must cover to count.
MIN_COVERAGE = 0.5

Span = tuple[str, int, int, float]


@dataclass
class Automaton:
    """Generalised suffix automaton over the words of phrases and templates."""

    words: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: First end of a state's runs in each template that has them.
    places: list[dict[int, int]] = field(default_factory=lambda: [{}])
    #: Phrases that end where a state's runs end: (words, label), shortest first.
    phrases: list[list[tuple[int, str]]] = field(default_factory=list)
    templates: list[tuple[str, int]] = field(default_factory=list)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        self.places.append({})
        return len(self.length) - 1

    def _split(self, state: int, by: int, to: int) -> int:
        """The state of ``state``'s runs followed by word ``by``, none longer."""
        if self.length[state] + 1 == self.length[to]:
            return to
        copy = self._state(self.length[state] + 1, dict(self.step[to]), self.link[to])
        while state >= 0 and self.step[state].get(by) == to:
            self.step[state][by] = copy
            state = self.link[state]
        self.link[to] = copy
        return copy

    def _extend(self, last: int, by: int) -> int:
        there = self.step[last].get(by)
        if there is not None:
            return self._split(last, by, there)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and by not in self.step[last]:
            self.step[last][by] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, by, self.step[last][by])
        return new

    @classmethod
    def of(cls, phrases: dict[str, str], templates: tuple[tuple[str, str], ...]) -> Automaton:
        self = cls()
        texts = [ALNUM_WORD.findall(lower_bytes(t)) for t in [*phrases, *(t for _, t in templates)]]
        for text in texts:
            last = 0
            for word in text:
                last = self._extend(last, self.words.setdefault(word, len(self.words)))
        labels = [*phrases.values(), *(label for label, _ in templates)]
        self.templates = [(label, len(text)) for label, text in zip(labels, texts, strict=True)]
        whole: dict[int, list[tuple[int, str]]] = {}
        for k, text in enumerate(texts):
            state = 0
            for end, word in enumerate(text, 1):
                state = self.step[state][self.words[word]]
                up = state
                while up > 0 and k not in self.places[up]:
                    self.places[up][k] = end
                    up = self.link[up]
            if k < len(phrases):
                whole.setdefault(state, []).append((len(text), labels[k]))
        for state in range(len(self.length)):
            ending, up = [], state
            while up > 0:
                ending += whole.get(up, [])
                up = self.link[up]
            self.phrases.append(sorted(ending))
        return self

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[Span]]:
        """Places of phrases (label, first word), and spans (label, start, end, coverage)."""
        step, link, length, phrases = self.step, self.link, self.length, self.phrases
        found: list[tuple[str, int]] = []
        matches: list[tuple[int, int, int]] = []  # end, words, state
        state = size = 0
        for at, by in enumerate(map(self.words.get, words)):
            if by is None:
                if size:
                    if size >= MIN_MATCH:
                        matches.append((at, size, state))
                    state = size = 0
                continue
            to = step[state].get(by)
            if to is None:
                if size >= MIN_MATCH:
                    matches.append((at, size, state))
                while to is None and state:
                    state = link[state]
                    size = length[state]
                    to = step[state].get(by)
                if to is None:
                    continue
            state, size = to, size + 1
            if phrases[state]:
                found += [(label, at + 1 - n) for n, label in phrases[state] if n <= size]
        if size >= MIN_MATCH:
            matches.append((len(words), size, state))
        return found, self._chain(matches)

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[Span]:
        """Best chains of each template; chains further than ``MAX_GAP`` apart are separate.

        A match looks back over the matches that end at most ``MAX_GAP`` words before its own
        start; ends are distinct, so these are a bounded number.
        """
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, state in matches:
            for k, place in self.places[state].items():
                by_template.setdefault(k, []).append((end, min(size, place), place))
        spans: list[Span] = []
        for k, own in by_template.items():
            label, total = self.templates[k]
            best: list[tuple[int, int]] = []  # covered template words, start of the chain
            for i, (end, size, place) in enumerate(own):
                covered, start = size, end - size
                for j in range(i - 1, -1, -1):
                    before, _, place_before = own[j]
                    if before < end - size - MAX_GAP:
                        break
                    fresh = min(size, place - place_before, end - before)
                    if fresh > 0 and best[j][0] + fresh > covered:
                        covered, start = best[j][0] + fresh, best[j][1]
                best.append((covered, start))
            groups: dict[int, tuple[int, int]] = {}
            for (covered, start), (end, _, _) in zip(best, own, strict=True):
                if covered > groups.get(start, (0, 0))[0]:
                    groups[start] = (covered, end)
            for start, (covered, end) in groups.items():
                if covered >= MIN_COVERAGE * total:
                    spans.append((label, start, end, min(1.0, covered / total)))
        return sorted(spans)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
) -> DataFrame:
    """(id, n_words, phrases array<struct<label, start>>, spans array<struct<label, start,
    end, coverage>>) per row; starts and ends count words from 0, ends are exclusive.

    The automaton is sent to every task; its size is that of the given wording.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton.of(phrases, templates))
    kind = docs.schema[id_col].dataType.simpleString()
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    span = pa.list_(
        pa.struct(
            [
                ("label", pa.string()),
                ("start", pa.int64()),
                ("end", pa.int64()),
                ("coverage", pa.float64()),
            ]
        )
    )

    def step(batch):
        scanner = automaton.value
        counts, places, spans = [], [], []
        for text in batch.column(1).to_pylist():
            words = ALNUM_WORD.findall(lower_bytes(text))
            found, chained = scanner.scan(words)
            counts.append(len(words))
            places.append([{"label": a, "start": b} for a, b in found])
            spans.append(
                [
                    {"label": a, "start": b, "end": c, "coverage": d}
                    for a, b, c, d in chained
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(places, place),
                pa.array(spans, span),
            ],
            names=[id_col, "n_words", "phrases", "spans"],
        )

    return map_arrow(
        docs.select(id_col, text_col),
        step,
        f"`{id_col}` {kind}, n_words bigint, phrases array<struct<label:string,start:bigint>>, "
        "spans array<struct<label:string,start:bigint,end:bigint,coverage:double>>",
    )
