"""Benchmark decontamination: an FM-index per shard of documents answers benchmark windows.

A shard is one batch of documents inside a task; documents are not shuffled. Words that no
item has cannot be part of a window and only separate passages, so they are left out of the
index. The items come in blocks of bounded size; each block is one more pass over the shard
in the same worker, and is sent to the tasks.

Defined results: a null or empty text has no words and no hits; an item without words (or a
null text) has no windows; an item of fewer words than a window is one window; windows of a
null item id hit words but name no item; an id that several items bear counts once; an empty
benchmark leaves every document clean. Repeated document rows are treated one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import ALNUM_WORD, lower_bytes, map_arrow
from offerlake.llm.fm_index import FMIndex

WINDOW = 10
#: Words of the items in one block, at most (one longer item is a block of its own).
BLOCK_WORDS = 2_000_000

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Block:
    """Distinct windows of some items as numbers of words, and the items that have them."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.words: dict[bytes, int] = {}
        names: dict[str, int] = {}
        seen: dict[tuple[int, ...], set[int]] = {}
        for name, words in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            for at in range(max(1, len(ids) - window + 1)):
                owners = seen.setdefault(tuple(ids[at : at + window]), set())
                if name is not None:
                    owners.add(names.setdefault(name, len(names)))
        self.names = list(names)
        self.lengths = np.array([len(w) for w in seen], np.int64)
        self.windows = np.array([(0,) * (window - len(w)) + w for w in seen], np.int64)
        self.owners = np.array([i for own in seen.values() for i in sorted(own)], np.int64)
        self.owner_ends = np.cumsum([0] + [len(own) for own in seen.values()])
        self.shortest = int(self.lengths.min())


def item_blocks(
    benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int
) -> Iterator[Block]:
    """The items, read one partition at a time, in blocks of at most ``block_words`` words."""
    items: list[tuple[str | None, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for row in rows.toLocalIterator():
        words = ALNUM_WORD.findall(lower_bytes(row.t))
        if not words:
            continue
        if items and size + len(words) > block_words:
            yield Block(items, window)
            items, size = [], 0
        items.append((row.i, words))
        size += len(words)
    if items:
        yield Block(items, window)


def _covered(covers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covers.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def find(block: Block, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits in a shard: starts and ends of runs of hit words over all its texts, put one after
    the other with one place between them; and pairs (text, item) as rows of an array."""
    ids: list[int] = []
    for words in texts:
        ids += map(block.words.get, words, repeat(0))
        ids.append(0)
    every = np.array(ids, np.int64)
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    starts, ends = _covered(every > 0)
    long_enough = ends - starts >= block.shortest
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts):
        return nothing
    # Passages with their separators, and where each place comes from.
    sizes = ends - starts + 1
    into = np.cumsum(sizes) - sizes
    source = np.repeat(starts - into, sizes) + np.arange(int(sizes.sum()))
    index = FMIndex(every[source], len(block.words))
    low, high = index.search(block.windows, block.lengths)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    if not len(which):
        return nothing
    rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(len(which))
    places = source[index.locate(rows)]
    marks = np.zeros(len(every) + 1, np.int64)
    np.add.at(marks, places, 1)
    np.add.at(marks, places + block.lengths[which], -1)
    hit_starts, hit_ends = _covered(np.cumsum(marks[:-1]) > 0)
    text_of = np.searchsorted(np.cumsum([len(w) + 1 for w in texts]), places, side="right")
    pairs = np.unique(np.stack([text_of, which], 1), axis=0)
    owned = block.owner_ends[pairs[:, 1] + 1] - block.owner_ends[pairs[:, 1]]
    at = np.repeat(block.owner_ends[pairs[:, 1]] - (np.cumsum(owned) - owned), owned)
    items = block.owners[at + np.arange(int(owned.sum()))]
    named = np.unique(np.stack([np.repeat(pairs[:, 0], owned), items], 1), axis=0)
    return hit_starts, hit_ends, named


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((start, end))
    return merged


def without_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without what reaches from the first to the last word of each span."""
    if text is None or not spans:
        return text
    raw = text.encode()
    places = [m.span() for m in ALNUM_WORD.finditer(raw.lower())]
    kept, at = [], 0
    for start, end in spans:
        kept.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def _finder(
    docs: DataFrame,
    benchmark: DataFrame,
    item_col: str,
    item_text_col: str,
    window: int,
    block_words: int,
):
    """A function from texts to their words, merged spans and items, one block after the other
    in the same worker."""
    context = docs.sparkSession.sparkContext
    sent = [
        context.broadcast(block)
        for block in item_blocks(benchmark, item_col, item_text_col, window, block_words)
    ]

    def run(column: pa.Array) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        texts = [ALNUM_WORD.findall(lower_bytes(t)) for t in column.to_pylist()]
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        limits = np.cumsum([0] + [len(w) + 1 for w in texts])
        for block in (x.value for x in sent):
            starts, ends, pairs = find(block, texts)
            owners = np.searchsorted(limits, starts, side="right") - 1
            for k, a, b in zip(owners.tolist(), starts.tolist(), ends.tolist(), strict=True):
                spans[k].append((a - int(limits[k]), b - int(limits[k])))
            for k, i in pairs.tolist():
                items[k].add(block.names[i])
        return [len(w) for w in texts], [merge_spans(s) for s in spans], [list(i) for i in items]

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, n_words, spans array<struct<start, end>>, items array<string>) per row.

    Spans count words from 0, ends are exclusive; they do not touch each other. Items are the
    distinct ids of items with a window in the text, as strings in no given order.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found_in = _finder(docs, benchmark, item_col, item_text_col, window, block_words)

    def step(batch):
        sizes, spans, items = found_in(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPANS),
                pa.array(items, pa.list_(pa.string())),
            ],
            names=[id_col, "n_words", "spans", "items"],
        )

    schema = (
        f"`{id_col}` {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, "
        "items array<string>"
    )
    return map_arrow(docs.select(id_col, text_col), step, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``docs``, all columns, with texts without the words that windows cover."""
    names = docs.columns
    at = names.index(text_col)
    found_in = _finder(docs, benchmark, item_col, item_text_col, window, block_words)

    def step(batch):
        _, spans, _ = found_in(batch.column(at))
        columns = batch.columns
        texts = zip(columns[at].to_pylist(), spans, strict=True)
        columns[at] = pa.array([without_words(t, s) for t, s in texts], pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs, step, docs.schema)
