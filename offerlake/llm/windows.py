"""Windows of a sequence, gathered by the smallest hash of the short pieces they hold.

Equal windows hold equal pieces, so they have the same smallest hash: their anchor. Consecutive
windows of one anchor are one run, and a run is one row, so a text becomes far fewer rows than
it has windows, and all that may be equal meets under one anchor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import ODD

#: Places of a sequence that are looked at together; runs end where they do, which parts
#: equal runs at different places but no equal windows.
PIECE = 1 << 18


def piece_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash for each place of the ``length`` symbols that begin there.

    Hashes of powers of two are made from two halves each; those of other lengths from two
    overlapping ones.
    """
    with np.errstate(over="ignore"):
        values, size = symbols.astype(np.uint64) * ODD, 1
        values ^= values >> np.uint64(29)
        while size < length:
            step = min(size, length - size)
            left, right = values[: len(values) - step], values[step:]
            values = left * np.uint64(0xBF58476D1CE4E5B9 + 2 * size) + right
            values ^= values >> np.uint64(31)
            values *= ODD
            size += step
        return values ^ (values >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` values in a row, from running minima of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - width + 1
    return np.minimum(behind[:last], ahead[width - 1 : width - 1 + last])


def anchored_runs(
    symbols: np.ndarray, window: int, piece: int, count_pieces: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a sequence: first window, number of windows, anchor, and whether the anchor's
    piece is there more than once, without which no two windows of a run can be equal
    (``count_pieces``; else false)."""
    starts, counts, anchors, repeated = [], [], [], []
    total = len(symbols) - window + 1
    for at in range(0, total, PIECE):
        part = symbols[at : min(at + PIECE, total) + window - 1]
        hashes = piece_hashes(part, piece)
        width = window - piece + 1
        lows = sliding_min(hashes, width)
        edges = np.flatnonzero(np.concatenate([[True], lows[1:] != lows[:-1]]))
        sizes = np.diff(np.concatenate([edges, [len(lows)]]))
        own = lows[edges]
        twice = np.fromiter(
            (
                count_pieces and n > 1 and np.count_nonzero(hashes[a : a + n + width - 1] == h) > 1
                for a, n, h in zip(edges.tolist(), sizes.tolist(), own, strict=True)
            ),
            bool,
            len(edges),
        )
        starts.append(edges + at)
        counts.append(sizes)
        anchors.append(own)
        repeated.append(twice)
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    return tuple(map(np.concatenate, (starts, counts, anchors, repeated)))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text): ``mark`` is a hash of the text, so that rows which share an id, or
    have none, are told apart unless they are equal."""
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")
    )


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["mark"] == right["mark"])
