"""Suffix order of a sequence of whole numbers, by doubling over what is still tied."""

from __future__ import annotations

import numpy as np


def suffix_ranks(ranks: np.ndarray, compared: int = 1, depth: int | None = None) -> np.ndarray:
    """Rank of each suffix; suffixes that agree in ``depth`` symbols may share one.

    ``ranks`` orders the suffixes by their first ``compared`` symbols, as any whole numbers.
    The end of the sequence is smaller than every symbol. Without ``depth`` all ranks differ.
    A rank is the number of suffixes that are smaller.
    """
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    values = ranks[order]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    last = np.empty(n, bool)
    last[-1:] = True
    last[:-1] = new[1:]
    tied = order[~(new & last)]
    while len(tied) and (depth is None or compared < depth):
        after = tied + compared
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        m = len(tied)
        old = rank[tied]
        at = np.arange(m)
        fresh = np.empty(m, bool)
        fresh[0] = True
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        group = np.empty(m, bool)
        group[0] = True
        np.not_equal(old[1:], old[:-1], out=group[1:])
        start = np.maximum.accumulate(np.where(fresh, at, 0))
        group_start = np.maximum.accumulate(np.where(group, at, 0))
        rank[tied] = old + start - group_start
        end = np.empty(m, bool)
        end[-1] = True
        end[:-1] = fresh[1:]
        tied = tied[~(fresh & end)]
        compared *= 2
    return rank
