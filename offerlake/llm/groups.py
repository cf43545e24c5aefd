"""Reading rows that are sorted by a key, group by group, whatever the batches are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of at least ``rows`` rows each but the last.

    The batches are sorted by ``key``; only the last group of what has been read is held back.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        column = batch.column(key)
        if size < rows or (column[0] == column[-1] and held[0].column(key)[0] == column[0]):
            continue
        together = pa.Table.from_batches(held).combine_chunks()
        last = pc.equal(together.column(key), together.column(key)[-1])
        cut = pc.index(last, True).as_py()
        if cut:
            yield together.slice(0, cut)
            rest = together.slice(cut)
            held, size = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
