"""SimHash near-duplicates: fingerprints meet on variants half-way between them.

The 64 bits are three parts of 22, 21 and 21. Fingerprints that differ in at most three bits
differ in at most two within some two parts taken together: leave out a part that differs
most. Each fingerprint therefore emits, for each two parts, all variants within one bit, half
of that radius; both fingerprints of a link emit a variant in common. Fingerprints that
collide are compared in full, and links become components by distributed union-find.

Equal fingerprints are one row from the start, so a group of copies of any size costs nothing.
In the group of a variant only a forest of true links is emitted, never all pairs.

Defined results: a null or empty text has fingerprint zero, which links like any other; texts
of fewer words than a shingle are one shingle; rows are kept one by one, repeated ones too; a
row with a null id has the component of its fingerprint, null if no row of it has an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import SPACED_WORD, connected, lower_bytes, map_arrow, signed
from offerlake.llm.groups import whole_groups
from offerlake.session import materialize

SHINGLE = 3
SEED = 42
RADIUS = 3
#: First bits of the three parts, and one past the last.
PARTS = (0, 22, 43, 64)
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 15
#: Variants that a task looks at together.
GROUP_ROWS = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash over XXH64 of the text's word shingles, repeated ones counted each time."""
    words = SPACED_WORD.findall(lower_bytes(text))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, COUNTED):
        bits = np.unpackbits(hashes[at : at + COUNTED].view(np.uint8))
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row; fp holds the 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(batch):
        values = [fingerprint(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(signed(np.array(values, np.uint64)))], names=[id_col, "fp"]
        )

    return map_arrow(docs.select(id_col, text_col), step, f"`{id_col}` {kind}, fp bigint")


def _as_long(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): each distinct fingerprint under all its variants."""
    tables = []
    for part in range(3):
        low, high = PARTS[part], PARTS[part + 1]
        left_out = ((1 << high) - 1) ^ ((1 << low) - 1)
        # The bits left out say which part that is.
        tag = (part + 1) << low
        flips = [0, *(1 << b for b in range(64) if not low <= b < high)]
        base = F.col("fp").bitwiseAND(F.lit(_as_long(~left_out & (1 << 64) - 1))).bitwiseOR(
            F.lit(_as_long(tag))
        )
        tables += [base.bitwiseXOR(F.lit(_as_long(f))) for f in flips]
    return fps.select(F.explode(F.array(*tables)).alias("key"), "fp")


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Pairs of places in ``values`` that differ in at most ``radius`` bits, enough of them to
    connect all that such pairs connect. Every value is met once per visited value before it,
    so a group of close ones takes one look."""
    links = []
    left = np.arange(len(values))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= radius
            found = left[near].tolist()
            left = left[~near]
            links += [(at, k) for k in found]
            queue += found
    return links


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect what is linked."""

    def run(batches):
        for table in whole_groups(batches, "key", GROUP_ROWS):
            keys = table.column("key").to_numpy()
            values = table.column("fp").to_numpy().view(np.uint64)
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            sizes = np.diff(edges)
            # Groups of two at once, larger ones one by one.
            two = edges[:-1][sizes == 2]
            two = two[np.bitwise_count(values[two] ^ values[two + 1]) <= RADIUS]
            lefts, rights = [two], [two + 1]
            for start, size in zip(edges[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                found = np.array(forest(values[start : start + size]), np.int64).reshape(-1, 2)
                lefts.append(start + found[:, 0])
                rights.append(start + found[:, 1])
            pairs = np.stack([values[np.concatenate(lefts)], values[np.concatenate(rights)]], 1)
            # Variants for different parts may be equal, so a fingerprint may meet itself.
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(pairs[:, 0])), pa.array(signed(pairs[:, 1]))], names=["a", "b"]
            )

    met = variants(fps).repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(run, "a bigint, b bigint")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): smallest id of the rows that links reach from each row."""
    marked = materialize(fingerprints(docs, id_col, text_col), "simhash")
    fps = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("first_id")), "simhash-fps")
    grouped = connected(fps.select(F.col("fp").alias("v")), links(fps.select("fp")), "simhash")
    members = fps.join(grouped, fps["fp"] == grouped["v"]).select("fp", "component", "first_id")
    lowest = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = members.join(lowest, "component").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, all columns.

    Rows of one id stand for one document and stay or go together; rows without an id stay.
    """
    found = components(docs, id_col, text_col)
    gone = (
        found.where(F.col(id_col) != F.col("component_id"))
        .select(F.col(id_col).alias("_gone"))
        .distinct()
    )
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
