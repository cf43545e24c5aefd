"""Embedding near-duplicates: cross-polytope hashes after fast Hadamard rotations.

A vector's hash is the corner of the cross-polytope that a random rotation brings it nearest
to; a few hashes make a bucket key, and a vector enters its own bucket and the next nearest
ones of each table. Vectors of equal label that share a bucket are compared in double
precision, so no link below the threshold is reported; recall is a matter of ``TABLES``.

Equal vectors are one row with a count from the start. A bucket of many different vectors is
cut into blocks, and each pair of blocks is compared on its own, so no task holds more than
two blocks of it. A pair is counted in the smallest key that both vectors have, no pair leaves
its task: what does are sums per vector and a forest of links.

Defined results: null or zero vectors and those with null or non-finite components, and
vectors with a null label, link with nothing and are their own component; vectors of different
lengths do not link; rows of one id are counted one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import bound_batches, connected, mix, signed
from offerlake.llm.groups import whole_groups
from offerlake.session import materialize

THRESHOLD = 0.98
#: Tables, hashes that make a key, and buckets per table that a vector enters.
TABLES, HASHES, PROBES = 10, 2, 3
SEED = 20
#: Different vectors of one block.
BLOCK = 1000
#: Rows that a task looks at together, unless one group is larger.
GROUP_ROWS = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n = x.shape[1]
    step = 1
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(-1, n)
        step *= 2
    return x / np.sqrt(n)


def bucket_keys(vectors: np.ndarray) -> np.ndarray:
    """Keys of each row: ``TABLES * PROBES`` unsigned 64-bit numbers.

    Per table, ``HASHES`` rotations (three rounds of random signs and a transform) give the
    nearest corner and the runner-up; besides the key of the nearest corners, those keys come
    next in which one corner is replaced, the closest call first.
    """
    count, size = vectors.shape
    width = max(2, 1 << (size - 1).bit_length())
    unit = np.zeros((count, width))
    unit[:, :size] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    random = np.random.default_rng(SEED)
    keys = []
    rows = np.arange(count)
    for table in range(TABLES):
        corners, seconds, losses = [], [], []
        for _ in range(HASHES):
            turned = unit
            for _ in range(3):
                turned = hadamard(turned * random.choice([-1.0, 1.0], width))
            heights = np.abs(turned)
            first = heights.argmax(1)
            top = heights[rows, first]
            heights[rows, first] = -1
            second = heights.argmax(1)
            corners.append(2 * first + (turned[rows, first] > 0))
            seconds.append(2 * second + (turned[rows, second] > 0))
            losses.append(top - heights[rows, second])
        order = np.argsort(np.stack(losses, 1), axis=1, kind="stable")
        for probe in range(PROBES):
            key = mix(np.full(count, table + 1, np.uint64))
            for k in range(HASHES):
                replaced = (order[:, probe - 1] == k) if probe else np.zeros(count, bool)
                corner = np.where(replaced, seconds[k], corners[k])
                key = mix(key + corner.astype(np.uint64))
            keys.append(key)
    return np.stack(keys, 1)


def with_place(keys: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Keys of vectors of this length whose labels have these hashes."""
    return mix(keys ^ mix(place.view(np.uint64) + np.uint64(size))[:, None])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    values = column.combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def distinct_vectors(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(u, label, vector, m, first_id): vectors that can link, each once; u numbers them."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = table.where(
        F.col(label_col).isNotNull()
        & F.col(vec_col).isNotNull()
        & F.coalesce(finite, F.lit(False))
        & F.exists(vec_col, lambda x: x != 0)
    )
    grouped = usable.groupBy(F.col(label_col).alias("label"), F.col(vec_col).alias("vector")).agg(
        F.count("*").alias("m"), F.min(id_col).alias("first_id")
    )
    return materialize(
        grouped.select(F.monotonically_increasing_id().alias("u"), "*"), "vectors"
    )


def bucket_rows(vectors: DataFrame) -> DataFrame:
    """(key, u, m, place, vector): each vector under all its keys; vectors of different
    labels or lengths share no key."""
    kind = vectors.schema["vector"].dataType.simpleString()
    vector_type = pa.list_(pa.float64() if "double" in kind else pa.float32())

    def run(batches):
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                own = bucket_keys(_matrix(pa.chunked_array([part.column("vector")])))
                keys = with_place(own, part.column("place").to_numpy(), size)
                again = np.repeat(np.arange(len(at)), keys.shape[1])
                rows = part.take(pa.array(again))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(keys.ravel())),
                        rows.column("u"),
                        rows.column("m"),
                        rows.column("place"),
                        rows.column("vector").cast(vector_type),
                    ],
                    names=["key", "u", "m", "place", "vector"],
                )

    marked = vectors.select("u", "m", "vector", F.xxhash64("label").alias("place"))
    return marked.mapInArrow(run, f"key bigint, u bigint, m bigint, place bigint, vector {kind}")


def blocks(rows: DataFrame) -> DataFrame:
    """The rows with a cell (key, block pair): whole buckets, or pairs of blocks of large ones.

    ``one`` and ``two`` are the blocks of the cell, ``own`` the block of the row.
    """
    large = (
        rows.groupBy("key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > BLOCK)
        .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    )
    placed = rows.join(large, "key", "left").withColumn(
        "own", F.pmod(F.hash("u"), F.coalesce("parts", F.lit(1)))
    )
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("other")
    cells = placed.select("key", "u", "m", "place", "vector", "own", other)
    return cells.select(
        "*", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")
    ).withColumn("cell", F.xxhash64("key", "one", "two"))


def meets_here(keys: np.ndarray, i: np.ndarray, j: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a pair's ``key`` is the smallest key that rows i and j of ``keys`` have in common."""
    here = np.empty(len(i), bool)
    most = np.uint64(2**64 - 1)
    for at in range(0, len(i), 4096):
        one, two = keys[i[at : at + 4096]], keys[j[at : at + 4096]]
        common = (one[:, :, None] == two[:, None, :]).any(2)
        here[at : at + 4096] = np.where(common, one, most).min(1) == key[at : at + 4096]
    return here


def lowest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest of n places that each one reaches over the links i, j."""
    lowest = np.arange(n)
    while True:
        before = lowest.copy()
        np.minimum.at(lowest, i, before[j])
        np.minimum.at(lowest, j, before[i])
        lowest = lowest[lowest]
        if (lowest == before).all():
            return lowest


def linked_pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows of one cell that link."""
    vectors = _matrix(rows.column("vector"))
    own = rows.column("own").to_numpy()
    one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    left, right = np.flatnonzero(own == one), np.flatnonzero(own == two)
    i, j = np.nonzero(unit[left] @ unit[right].T >= THRESHOLD)
    i, j = left[i], right[j]
    return (i[i < j], j[i < j]) if one == two else (i, j)


def keys_of(rows: pa.Table) -> np.ndarray:
    """All keys of each row, vectors of one length at a time."""
    sizes = rows.column("vector").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    keys = np.empty((len(sizes), TABLES * PROBES), np.uint64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        part = rows.take(pa.array(at))
        keys[at] = with_place(bucket_keys(_matrix(part.column("vector"))), part.column("place").to_numpy(), size)
    return keys


def compared(cells: DataFrame) -> DataFrame:
    """(u, n, v): links counted for u in one cell, and a vector v that they connect it with.

    A pair counts in the cell of the smallest key it has in common. The keys of all rows with
    links are made anew for many cells at a time, rather than sent along with every row.
    """

    def counted(table: pa.Table, bounds: list[tuple[int, int]]) -> pa.RecordBatch | None:
        found = [(a, *linked_pairs(table.slice(a, b - a))) for a, b in bounds if b - a > 1]
        i = np.concatenate([a + one for a, one, _ in found] or [np.zeros(0, np.int64)])
        j = np.concatenate([a + two for a, _, two in found] or [np.zeros(0, np.int64)])
        if not len(i):
            return None
        used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        table = table.take(pa.array(used))
        i, j = place[: len(i)], place[len(i) :]
        key = table.column("key").to_numpy().view(np.uint64)
        here = meets_here(keys_of(table), i, j, key[i])
        i, j = i[here], j[here]
        u, m = (table.column(c).to_numpy() for c in ("u", "m"))
        counts = np.zeros(len(u), np.int64)
        np.add.at(counts, i, m[j])
        np.add.at(counts, j, m[i])
        linked = np.flatnonzero(counts)
        lowest = u[lowest_reached(len(u), i, j)]
        return pa.RecordBatch.from_arrays(
            [pa.array(u[linked]), pa.array(counts[linked]), pa.array(lowest[linked])],
            names=["u", "n", "v"],
        )

    def run(batches):
        for table in whole_groups(batches, "cell", GROUP_ROWS):
            cell, key = table.column("cell").to_numpy(), table.column("key").to_numpy()
            changes = (cell[1:] != cell[:-1]) | (key[1:] != key[:-1])
            edges = np.flatnonzero(np.concatenate([[True], changes, [True]])).tolist()
            got = counted(table, list(zip(edges[:-1], edges[1:], strict=True)))
            if got is not None:
                yield got

    dealt = cells.repartition("cell").sortWithinPartitions("cell", "key", "one", "two")
    return dealt.mapInArrow(run, "u bigint, n bigint, v bigint")


def near_duplicates(
    table: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``table``."""
    bound_batches(table.sparkSession)
    rows = table.select(id_col, vec_col, label_col)
    vectors = distinct_vectors(rows, id_col, vec_col, label_col)
    met = materialize(compared(blocks(bucket_rows(vectors))), "vector-links")
    grouped = connected(
        vectors.select(F.col("u").alias("v")),
        met.select(F.col("u").alias("a"), F.col("v").alias("b")),
        "vectors",
    )
    counts = met.groupBy("u").agg(F.sum("n").alias("n"))
    members = vectors.join(grouped, vectors["u"] == grouped["v"]).join(counts, "u", "left")
    lowest = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = members.join(lowest, "component").select(
        F.col("label").alias("_label"),
        F.col("vector").alias("_vector"),
        (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"),
        "component_id",
    )
    found = rows.join(
        known,
        (rows[label_col] == known["_label"]) & (rows[vec_col] == known["_vector"]),
        "left",
    )
    component = F.coalesce("component_id", id_col)
    return found.select(
        id_col,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col(id_col) == component).alias("kept"),
    )
