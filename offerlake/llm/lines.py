"""Line dedup: near-duplicate lines by MinHash, one line kept per component.

A line is described by its character shingles. One hash per shingle fills ``BINS`` bins, each
with the smallest hash that falls into it; empty bins borrow from the next full one. Bands of
bins are bucket keys. Equal lines are one row from the start. In each bucket, lines are first
compared with one line of it, by the exact Jaccard similarity of their shingles, which 54 bits
of a hash tell apart; what that connects is one component. Then lines of one bucket that are
still in different components are compared with each other: counts of their shingles bound what two lines can have in common,
and pairs that may reach the similarity asked for are compared exactly, unless links connect
them already, so no candidate pair goes unanswered. Of a bucket only a forest of links leaves
the task. Links of both passes become components by distributed union-find.

A component keeps its line in the document with the smallest id, there the first one; all
others go, with their line ends. Lines are compared without white space at their ends and as
lower-case; lines without a letter or digit are layout and stay.

Defined results: a null or empty text has no lines and stays as it is; a null id comes after
all others; lines shorter than a shingle are one shingle; rows with equal id and text are one
document and keep the same lines.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.llm.common import bound_batches, connected, mix, signed
from offerlake.llm.groups import whole_groups
from offerlake.llm.windows import keyed, piece_hashes
from offerlake.session import materialize

SHINGLE = 9
SIMILARITY = 0.8
#: Bands of bins: at the similarity asked for, a pair shares a band with probability
#: 1 - (1 - 0.8 ** 7) ** 20 = 0.991, and more above it.
BANDS, BAND_BINS = 20, 7
BINS = BANDS * BAND_BINS
#: Cells that the shingles of a line are counted in. Two lines have no more shingles in common
#: than the sum of the smaller counts, so a pair under the bound is no link, whatever its length.
CELLS = 128
MOST = np.iinfo(np.uint8).max
#: Bits of the shingles' hashes that lines are compared by; those above number up to 1,024 lines.
SHINGLE_BITS = np.uint64(54)
SHINGLE_MASK = (np.uint64(1) << SHINGLE_BITS) - np.uint64(1)
GROUP_ROWS = 100_000
#: Lines of a block of a large bucket.
BUCKET_BLOCK = 2000
#: Lines of a bucket whose counts are compared with all others of it at a time.
COMPARED = 128
#: Lines up to which the pairs of a bucket are listed, together with those of other buckets, and
#: pairs whose counts are compared at a time.
LISTED, LISTED_PAIRS = 64, 1 << 13
#: Cells that the keys of lines are dealt to, and blocks of keys that a task sorts together.
KEY_CELLS, KEY_BLOCKS = 4096, 2000
#: Shingles of lines of a bucket that are held to be compared.
HELD = 1_000_000
#: Characters of lines that a task hashes together, and lines: each takes ``BINS`` bins several
#: times over, however short it is. Arrays of this size are used again, larger ones are mapped
#: anew by every step.
HASHED, HASHED_LINES = 1 << 16, 1 << 9


def split_lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def comparable(line: str) -> str:
    """The line as it is compared; empty if it has no letter or digit."""
    line = line.strip().lower()
    return line if any(map(str.isalnum, line)) else ""


def line_key(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode())


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all lines, and how many each line has."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) for x in lines], np.int64)
    hashes = piece_hashes(np.concatenate([codes, np.zeros(SHINGLE, np.uint32)]), SHINGLE)
    counts = np.maximum(1, sizes - SHINGLE + 1)
    firsts = np.cumsum(sizes) - sizes
    places = np.repeat(firsts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    values = hashes[places]
    # A short line's only shingle is the line itself.
    short = np.flatnonzero(sizes < SHINGLE)
    own = [xxhash.xxh3_64_intdigest(lines[k].encode("utf-8", "surrogatepass")) for k in short]
    values[(np.cumsum(counts) - counts)[short]] = np.array(own, np.uint64)
    return values, counts


def band_keys(lines: list[str]) -> np.ndarray:
    """A row of ``BANDS`` unsigned keys for each line."""
    values, counts = shingle_hashes(lines)
    owner = np.repeat(np.arange(len(lines)), counts)
    values = mix(values)
    bins = (values >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)
    empty = np.iinfo(np.uint64).max
    lows = np.full(len(lines) * BINS, empty, np.uint64)
    np.minimum.at(lows, owner * BINS + bins.astype(np.int64), mix(values ^ np.uint64(SHINGLE)))
    lows = lows.reshape(-1, BINS)
    # Empty bins take the value of the next full one, round the end, and how far it is.
    full = lows != empty
    twice = np.concatenate([full, full], 1)
    at = np.where(twice, np.arange(2 * BINS), 2 * BINS)
    following = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    step = (following - np.arange(BINS)).astype(np.uint64)
    taken = np.take_along_axis(lows, following % BINS, 1)
    signature = mix(taken + step * np.uint64(0x9E3779B97F4A7C15))
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for k in range(BAND_BINS):
        keys = mix(keys + signature[:, k::BAND_BINS] + np.arange(BANDS, dtype=np.uint64))
    return keys


def line_rows(docs: DataFrame) -> DataFrame:
    """(line, text): every comparable line of ``docs`` (see ``keyed``) with its hash, equal
    lines of one batch once."""

    def run(batches):
        for batch in batches:
            lines = {c: line_key(c) for t in batch.column(0).to_pylist() for x in split_lines(t) if (c := comparable(x))}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(np.array(list(lines.values()), np.uint64))),
                    pa.array(list(lines), pa.string()),
                ],
                names=["line", "text"],
            )

    return docs.select("text").mapInArrow(run, "line bigint, text string")


def hashed_together(lines: list[str]):
    """The lines in stretches of at most ``HASHED`` characters, or one line."""
    at = 0
    while at < len(lines):
        end, size = at, 0
        while (
            end < len(lines)
            and end - at < HASHED_LINES
            and (end == at or size + len(lines[end]) <= HASHED)
        ):
            size += len(lines[end])
            end += 1
        yield lines[at:end]
        at = end


def bands_of(docs: DataFrame) -> DataFrame:
    """(cell, keys, lines): the lines of ``docs`` under their keys, equal lines of one batch once.

    ``keys`` and ``lines`` are blocks of 64-bit numbers side by side, one pair of blocks for the
    keys of a batch that belong to one cell.
    """

    def run(batches):
        for batch in batches:
            lines = list({c: None for t in batch.column(0).to_pylist() for x in split_lines(t) if (c := comparable(x))})
            if not lines:
                continue
            keys = np.concatenate([band_keys(part).ravel() for part in hashed_together(lines)])
            own = np.repeat(np.array([line_key(x) for x in lines], np.uint64), BANDS)
            cells = (keys % np.uint64(KEY_CELLS)).astype(np.uint16)
            order = np.argsort(cells, kind="stable")
            cells = cells[order]
            firsts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            bounds = pa.py_buffer((np.append(firsts, len(cells)) * 8).astype(np.int32))
            blocks = [
                pa.BinaryArray.from_buffers(pa.binary(), len(firsts), [None, bounds, pa.py_buffer(x[order])])
                for x in (keys, own)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells[firsts].astype(np.int32)), *blocks], names=["cell", "keys", "lines"]
            )

    return docs.select("text").mapInArrow(run, "cell int, keys binary, lines binary")


def buckets_of(bands: DataFrame) -> DataFrame:
    """(key, first, line): the smallest line of each key that several lines have, beside each
    of the others."""

    def run(batches):
        for table in whole_groups(batches, "cell", KEY_BLOCKS):
            keys, lines = (
                np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("keys", "lines")
            )
            order = np.argsort(keys)
            keys = keys[order]
            same_key = keys[1:] == keys[:-1]
            met = np.concatenate([[False], same_key]) | np.concatenate([same_key, [False]])
            keys, lines = keys[met], lines[order[met]]
            order = np.lexsort((lines, keys))
            keys, lines = keys[order], lines[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (lines[1:] != lines[:-1])
            keys, lines = keys[fresh], lines[fresh]
            begins = np.ones(len(keys), bool)
            begins[1:] = keys[1:] != keys[:-1]
            if not begins.all():
                firsts = lines[begins][np.cumsum(begins) - 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[~begins]) for x in (keys, firsts, lines)],
                    names=["key", "first", "line"],
                )

    dealt = bands.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "key bigint, first bigint, line bigint")


def alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those rows (a, b) of ``pairs`` whose lines' similarity is large enough. The second join
    leaves them in the order of b, so the lines of a batch are fewer than its pairs. ``texts`` has
    the counts of the lines' shingles, which rule out most of the pairs that are not alike."""
    names = ("text", "cells", "size")
    left = texts.select(F.col("line").alias("a"), *(F.col(c).alias(f"left_{c}") for c in names))
    right = texts.select(F.col("line").alias("b"), *(F.col(c).alias(f"right_{c}") for c in names))

    def run(batches):
        for batch in batches:
            (x, n), (y, m) = (
                (counts_in(batch.column(f"{side}_cells")), batch.column(f"{side}_size").to_numpy())
                for side in ("left", "right")
            )
            near = np.flatnonzero(may_be_alike(x, n, y, m))
            part = batch.take(pa.array(near))
            one, two = part.column("left_text").to_pylist(), part.column("right_text").to_pylist()
            held = shingles_of(one + two)
            kept = [
                k
                for k, (x, y) in enumerate(zip(one, two, strict=True))
                if jaccard(held[x], held[y]) >= SIMILARITY
            ]
            yield part.select([0, 1]).take(pa.array(kept, pa.int64()))

    columns = [f"{side}_{c}" for c in names for side in ("left", "right")]
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", *columns)
    return joined.mapInArrow(run, "a bigint, b bigint")


def different_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each line, ascending, side by side, and the line each
    belongs to. The lines stand in the highest bits while all are sorted at once, so ``SHINGLE_BITS``
    of a hash are kept."""
    values, counts = shingle_hashes(lines)
    owner = np.repeat(np.arange(len(lines), dtype=np.uint64), counts) << SHINGLE_BITS
    values = owner | mix(values) & SHINGLE_MASK
    values.sort()
    values = values[np.concatenate([[True], values[1:] != values[:-1]])]
    return values & SHINGLE_MASK, (values >> SHINGLE_BITS).astype(np.int64)


def counts_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many different shingles of each line fall into each cell, at most ``MOST``, and how
    many there are."""
    values, owner = different_shingles(lines)
    cells = ((values >> np.uint64(32)) % np.uint64(CELLS)).astype(np.int64)
    found = np.bincount(owner * CELLS + cells, minlength=len(lines) * CELLS).reshape(-1, CELLS)
    return np.minimum(found, MOST).astype(np.uint8), found.sum(1)


def shingle_counts(line: str) -> tuple[np.ndarray, int]:
    """``counts_of`` a single line."""
    cells, sizes = counts_of([line])
    return cells[0], int(sizes[0])


def with_counts(rows: DataFrame) -> DataFrame:
    """``rows`` with the counts of the shingles of their ``text``, one byte a cell, and how many
    shingles there are."""

    def run(batches):
        for batch in batches:
            found = [counts_of(part) for part in hashed_together(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([x.tobytes() for cells, _ in found for x in cells], pa.binary()),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *(sizes for _, sizes in found)])),
                ],
                names=[*batch.schema.names, "cells", "size"],
            )

    schema = T.StructType([*rows.schema.fields, T.StructField("cells", T.BinaryType()), T.StructField("size", T.LongType())])
    return rows.mapInArrow(run, schema)


def counts_in(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The counts of ``with_counts`` as a row of numbers for each line."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def may_be_alike(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether counts and numbers of shingles leave it open that the lines of a pair are alike."""
    common = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    # Shingles that a full cell does not count may all be common ones.
    common += np.minimum(n - x.sum(axis=1, dtype=np.int64), m - y.sum(axis=1, dtype=np.int64))
    return common >= SIMILARITY / (1 + SIMILARITY) * (n + m) - 1e-6


def block_pairs(rows: DataFrame) -> DataFrame:
    """The rows with a cell each time: a whole bucket, or two of the ``parts`` of a large one.

    ``one`` and ``two`` are the blocks of the cell, ``own`` the block of the row.
    """
    own = F.pmod(F.hash("line"), F.col("parts")).alias("own")
    cells = rows.select(
        "*", own, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    )
    return (
        cells.withColumn("one", F.least("own", "other"))
        .withColumn("two", F.greatest("own", "other"))
        .withColumn("cell", F.xxhash64("key", "one", "two"))
        .drop("other", "parts")
    )


def crossing_links(rows: DataFrame) -> DataFrame:
    """(a, b): links between lines of one bucket that were in different components.

    ``rows``: line, component, keys, text, cells, size, key, parts; ``keys`` are all buckets
    of the line. A bucket of very many lines is dealt out as pairs of its blocks; a cell is
    compared ``COMPARED`` of its lines at a time. Pairs that the counts do not rule out are
    compared exactly where they meet, each in the first bucket that it shares, and not if
    links of the cell connect it already: what leaves a cell is a forest of links, fewer than
    it has lines, whatever the number of pairs.
    """

    def listed_pairs(values: dict[str, np.ndarray], begins: np.ndarray, ends: np.ndarray):
        # All pairs of rows of these buckets, each row with those behind it.
        sizes = ends - begins
        rows = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        behind = np.repeat(ends, sizes) - 1 - rows
        passed = np.cumsum(behind) - behind
        for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(passed // LISTED_PAIRS)) + 1):
            i = np.repeat(rows[at], behind[at])
            j = i + 1 + np.arange(len(i)) - np.repeat(passed[at] - passed[at[:1]], behind[at])
            met = values["component"][i] != values["component"][j]
            met &= (values["one"][i] == values["two"][i]) | (values["own"][i] != values["own"][j])
            i, j = i[met], j[met]
            cells, size = values["cells"], values["size"]
            near = may_be_alike(cells[i], size[i], cells[j], size[j])
            yield i[near], j[near]

    def crossed_pairs(values: dict[str, np.ndarray], begin: int, end: int):
        # The pairs of a large bucket or of two of its blocks.
        own = values["own"][begin:end]
        one, two = values["one"][begin], values["two"][begin]
        left, right = (begin + np.flatnonzero(own == block) for block in (one, two))
        columns = np.ascontiguousarray(values["cells"][right].T)
        for at in range(0, len(left), COMPARED):
            block = left[at : at + COMPARED]
            cells = values["cells"][block]
            common = np.zeros((len(block), len(right)), np.int32)
            for k, column in enumerate(columns):
                common += np.minimum(cells[:, k, None], column[None, :])
            # Shingles that a full cell does not count may all be common ones.
            common += np.minimum(values["beyond"][block, None], values["beyond"][right]).astype(np.int32)
            least = SIMILARITY / (1 + SIMILARITY) * (values["size"][block, None] + values["size"][right])
            near = (common >= least - 1e-6) & (values["component"][block, None] != values["component"][right])
            if one == two:
                near &= block[:, None] < right
            i, j = np.nonzero(near)
            for low in range(0, len(i), LISTED_PAIRS):
                yield block[i[low : low + LISTED_PAIRS]], right[j[low : low + LISTED_PAIRS]]

    def near_pairs(values: dict[str, np.ndarray], edges: np.ndarray):
        begins, ends = edges[:-1], edges[1:]
        small = ends - begins <= LISTED
        if small.any():
            yield from listed_pairs(values, begins[small], ends[small])
        for begin, end in zip(begins[~small].tolist(), ends[~small].tolist(), strict=True):
            yield from crossed_pairs(values, begin, end)

    def taken(table: pa.Table, name: str, i: np.ndarray, j: np.ndarray) -> dict[int, object]:
        met = np.unique(np.concatenate([i, j]))
        return dict(zip(met.tolist(), table.column(name).take(pa.array(met)).to_pylist(), strict=True))

    def links_of(table: pa.Table, values: dict[str, np.ndarray], edges: np.ndarray):
        bucket = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        inside, parent = -1, {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = c = parent.get(up, up)
            return c

        for i, j in near_pairs(values, edges):
            keys = taken(table, "keys", i, j)
            keys = {k: set(own) for k, own in keys.items()}
            least = [min(keys[x] & keys[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
            first = np.array(least, np.int64) == values["key"][i]
            i, j = i[first], j[first]
            # As many pairs at a time as have not too many shingles to hold.
            size = np.cumsum(values["size"][i] + values["size"][j]) // HELD
            for at in np.split(np.arange(len(i)), np.flatnonzero(np.diff(size)) + 1):
                texts = taken(table, "text", i[at], j[at])
                held = shingles_of(texts.values())
                for x, y in zip(i[at].tolist(), j[at].tolist(), strict=True):
                    if bucket[x] != inside:
                        inside, parent = bucket[x], {}
                    c, d = root(int(values["component"][x])), root(int(values["component"][y]))
                    if c != d and jaccard(held[texts[x]], held[texts[y]]) >= SIMILARITY:
                        parent[max(c, d)] = min(c, d)
                        yield int(values["line"][x]), int(values["line"][y])

    def run(batches):
        for table in whole_groups(batches, "cell", GROUP_ROWS // 10):
            values = {
                c: table.column(c).to_numpy()
                for c in ("cell", "key", "line", "component", "size", "own", "one", "two")
            }
            values["cells"] = counts_in(table.column("cells"))
            values["beyond"] = values["size"] - values["cells"].sum(axis=1, dtype=np.int64)
            changes = np.zeros(len(table) - 1, bool)
            for name in ("cell", "key", "one", "two"):
                changes |= values[name][1:] != values[name][:-1]
            edges = np.flatnonzero(np.concatenate([[True], changes, [True]]))
            found = list(links_of(table, values, edges))
            if found:
                one, two = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"]
                )

    ordered = block_pairs(rows).repartition("cell").sortWithinPartitions("cell", "key", "one", "two")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def shingles_of(lines: Iterable[str]) -> dict[str, np.ndarray]:
    """Hashes of the different shingles of each line, ascending."""
    found = {}
    for part in hashed_together(list(dict.fromkeys(lines))):
        values, owner = different_shingles(part)
        ends = np.cumsum(np.bincount(owner, minlength=len(part)))
        found.update(zip(part, np.split(values, ends[:-1]), strict=True))
    return found


def similarity(one: str, two: str) -> float:
    """Jaccard similarity of the lines' shingles, 0 where their numbers already say so."""
    held = shingles_of([one, two])
    return jaccard(held[one], held[two])


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return 0.0
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(x) + len(y) - common)


def line_components(docs: DataFrame) -> DataFrame:
    """(line, component) of all lines that are linked to another one."""
    buckets = materialize(buckets_of(bands_of(docs)), "buckets")
    suspects = buckets.select("line").union(buckets.select("first")).distinct()
    texts = line_rows(docs).join(suspects, "line", "left_semi").groupBy("line").agg(F.min("text").alias("text"))
    texts = materialize(with_counts(texts), "lines")
    stars = buckets.select(F.col("first").alias("a"), F.col("line").alias("b")).distinct()
    links = materialize(alike(stars, texts), "star-links")
    # Lines known to be in one component: the smallest line within two links of each.
    nearest = links.groupBy("b").agg(F.min("a").alias("low")).withColumnRenamed("b", "a")
    known = links.join(nearest, "a", "left").groupBy("b").agg(F.min(F.coalesce("low", "a")).alias("known"))
    placed = buckets.join(known, buckets["line"] == known["b"], "left").select(
        "key", "line", F.coalesce("known", "line").alias("component")
    )
    # What a bucket has in several components, its first line, which all others have been
    # compared with, left out. Buckets of the same lines are one.
    open_keys = (
        placed.groupBy("key")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.ceil(F.count("*") / BUCKET_BLOCK).cast("int").alias("parts"),
            F.bit_xor(F.xxhash64("line")).alias("mark"),
            F.bit_xor(F.xxhash64("line", F.lit(1))).alias("mark2"),
        )
        .where("low < high")
        .groupBy("mark", "mark2", "parts")
        .agg(F.min("key").alias("key"))
        .select("key", "parts")
    )
    rest = (
        placed.join(open_keys, "key")
        .groupBy("line")
        .agg(
            F.min("component").alias("component"),
            F.collect_list("key").alias("keys"),
            F.collect_list(F.struct("key", "parts")).alias("places"),
        )
    )
    described = rest.join(texts, "line")
    more = crossing_links(described.select("*", F.inline("places")).drop("places"))
    whole = connected(texts.select(F.col("line").alias("v")), links.union(more), "lines")
    return whole.select(F.col("v").alias("line"), "component")


def lines_to_drop(docs: DataFrame) -> DataFrame:
    """(id, mark, lines array<int>): places of the lines of each row of ``docs`` that go."""
    kind = docs.schema["id"].dataType.simpleString()
    components = materialize(line_components(docs), "line-components")

    def run(batches):
        for batch in batches:
            owners, lines, places = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for place, line in enumerate(split_lines(text)):
                    if c := comparable(line):
                        owners.append(k)
                        lines.append(line_key(c))
                        places.append(place)
            rows = batch.select([0, 1]).take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(1),
                    pa.array(signed(np.array(lines, np.uint64))),
                    pa.array(places, pa.int32()),
                ],
                names=["id", "mark", "line", "place"],
            )

    every = docs.mapInArrow(run, f"id {kind}, mark bigint, line bigint, place int")
    every = materialize(
        every.join(components, "line", "left").select(
            "id", "mark", "place", F.coalesce("component", "line").alias("component")
        ),
        "placed-lines",
    )
    order: list[Column] = [F.col("id").isNull(), F.col("id"), F.col("mark"), F.col("place")]
    first = every.groupBy("component").agg(F.min(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select(
        "component", F.col("first.o1").alias("_id"), F.col("first.o2").alias("_mark"), F.col("first.o3").alias("_place")
    )
    gone = every.join(first, "component").where(
        ~(
            F.col("id").eqNullSafe(F.col("_id"))
            & (F.col("mark") == F.col("_mark"))
            & (F.col("place") == F.col("_place"))
        )
    )
    return gone.groupBy("id", "mark").agg(F.collect_set("place").alias("lines"))


def with_lines_to_drop(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All columns of ``docs``, and last the places of the lines that go."""
    bound_batches(docs.sparkSession)
    gone = materialize(lines_to_drop(keyed(docs, id_col, text_col)), "dropped-lines")
    gone = gone.toDF("_id", "_mark", "_lines")
    same = docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_mark"])
    return docs.join(gone, same, "left").select(docs["*"], gone["_lines"])


def without(text: str | None, lines: list[int] | None) -> str | None:
    if not lines:
        return text
    drop = set(lines)
    return "\n".join(x for k, x in enumerate(split_lines(text)) if k not in drop)


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, with the texts that are left."""
    names = docs.columns
    at, numbers = names.index(text_col), [f"c{k}" for k in range(len(names))]

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column(at).to_pylist(), batch.columns[-1].to_pylist(), strict=True)
            columns = batch.columns[:-1]
            columns[at] = pa.array([without(t, d) for t, d in pairs], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # The columns of the documents may bear any name, also those of the results.
    numbered = docs.toDF(*numbers)
    joined = with_lines_to_drop(numbered, numbers[names.index(id_col)], numbers[at])
    return joined.mapInArrow(run, docs.schema)


def without_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text, n_lines, n_removed) per row of ``docs``: the text without the lines that go."""
    rows = docs.select(id_col, text_col)
    joined = with_lines_to_drop(rows, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, sizes, removed = [], [], []
            for text, lines in zip(
                batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True
            ):
                texts.append(without(text, lines))
                sizes.append(len(split_lines(text)))
                removed.append(len(lines or ()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(texts, pa.string()),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                ],
                names=[id_col, "text", "n_lines", "n_removed"],
            )

    return joined.mapInArrow(
        run, f"`{id_col}` {kind}, text string, n_lines bigint, n_removed bigint"
    )
