"""Exact repeats of bytes: run-compressed Burrows-Wheeler transforms of repetitive passages.

Windows of 400 bytes are gathered under anchors (see ``windows``). Runs that are equal as a
whole are one row with a count from the start, however many copies there are; runs that are
alone under their anchor hold nothing repeated. Only different runs of one anchor are indexed:
a task sorts the suffixes of some anchors' runs, keeps the transform as runs of equal bytes
with the text positions at their ends, and computes matches at these positions alone. The
matching statistics of all other positions stream from them, as each match is one byte shorter
than the one before it. Positions with a match of a whole window are repeated.

Under an anchor with very many different runs, the runs are dealt to cells. What is repeated
inside a cell is found by its index; one of each of its different windows is sent on, to meet
those of the anchor's other cells. Windows that begin at most ``STEP`` bytes apart travel
together under the hash of what they have in common, placed relative to the anchor, so that
equal windows have it in common whatever run they are in. Only where that is found more than
once are the windows themselves counted, by hashes of 128 bits.

Defined results: a null or empty text has no bytes; rows with equal id and text are places of
their own, so each repeats the other; texts shorter than a window repeat nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import bound_batches, mix, signed
from offerlake.llm.groups import whole_groups
from offerlake.llm.suffixes import suffix_ranks
from offerlake.llm.windows import anchored_runs, keyed, piece_hashes, same_row
from offerlake.session import materialize

WINDOW = 400
PIECE_BYTES = 32
#: Different runs of one anchor that are indexed together.
CELL_RUNS = 1000
#: Runs that a task indexes together, unless one cell has more.
INDEX_RUNS = 1500
#: Bytes between the first and the last window that travel together, and one more.
STEP = 16
#: No UTF-8 text has this byte.
BETWEEN = 0xFF


def runs_of(docs: DataFrame, window: int) -> DataFrame:
    """(id, mark, start, n, anchor, body, repeated): the runs of every text. ``body`` is a hash
    of the run's bytes."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            places, columns = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                raw = text.encode() if text else b""
                if len(raw) < window:
                    continue
                symbols = np.frombuffer(raw, np.uint8)
                starts, counts, anchors, repeated = anchored_runs(symbols, window, PIECE_BYTES)
                digest = xxhash.xxh3_64_intdigest
                ends = (starts + counts + window - 1).tolist()
                bodies = [digest(raw[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]
                places.append(np.full(len(starts), k))
                columns.append((starts, counts, anchors, np.array(bodies, np.uint64), repeated))
            if not places:
                continue
            starts, counts, anchors, bodies, repeated = map(
                np.concatenate, zip(*columns, strict=True)
            )
            rows = batch.select([0, 1]).take(pa.array(np.concatenate(places)))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(1),
                    pa.array(starts.astype(np.int64)),
                    pa.array(counts.astype(np.int32)),
                    pa.array(signed(anchors)),
                    pa.array(signed(bodies)),
                    pa.array(repeated),
                ],
                names=["id", "mark", "start", "n", "anchor", "body", "repeated"],
            )

    return docs.mapInArrow(
        run,
        f"id {kind}, mark bigint, start bigint, n int, anchor bigint, body bigint, repeated boolean",
    )


class RunIndex:
    """Run-compressed transform of passages, each followed by ``BETWEEN``."""

    def __init__(self, text: np.ndarray) -> None:
        self.text = text
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        self.words = np.zeros(n, np.uint64)
        for k in range(8):
            self.words = self.words << np.uint64(8) | padded[k : n + k].astype(np.uint64)
        order = np.empty(n, np.int64)
        order[suffix_ranks(self.words, compared=8)] = np.arange(n)
        # Nothing stands before the first position; its byte is unlike all others.
        last = np.where(order > 0, text[order - 1].astype(np.int16), -1)
        changes = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1], [True]]))
        #: Byte and length of each run, and the text positions where it begins and ends,
        #: each with the position of its neighbour outside the run.
        self.heads = last[changes[:-1]]
        self.lengths = np.diff(changes)
        self.starts, self.ends = order[changes[:-1]], order[changes[1:] - 1]
        self.before = np.concatenate([[-1], self.ends[:-1]])
        self.after = np.concatenate([self.starts[1:], [-1]])

    def _common(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at these positions."""
        n = len(self.text)
        length = np.zeros(len(one), np.int64)
        live = np.flatnonzero((one >= 0) & (two >= 0))
        while len(live):
            a, b = one[live] + length[live], two[live] + length[live]
            inside = np.maximum(a, b) < n
            live, a, b = live[inside], a[inside], b[inside]
            equal = self.words[a] == self.words[b]
            length[live[equal]] += 8
            rest = live[~equal]
            if len(rest):
                different = self.words[a[~equal]] ^ self.words[b[~equal]]
                for k in range(7):
                    length[rest] += (different >> np.uint64(8 * (7 - k))) == 0
            live = live[equal]
        return np.minimum(length, n - np.maximum(one, two))

    def _stream(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Values at all positions: at least what was before less one, and what is known."""
        known = np.zeros(len(self.text), np.int64)
        np.maximum.at(known, places, values + places)
        return np.maximum(np.maximum.accumulate(known) - np.arange(len(known)), 0)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position, how far it matches the next smaller suffix, and the next larger;
        the greater of both is its longest match anywhere else."""
        smaller = self._stream(self.starts, self._common(self.starts, self.before))
        larger = self._stream(self.ends, self._common(self.ends, self.after))
        return smaller, larger


def indexed(cells: DataFrame, window: int) -> DataFrame:
    """Rows of two kinds: repeated windows of a run as (anchor, body, n, begin, end), with c1
    and c2 null; and different windows of a cell that is not alone, with their own hashes
    w1, w2 and the hash c1, c2 of what they have in common."""
    step = min(STEP, window)

    def repeats_of(table: pa.Table) -> list[pa.Table]:
        passages = table.column("passage").to_pylist()
        joined = b"".join(p + bytes([BETWEEN]) for p in passages)
        text = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(p) + 1 for p in passages])
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(passages)), sizes)
        inside = np.arange(len(text)) - first[owner]
        usable = inside + window < sizes[owner]
        smaller, larger = RunIndex(text).matching_statistics()
        repeated = usable & (np.maximum(smaller, larger) >= window)
        # Runs of true values never cross passages: each ends in places that are not usable.
        edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated.view(np.int8), [0]])))
        begin, end = edges[::2], edges[1::2]
        names = table.select(["anchor", "body", "n"])
        found = [
            names.take(pa.array(owner[begin]))
            .append_column("begin", pa.array(inside[begin].astype(np.int32)))
            .append_column("end", pa.array((inside[begin] + end - begin).astype(np.int32)))
        ]
        # One of each different window: the smallest of the equal suffixes.
        parted = table.column("parts").to_numpy() > 1
        sent = np.flatnonzero(usable & (smaller < window) & parted[owner])
        if len(sent):
            anchors = table.column("anchor").to_numpy().view(np.uint64)
            pieces = piece_hashes(text, PIECE_BYTES)
            places = np.flatnonzero(pieces == anchors[owner[: len(pieces)]])
            place = places[np.searchsorted(places, sent)]
            core = place - (place - sent) // step * step
            new = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))
            other = mix(text.astype(np.uint64))
            c1, c2 = (piece_hashes(x, window - step + 1)[core[new]] for x in (text, other))
            w1, w2 = (piece_hashes(x, window)[sent] for x in (text, other))
            windows = pa.StructArray.from_arrays(
                [pa.array(inside[sent].astype(np.int32)), pa.array(signed(w1)), pa.array(signed(w2))],
                names=["begin", "w1", "w2"],
            )
            ends = pa.array(np.append(new, len(sent)).astype(np.int32))
            found.append(
                names.take(pa.array(owner[sent[new]]))
                .append_column("c1", pa.array(signed(c1)))
                .append_column("c2", pa.array(signed(c2)))
                .append_column("windows", pa.ListArray.from_arrays(ends, windows))
            )
        return found

    travelling = pa.list_(
        pa.struct([("begin", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])
    )
    types = {
        "anchor": pa.int64(), "body": pa.int64(), "n": pa.int32(), "begin": pa.int32(),
        "end": pa.int32(), "c1": pa.int64(), "c2": pa.int64(), "windows": travelling,
    }

    def run(batches):
        for table in whole_groups(batches, "cell", INDEX_RUNS):
            for found in repeats_of(table):
                columns = [
                    found.column(name).cast(kind)
                    if name in found.column_names
                    else pa.nulls(found.num_rows, kind)
                    for name, kind in types.items()
                ]
                yield from pa.table(columns, names=list(types)).combine_chunks().to_batches()

    schema = (
        "anchor bigint, body bigint, n int, begin int, end int, c1 bigint, c2 bigint, "
        "windows array<struct<begin:int,w1:bigint,w2:bigint>>"
    )
    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, mark, begins, ends): runs of repeated windows of each row of ``docs`` (see
    ``keyed``) that has any, as places of their first and one past their last window."""
    runs = materialize(runs_of(docs, window), "runs")
    bodies = materialize(
        runs.groupBy("anchor", "body", "n").agg(
            F.count("*").alias("times"),
            F.first("id").alias("place_id"),
            F.first("mark").alias("place_mark"),
            F.first("start").alias("start"),
            F.max("repeated").alias("repeated"),
        ),
        "bodies",
    )
    mixed = (
        bodies.groupBy("anchor")
        .agg(F.count("*").alias("bodies"), F.max("repeated").alias("repeated"))
        .where("bodies > 1 or repeated")
        .select("anchor", F.ceil(F.col("bodies") / CELL_RUNS).cast("int").alias("parts"))
    )
    asked = bodies.drop("repeated").join(mixed, "anchor")
    # One text per document goes to where its passages are cut out of it.
    requests = asked.groupBy(F.col("place_id").alias("id"), F.col("place_mark").alias("mark")).agg(
        F.collect_list(F.struct("anchor", "body", "n", "parts", "start")).alias("asked")
    )
    # Rows with equal id and text cut the same passages; these count as repeated anyway.
    cut = docs.join(requests, same_row(docs, requests)).select(
        F.explode(
            F.transform(
                "asked",
                lambda r: F.struct(
                    r["anchor"].alias("anchor"),
                    r["body"].alias("body"),
                    r["n"].alias("n"),
                    r["parts"].alias("parts"),
                    F.substring(
                        F.col("text").cast("binary"),
                        (r["start"] + 1).cast("int"),
                        r["n"] + (window - 1),
                    ).alias("passage"),
                ),
            )
        ).alias("r")
    )
    cells = cut.select("r.*").withColumn(
        "cell", F.xxhash64("anchor", F.pmod(F.col("body"), F.col("parts")))
    )
    found = materialize(indexed(cells, window), "indexed")
    sent = found.where("c1 is not null")
    cores = sent.groupBy("c1", "c2").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    open_windows = (
        sent.join(cores, ["c1", "c2"])
        .select("anchor", "body", "n", F.explode("windows").alias("w"))
        .select("anchor", "body", "n", "w.*")
    )
    met = open_windows.groupBy("w1", "w2").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    crossing = open_windows.join(met, ["w1", "w2"]).select(
        "anchor", "body", "n", "begin", (F.col("begin") + 1).alias("end")
    )
    whole = bodies.where("times > 1").select(
        "anchor", "body", "n", F.lit(0).alias("begin"), F.col("n").alias("end")
    )
    marked = (
        found.where("c1 is null")
        .select("anchor", "body", "n", "begin", "end")
        .union(crossing)
        .union(whole)
        .groupBy("anchor", "body", "n")
        .agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    )
    hits = runs.join(marked, ["anchor", "body", "n"])
    return hits.groupBy("id", "mark").agg(
        F.flatten(
            F.collect_list(
                F.transform(
                    "spans",
                    lambda s: F.struct(
                        (F.col("start") + s["begin"]).alias("begin"),
                        (F.col("start") + s["end"]).alias("end"),
                    ),
                )
            )
        ).alias("windows")
    )


def covered(size: int, windows: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover."""
    spans: list[tuple[int, int]] = []
    for begin, end in sorted((w["begin"], w["end"] + window - 1) for w in windows or ()):
        if spans and begin <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(end, spans[-1][1])
        else:
            spans.append((begin, end))
    return spans


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """(id, n_bytes, kept binary, spans array<struct<start, end>>) per row: the bytes that are
    left and the maximal runs of bytes taken out, ends exclusive."""
    bound_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    marked = materialize(repeated_windows(rows, window), "windows")
    known = marked.select(
        F.col("id").alias("_id"), F.col("mark").alias("_mark"), "windows"
    )
    joined = rows.join(
        known, rows["id"].eqNullSafe(known["_id"]) & (rows["mark"] == known["_mark"]), "left"
    ).select("id", "text", "windows")
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            sizes, kept, spans = [], [], []
            for text, windows in zip(
                batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True
            ):
                raw = text.encode() if text else b""
                gone = covered(len(raw), windows, window)
                at, parts = 0, []
                for a, b in gone:
                    parts.append(raw[at:a])
                    at = b
                sizes.append(len(raw))
                kept.append(b"".join([*parts, raw[at:]]))
                spans.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(kept, pa.binary()),
                    pa.array(spans, span),
                ],
                names=[id_col, "n_bytes", "kept", "spans"],
            )

    return joined.mapInArrow(
        run,
        f"`{id_col}` {kind}, n_bytes bigint, kept binary, "
        "spans array<struct<start:bigint,end:bigint>>",
    )
