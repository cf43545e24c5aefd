"""Substring dedup of words: windows of 13 words, gathered in runs under anchors.

Anchor runs replace the compaction of a de Bruijn graph: no node degrees are computed and no
paths joined, and repeats are decided by anchor and 64-bit hash, not read again in the text.

Windows are edges between their first and last 12 words. Consecutive windows that hold the
same smallest five-word hash are a run (see ``windows``): a path piece that is written down
once for all places with these words. A piece alone under its anchor does not branch and stays
compact; where an anchor has different pieces, the paths branch, and only these pieces are
taken apart into edges, which meet in a join. Every edge and piece knows the smallest id it
occurs in, and each document's own coordinates say which of its words they cover.

Most anchors occur in one document only. They are left out first: anchors and ids are dealt by
anchor, sorted and streamed. Anchors that several documents of one batch share are known at
once; all their rows but one are dealt by the id as well, so a passage in a third of all
documents does not meet in one task.

Defined results: a null or empty text has no words; a null id is smaller than none, so such
rows keep all words; rows that share an id are one document to others and each get what they
lose by their own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import SPACED_WORD, bound_batches, signed
from offerlake.llm.groups import whole_groups
from offerlake.llm.windows import anchored_runs, keyed, same_row
from offerlake.session import discard, materialize

WINDOW, PIECE_WORDS = 13, 5
GROUP_ROWS = 200_000


class Words:
    """Words of a text put together with single spaces, and where each begins and ends."""

    def __init__(self, text: str | None) -> None:
        self.words = SPACED_WORD.findall(text.encode()) if text else []
        self.joined = b" ".join(self.words)
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def runs(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.words) < window:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64)
        digest = xxhash.xxh3_64_intdigest
        symbols = np.fromiter(map(digest, self.words), np.uint64, len(self.words))
        starts, counts, anchors, _ = anchored_runs(symbols, window, min(PIECE_WORDS, window), False)
        return starts, counts, anchors

    def passage(self, first: int, count: int) -> bytes:
        return self.joined[self.starts[first] : self.ends[first + count - 1]]


def shared_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, id) of anchors that documents of different ids have."""
    kind = docs.schema["id"].dataType.simpleString()

    def emit(batches):
        for batch in batches:
            anchors, owners = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = np.unique(Words(text).runs(window)[2])
                anchors.append(own)
                owners.append(np.full(len(own), k))
            anchor, owner = np.concatenate(anchors), np.concatenate(owners)
            if not len(anchor):
                continue
            by = np.argsort(anchor, kind="stable")
            anchor, owner = anchor[by], owner[by]
            ids = batch.column(0).take(pa.array(owner))
            new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(anchor)), 0))
            other = ids.to_numpy(zero_copy_only=False) != ids.take(pa.array(first)).to_numpy(
                zero_copy_only=False
            )
            sure = np.logical_or.reduceat(other, np.flatnonzero(new))[np.cumsum(new) - 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(anchor)),
                    ids,
                    pa.array(sure.astype(np.int8) + (sure & ~new).astype(np.int8)),
                ],
                names=["anchor", "id", "sure"],
            )

    def meet(batches):
        for table in whole_groups(batches, "anchor", GROUP_ROWS):
            anchor = table.column("anchor").to_numpy()
            ids = table.column("id").combine_chunks()
            own = ids.to_numpy(zero_copy_only=False)
            sure = table.column("sure").to_numpy() > 0
            new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            several = np.logical_or.reduceat((own != own[starts][group]) | sure, starts)
            kept = np.flatnonzero(several[group])
            yield from table.select(["anchor", "id"]).take(pa.array(kept)).to_batches()

    rows = docs.where("id is not null").select("id", "text")
    found = rows.mapInArrow(emit, f"anchor bigint, id {kind}, sure tinyint")
    # 1: shared and dealt by the anchor, for other tasks' rows to see; 2: shared, dealt widely.
    dealt = found.repartition(
        F.when(F.col("sure") == 2, F.xxhash64("anchor", "id")).otherwise(F.col("anchor"))
    )
    return dealt.sortWithinPartitions("anchor").mapInArrow(meet, f"anchor bigint, id {kind}")


def pieces_of(docs: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """(id, mark, start, n, anchor, body): runs of the texts under their given anchors."""
    kind = docs.schema["id"].dataType.simpleString()
    wanted = anchors.groupBy(F.col("id").alias("_id")).agg(F.collect_set("anchor").alias("wanted"))
    joined = docs.join(wanted, docs["id"] == wanted["_id"]).select("id", "mark", "text", "wanted")

    def run(batches):
        for batch in batches:
            places, columns = [], []
            wanted = batch.column(3)
            for k, text in enumerate(batch.column(2).to_pylist()):
                words = Words(text)
                starts, counts, own = words.runs(window)
                use = np.isin(own, wanted[k].values.to_numpy().view(np.uint64))
                starts, counts, own = starts[use], counts[use], own[use]
                digest = xxhash.xxh3_64_intdigest
                bodies = [
                    digest(words.passage(a, n + window - 1))
                    for a, n in zip(starts.tolist(), counts.tolist(), strict=True)
                ]
                places.append(np.full(len(starts), k))
                columns.append((starts, counts, own, np.array(bodies, np.uint64)))
            starts, counts, own, bodies = map(np.concatenate, zip(*columns, strict=True))
            rows = batch.select([0, 1]).take(pa.array(np.concatenate(places)))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(1),
                    pa.array(starts.astype(np.int64)),
                    pa.array(counts.astype(np.int32)),
                    pa.array(signed(own)),
                    pa.array(signed(bodies)),
                ],
                names=["id", "mark", "start", "n", "anchor", "body"],
            )

    return joined.mapInArrow(
        run, f"id {kind}, mark bigint, start bigint, n int, anchor bigint, body bigint"
    )


def edges_of(docs: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """(anchor, body, at, edge, low): the windows of each given piece by their hashes."""
    kind = docs.schema["id"].dataType.simpleString()
    asked = pieces.groupBy("place_id", "place_mark").agg(
        F.collect_list(F.struct("anchor", "body", "n", "low", "start")).alias("asked")
    )
    joined = docs.join(
        asked, (docs["id"] == asked["place_id"]) & (docs["mark"] == asked["place_mark"])
    ).select("text", "asked")

    def run(batches):
        for batch in batches:
            asked = batch.column(1)
            anchors, bodies, places, edges, lows = [], [], [], [], []
            flat = asked.flatten()
            counts = asked.value_lengths().to_pylist()
            n, start = (flat.field(f).to_pylist() for f in ("n", "start"))
            source, at = [], 0
            for text, count in zip(batch.column(0).to_pylist(), counts, strict=True):
                words = Words(text)
                for k in range(at, at + count):
                    source += [k] * n[k]
                    places += range(n[k])
                    edges += [
                        xxhash.xxh3_64_intdigest(words.passage(i, window))
                        for i in range(start[k], start[k] + n[k])
                    ]
                at += count
            taken = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    flat.field("anchor").take(taken),
                    flat.field("body").take(taken),
                    pa.array(places, pa.int32()),
                    pa.array(signed(np.array(edges, np.uint64))),
                    flat.field("low").take(taken),
                ],
                names=["anchor", "body", "at", "edge", "low"],
            )

    return joined.mapInArrow(run, f"anchor bigint, body bigint, at int, edge bigint, low {kind}")


def seen_before(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, mark, windows array<struct<begin, end>>): windows of each row of ``docs`` (see
    ``keyed``) whose words also start in a document with a smaller id; ends exclusive."""
    anchors = materialize(shared_anchors(docs, window), "anchors")
    pieces = materialize(pieces_of(docs, anchors, window), "pieces")
    discard(anchors)
    nodes = materialize(
        pieces.groupBy("anchor", "body").agg(
            F.min("id").alias("low"),
            F.max("id").alias("high"),
            F.first("id").alias("place_id"),
            F.first("mark").alias("place_mark"),
            F.first("start").alias("start"),
            F.first("n").alias("n"),
        ),
        "nodes",
    )
    branching = nodes.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    edges = edges_of(docs, nodes.join(branching, "anchor"), window)
    edges = materialize(edges, "edges")
    # An edge is its words' hash and its anchor, which is made from the words in another way.
    known = edges.groupBy("anchor", "edge").agg(F.min("low").alias("least"))
    earlier = edges.join(known, ["anchor", "edge"]).where("least < low")
    split = earlier.groupBy("anchor", "body").agg(
        F.collect_list(
            F.struct(F.col("at").alias("begin"), (F.col("at") + 1).alias("end"), "least")
        ).alias("edges")
    )
    repeated = nodes.where("low < high").select("anchor", "body", "low")
    marks = split.join(repeated, ["anchor", "body"], "full")
    hits = pieces.join(marks, ["anchor", "body"]).select(
        "id",
        "mark",
        F.when(
            F.col("low") < F.col("id"),
            F.array(
                F.struct(
                    F.col("start").alias("begin"), (F.col("start") + F.col("n")).alias("end")
                )
            ),
        )
        .otherwise(
            F.transform(
                F.filter("edges", lambda e: e["least"] < F.col("id")),
                lambda e: F.struct(
                    (F.col("start") + e["begin"]).alias("begin"),
                    (F.col("start") + e["end"]).alias("end"),
                ),
            )
        )
        .alias("windows"),
    )
    found = hits.where(F.size("windows") > 0).groupBy("id", "mark")
    seen = materialize(found.agg(F.flatten(F.collect_list("windows")).alias("windows")), "seen")
    discard(pieces, nodes, edges)
    return seen


def without_seen(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """(id, n_words, kept, spans array<struct<start, end>>) per row: the words that are left,
    joined by single spaces, and the runs of words taken out, ends exclusive."""
    bound_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    marked = seen_before(rows, window)
    joined = rows.join(marked, same_row(rows, marked), "left").select(
        rows["id"], rows["text"], marked["windows"]
    )
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            sizes, kept, spans = [], [], []
            for text, windows in zip(
                batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True
            ):
                words = SPACED_WORD.findall(text.encode()) if text else []
                gone: list[tuple[int, int]] = []
                for a, b in sorted((w["begin"], w["end"] + window - 1) for w in windows or ()):
                    if gone and a <= gone[-1][1]:
                        gone[-1] = gone[-1][0], max(b, gone[-1][1])
                    else:
                        gone.append((a, b))
                at, parts = 0, []
                for a, b in gone:
                    parts += words[at:a]
                    at = b
                sizes.append(len(words))
                kept.append(b" ".join([*parts, *words[at:]]).decode())
                spans.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.array(spans, span),
                ],
                names=[id_col, "n_words", "kept", "spans"],
            )

    return joined.mapInArrow(
        run,
        f"`{id_col}` {kind}, n_words bigint, kept string, "
        "spans array<struct<start:bigint,end:bigint>>",
    )
