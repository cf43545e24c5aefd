"""What the operators of this subpackage share: words, hashes, batches, components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offerlake.session import discard, materialize

#: Rows and bytes of one Arrow batch. Long texts make a batch end early, so a task holds a
#: few dozen MB of text whatever the lengths are.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20

#: The words of the contracts, over UTF-8 bytes. Bytes from 0x80 on all belong to words, so
#: the result is the same as over code points.
ALNUM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes; these settings can be changed at run time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(
    df: DataFrame,
    step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: str | StructType,
) -> DataFrame:
    """``step`` on each batch of ``df``, distributed as ``df`` is."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; a null text is an empty one.

    ``bytes.lower`` leaves everything but A-Z alone.
    """
    return b"" if text is None else text.encode().lower()


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which the order looks random."""
    x = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long, bit by bit."""
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def connected(vertices: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """Component of each vertex: (v, component), the smallest vertex reachable.

    ``vertices``: column v, distinct, not null. ``edges``: columns a, b, any order, repeats
    and loops allowed. Isolated vertices are their own component. Distributed union-find by
    alternating stars: each round hooks every vertex's larger neighbours, then all its
    neighbours, to the smallest one it knows, until no edge changes. Rounds grow with the
    logarithm of the longest path; each is written to the shared folder. A vertex with very
    many neighbours is reduced to its minimum by partial aggregates and meets its edges in
    a join that adaptive execution splits.
    """
    links = (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    links = materialize(links, f"{label}-links")
    before = None
    while True:
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = links.select(F.col("b").alias("u"), F.col("a").alias("n")).union(
            links.select(F.col("a").alias("u"), F.col("b").alias("n"))
        )
        lows = both.groupBy("u").agg(F.least(F.min("n"), F.col("u")).alias("m"))
        large = (
            both.where("n > u")
            .join(lows, "u")
            .select(F.col("m").alias("a"), F.col("n").alias("b"))
            .where("a <> b")
            .distinct()
        )
        # Small star: u and its smaller neighbours go to the smallest of them.
        small_lows = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(small_lows, "b")
            .select(F.col("m"), F.explode(F.array("a", "b")).alias("x"))
            .where("m <> x")
            .select(F.col("m").alias("a"), F.col("x").alias("b"))
            .distinct()
        )
        links, used = materialize(small, f"{label}-round"), links
        discard(used)
        now = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before or now[0] == 0:
            break
        before = now
    roots = links.groupBy("b").agg(F.min("a").alias("root"))
    return vertices.join(roots, vertices["v"] == roots["b"], "left").select(
        "v", F.coalesce("root", "v").alias("component")
    )
