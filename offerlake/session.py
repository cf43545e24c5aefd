"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from offerlake.sources import files

# SQL settings every plan in this package relies on. They can be changed at run time,
# so they are applied to a session somebody else has built as well.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages meet their product where their variants are then keyed. An address with very many
    # pages is still split there, at the cost of one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Pages grow a hundredfold while they are extracted. Tasks are cut by what they read of a
    # shuffle, so that what one holds is the same for any input; batches by rows and bytes.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # A line of a table also grows as it is read, and what a task shuffles must fit its memory.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
# Parts a shuffle is written in at least, before adaptive execution puts small ones together.
# Beyond 2,000 Spark keeps no exact sizes of them.
INITIAL_PARTS = 1536

_local_dirs: dict[str, str] = {}
# Where the tables of ``materialize`` lie.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
# Folders of the tables written inside ``scratch``.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    parts = max(INITIAL_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("offerlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may do without the setting; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="offerlake-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/offerlake/{app}/{label}-{uuid.uuid4().hex}"


@contextmanager
def joins_in_place(spark: SparkSession) -> Iterator[None]:
    """Inside it, joins leave a table where it lies if it is dealt by a part of their key.

    Spark would otherwise shuffle both sides by the whole key. Only for plans whose part of the
    key spreads the rows as well: tables written inside, not plans that run later.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all tables that ``materialize`` has written inside it."""
    written: list[str] = []
    outer = _written.set(written)
    try:
        yield
    finally:
        _written.reset(outer)
        for folder in written:
            files.remove(spark, folder)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives the loss of any executor, and gives the
    following plan exact sizes to choose its joins by.
    """
    path = scratch_path(df.sparkSession, label)
    written = _written.get()
    if written is not None:
        written.append(path)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``materialize`` that nothing reads any more."""
    for table in tables:
        files.remove(table.sparkSession, _folders.pop(table))
