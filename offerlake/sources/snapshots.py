"""Snapshots of the catalog tables in one folder.

Products and variants are kept in parts by a hash of their address, so a run writes the parts
its products fall into and no others. A folder is never changed once written: a version file
names the folder of every part, and a new version is a new file under the next number. A reader
sees all of a run or nothing of it. Of two writers that began with the same version, the second
to publish finds the number taken and is refused, so no update is lost.

Accepted pages of an open run are kept beside the tables, one folder per batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offerlake.schemas import PRODUCT_VARIANTS, PRODUCTS, SCRAPE_RUNS
from offerlake.sources import files

TABLES = {"products": PRODUCTS, "variants": PRODUCT_VARIANTS, "runs": SCRAPE_RUNS}
#: Tables in parts; the ledger has one row a run and is a single part.
PARTED = ("products", "variants")
#: Parts of a new store. A store keeps the number it began with.
PARTS = 64
#: Publications tried again after another writer was first.
ATTEMPTS = 50
_WORD = 64


class StaleSnapshot(RuntimeError):
    """Somebody else has published since the snapshot was read."""


@dataclass(frozen=True)
class Snapshot:
    """A version and the folder of every part of every table in it."""

    version: int = 0
    parts: int = PARTS
    folders: dict[str, dict[str, str]] = field(default_factory=dict)


def part_of(url: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(parts)).cast("int")


def part_marks(url: Column, parts: int) -> dict[str, Column]:
    """Aggregates that mark the parts of all addresses, a bit each; null addresses have none."""
    part = part_of(url, parts)
    marks = {}
    for word in range((parts + _WORD - 1) // _WORD):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), part - word * _WORD)
        inside = url.isNotNull() & (part >= word * _WORD) & (part < (word + 1) * _WORD)
        marks[f"parts_{word}"] = F.bit_or(F.when(inside, bit).otherwise(F.lit(0).cast("long")))
    return marks


def marked_parts(measured: dict[str, int | None]) -> set[int]:
    """The parts that :func:`part_marks` has found."""
    found = set()
    for name, bits in measured.items():
        if name.startswith("parts_") and bits:
            first = int(name.removeprefix("parts_")) * _WORD
            found |= {first + k for k in range(_WORD) if bits >> k & 1}
    return found


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.parts = parts

    def _version_file(self, version: int) -> str:
        return f"{self.root}/versions/{version:010d}.json"

    def current(self) -> Snapshot:
        """The last version; that of a new store has no folders."""
        names = [n for n in files.listed(self.spark, f"{self.root}/versions") if n.endswith(".json")]
        if not names:
            return Snapshot(parts=self.parts)
        last = max(names)
        read = json.loads(files.read_text(self.spark, f"{self.root}/versions/{last}"))
        return Snapshot(int(last.removesuffix(".json")), read["parts"], read["folders"])

    def read(
        self, table: str, snapshot: Snapshot | None = None, parts: Iterable[int] | None = None
    ) -> DataFrame:
        """A table, or the given parts of it, as of a snapshot."""
        folders = (snapshot or self.current()).folders.get(table, {})
        wanted = folders if parts is None else [str(p) for p in parts if str(p) in folders]
        paths = [f"{self.root}/{folders[p]}" for p in wanted]
        if not paths:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*paths)

    def publish(self, basis: Snapshot, **tables: DataFrame) -> Snapshot:
        """Make the given rows the current ones, on top of the snapshot they were made from.

        A parted table gets new folders for the parts that have rows; its other parts stay as
        they are. Raises :class:`StaleSnapshot`, and leaves everything as it was, if there is
        a later version than ``basis``.
        """
        name = f"snapshot-{uuid.uuid4().hex}"
        folders = {table: dict(parts) for table, parts in basis.folders.items()}
        for table, rows in tables.items():
            path, rows = f"{name}/{table}", rows.select(*TABLES[table].names)
            if table in PARTED:
                placed = rows.withColumn("part", part_of(F.col("source_url"), basis.parts))
                # Spark splits parts that are too large for a task and joins small ones.
                placed.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.root}/{path}")
                written = files.listed(self.spark, f"{self.root}/{path}")
                fresh = {n.removeprefix("part="): f"{path}/{n}" for n in written if n.startswith("part=")}
                folders[table] = {**folders.get(table, {}), **fresh}
            else:
                rows.coalesce(1).write.parquet(f"{self.root}/{path}")
                folders[table] = {"all": path}
        made = Snapshot(basis.version + 1, basis.parts, folders)
        text = json.dumps({"parts": made.parts, "folders": folders})
        fresh_file = f"{self.root}/versions/.{name}"
        files.write_text(self.spark, fresh_file, text)
        if not files.rename(self.spark, fresh_file, self._version_file(made.version)):
            files.remove(self.spark, fresh_file)
            files.remove(self.spark, f"{self.root}/{name}")
            raise StaleSnapshot(f"version {made.version} is there already")
        return made

    def update(self, build: Callable[[Snapshot], dict[str, DataFrame]]) -> Snapshot:
        """Publish what ``build`` makes of the current snapshot, anew if another writer is first."""
        for _ in range(ATTEMPTS):
            basis = self.current()
            try:
                return self.publish(basis, **build(basis))
            except StaleSnapshot:
                continue
        raise StaleSnapshot(f"{ATTEMPTS} attempts to publish were overtaken")

    def clean(self, before: datetime) -> None:
        """Delete versions last changed before a time, and folders that no version left names.

        The current version stays. Folders younger than the time stay as well: they may belong
        to a version that is about to be published.
        """
        limit = before.timestamp() * 1000
        times = files.listed(self.spark, f"{self.root}/versions")
        last = self.current()
        for name, changed in times.items():
            if name.endswith(".json") and changed < limit and int(name.removesuffix(".json")) < last.version:
                files.remove(self.spark, f"{self.root}/versions/{name}")
        named = set()
        for name in files.listed(self.spark, f"{self.root}/versions"):
            if name.endswith(".json"):
                read = json.loads(files.read_text(self.spark, f"{self.root}/versions/{name}"))
                named |= {path for parts in read["folders"].values() for path in parts.values()}
        for snapshot, changed in files.listed(self.spark, self.root).items():
            if not snapshot.startswith("snapshot-") or changed >= limit:
                continue
            kept = {path for path in named if path.startswith(f"{snapshot}/")}
            if not kept:
                files.remove(self.spark, f"{self.root}/{snapshot}")
                continue
            for table in files.listed(self.spark, f"{self.root}/{snapshot}"):
                for part in files.listed(self.spark, f"{self.root}/{snapshot}/{table}"):
                    path = f"{snapshot}/{table}/{part}"
                    if part.startswith("part=") and path not in kept:
                        files.remove(self.spark, f"{self.root}/{path}")

    # Open runs

    def run_path(self, run_id: str) -> str:
        return f"{self.root}/open/{quote(run_id, safe='')}"

    def close(self, run_id: str) -> None:
        """Delete what was kept of an open run."""
        files.remove(self.spark, self.run_path(run_id))

    def batch_path(self, run_id: str, kind: str, batch: int) -> str:
        return f"{self.run_path(run_id)}/{kind}/batch={batch:010d}"

    def has_batch(self, run_id: str, kind: str, batch: int) -> bool:
        return files.exists(self.spark, f"{self.batch_path(run_id, kind, batch)}/_SUCCESS")

    def write_batch(self, rows: DataFrame, run_id: str, kind: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(self.batch_path(run_id, kind, batch))

    def read_batches(self, run_id: str, kind: str, schema: StructType) -> DataFrame:
        """All finished batches of an open run with their number as ``batch``."""
        names = files.listed(self.spark, f"{self.run_path(run_id)}/{kind}")
        numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
        paths = [self.batch_path(run_id, kind, n) for n in numbers if self.has_batch(run_id, kind, n)]
        whole = StructType([*schema.fields]).add("batch", "long")
        if not paths:
            return self.spark.createDataFrame([], whole)
        base = f"{self.run_path(run_id)}/{kind}"
        return self.spark.read.option("basePath", base).schema(whole).parquet(*paths)
