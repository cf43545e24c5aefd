"""A whole run: walk, extract, check, export, merge, close the ledger.

A run goes in steps, and each step is a table in the run's own folder: the addresses of the
walk, and the checked products in ``stages`` slices of the walk. The ledger says how many
products were found before the first of them is read. A run that breaks keeps the slices it has
finished: they are merged and exported, and started again under its id it goes on from there and
extracts no page twice. The tables change in one publication at the end.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import suppress
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from offerlake.functions import scalars
from offerlake.operators import extract, ledger, links, quality
from offerlake.operators.crawl import crawl
from offerlake.operators.merge import RunStamp, apply_run
from offerlake.schemas import STORAGE_MODES
from offerlake.session import configure, materialize, scratch, scratch_path
from offerlake.sources import files
from offerlake.sources.export import write_products
from offerlake.sources.snapshots import Snapshot, SnapshotStore, marked_parts, part_marks, part_of

ADDRESSES = "seq long, url string"


@dataclass(frozen=True)
class RunOptions:
    """A run over one catalog. Zero means no cap on products or pages.

    ``stages`` is the number of slices of the walk that are extracted one after the other and
    kept if the run breaks.
    """

    run_id: str
    source: str
    category: str
    catalog_url: str
    started_at: datetime
    storage: str = "json"
    limit: int = 10
    max_pages: int = 0
    stages: int = 1

    def __post_init__(self) -> None:
        if self.storage not in STORAGE_MODES:
            raise ValueError(f"storage must be one of {STORAGE_MODES}")
        if self.limit < 0 or self.max_pages < 0:
            raise ValueError("limit and max_pages must not be negative")
        if self.stages < 1:
            raise ValueError("a run has one stage at least")

    @property
    def full_scan(self) -> bool:
        return self.limit == 0 and self.max_pages == 0

    @property
    def to_tables(self) -> bool:
        return self.storage in ("tables", "both")

    @property
    def to_json(self) -> bool:
        return self.storage in ("json", "both")

    @property
    def stamp(self) -> RunStamp:
        return RunStamp(self.run_id, self.source, self.category, self.started_at)


def product_urls(pages: DataFrame, options: RunOptions) -> DataFrame:
    """``seq, url`` of the products the walk from the catalog address finds."""
    # Written as it is read, so that the filter does not evaluate it a second time.
    listing = materialize(links.listing_pages(pages), "listing").where(
        (F.size("links") > 0) | F.col("next").isNotNull() | (F.col("url") == options.catalog_url)
    )
    chain = listing.select(F.lit(0).alias("catalog"), F.col("url").alias("page"), "next", "links")
    start = pages.sparkSession.createDataFrame(
        [(0, options.catalog_url)], "catalog int, page string"
    )
    return crawl(chain, start, options.max_pages, options.limit).select("seq", "url")


def fetched_products(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Extracted products of the walk; an address without a page counts as not found.

    Only pages of the walk are extracted. The addresses have been written, so their size is
    known at run time: they go to the pages if they are few, and are matched by a shuffle,
    with a filter built from them in front of it, if they are many.
    """
    fetched = pages.select("url", "html")
    hits = extract.extract_products(fetched.join(urls, "url"))
    absent = urls.join(fetched.select("url"), "url", "left_anti")
    return hits.unionByName(
        absent.withColumn("found", F.lit(False)), allowMissingColumns=True
    )


class _Run:
    """What a run has found so far, in its folder and in numbers."""

    def __init__(self, pages: DataFrame, options: RunOptions, store: SnapshotStore | None) -> None:
        self.pages, self.options, self.store = pages, options, store
        self.spark = pages.sparkSession
        if store is not None and options.to_tables:
            self.folder = store.run_path(options.run_id)
            self.parts = store.current().parts
        else:
            self.folder, self.parts = scratch_path(self.spark, "run"), 1
        self.found = 0
        self.slices: list[DataFrame] = []
        self.measured: list[dict[str, int]] = []

    def _done(self, path: str) -> bool:
        return files.exists(self.spark, f"{path}/_SUCCESS")

    def begin(self) -> None:
        """Take up the folder of an earlier attempt, if it was one with the same options."""
        path, given = f"{self.folder}/options.json", asdict(self.options)
        given["started_at"] = self.options.started_at.isoformat()
        if files.exists(self.spark, path):
            if json.loads(files.read_text(self.spark, path)) != given:
                raise ValueError(f"run {self.options.run_id} was begun with other options")
        else:
            files.write_text(self.spark, path, json.dumps(given))

    def walk(self) -> None:
        path = f"{self.folder}/addresses"
        if not self._done(path):
            with scratch(self.spark):
                product_urls(self.pages, self.options).write.mode("overwrite").parquet(path)
        self.urls = self.spark.read.schema(ADDRESSES).parquet(path)
        self.found = self.urls.count()

    def passes(self):
        """With tables, what they refuse is not exported either; without, no constraint applies."""
        return F.size("reasons") == 0 if self.options.to_tables else F.col("found")

    def check(self) -> None:
        """Extract and check the slices of the walk that no earlier attempt has finished.

        Their numbers are observed while they are written. Those of a slice that is there
        already are read from two of its columns.
        """
        saved = F.coalesce(self.passes(), F.lit(False))
        link = F.when(saved, scalars.strip(F.col("product.link")))
        measures = [
            F.count(F.lit(1)).alias("found"),
            F.count_if(saved).alias("saved"),
            *(mark.alias(name) for name, mark in part_marks(link, self.parts).items()),
        ]
        stage = F.expr(f"(seq - 1) * {self.options.stages} div {max(1, self.found)}")
        for number in range(self.options.stages):
            path = f"{self.folder}/checked/stage={number}"
            rows = quality.checked(fetched_products(self.pages, self.urls.where(stage == number)))
            if self._done(path):
                table = self.spark.read.schema(rows.schema).parquet(path)
                measured = table.agg(*measures).first().asDict()
            else:
                seen = Observation()
                rows.observe(seen, *measures).write.mode("overwrite").parquet(path)
                table, measured = self.spark.read.schema(rows.schema).parquet(path), seen.get
            self.slices.append(table)
            self.measured.append(measured)

    @property
    def checked(self) -> DataFrame | None:
        """Checked products of the finished slices."""
        return reduce(DataFrame.unionByName, self.slices) if self.slices else None

    def total(self, name: str) -> int:
        return sum(m[name] or 0 for m in self.measured)

    @property
    def touched(self) -> set[int]:
        return set().union(*map(marked_parts, self.measured))

    def export(self, path: str) -> None:
        """A run that saved nothing leaves an older export as it is."""
        if self.total("saved"):
            write_products(self.checked.where(self.passes()).select("seq", "product"), path)

    def merged(self, basis: Snapshot, complete: bool) -> dict[str, DataFrame]:
        """The parts of the tables that the run changes, on top of a snapshot.

        These are the parts of its products. A complete scan also changes those of all
        products of its scope that it did not see.
        """
        if not self.total("saved"):
            return {}
        store, run, touched = self.store, self.options.stamp, self.touched
        if complete:
            unseen = store.read("products", basis).where(run.unseen())
            rows = unseen.select(part_of(F.col("source_url"), basis.parts).alias("part")).distinct()
            # At most one row per part.
            touched = touched | {r["part"] for r in rows.collect()}
        products, variants = apply_run(
            store.read("products", basis, touched),
            store.read("variants", basis, touched),
            quality.accepted(self.checked),
            run,
            complete,
        )
        return {"products": products, "variants": variants}

    def end(self) -> None:
        files.remove(self.spark, self.folder)


def run_catalog(
    pages: DataFrame,
    options: RunOptions,
    store: SnapshotStore | None,
    export_path: str | None,
    clock: Callable[[], datetime] = lambda: datetime.now(UTC),
) -> DataFrame:
    """Run over fetched ``pages`` (``url, html``, one row per url); gives the ledger row.

    Pages are parsed once; the result is written to the run's folder and feeds both the
    tables and the export. With tables, a product they refuse is not exported either.
    Without tables no constraint applies and repeated addresses stay.

    An export that fails does not stop the run: its products count as failed, the run is
    partial, and what the tables have saved stays saved. ``clock`` gives the time of the end.
    """
    spark = configure(pages.sparkSession)
    if options.to_tables and store is None or options.to_json and export_path is None:
        raise ValueError(f"storage {options.storage} lacks its target")
    opened = ledger.open_run(
        spark,
        run_id=options.run_id,
        source=options.source,
        category=options.category,
        catalog_url=options.catalog_url,
        storage_mode=options.storage,
        is_full_scan=options.full_scan,
        started_at=options.started_at,
    )
    run = _Run(pages, options, store)
    run.begin()
    if options.to_tables:
        _record(store, opened)
    try:
        run.walk()
        if options.to_tables:
            _record(store, ledger.with_found(opened, run.found))
        run.check()
        return _finish(run, opened, export_path, clock)
    except BaseException as error:
        with suppress(Exception):
            _close_broken(run, opened, export_path, clock, error)
        raise


def _record(store: SnapshotStore, row: DataFrame) -> None:
    store.update(lambda basis: {"runs": ledger.replace_run(store.read("runs", basis), row)})


def _closed(run: _Run, opened: DataFrame, at: datetime, saved: int, **ends) -> DataFrame:
    counts = run.spark.createDataFrame(
        [(run.options.run_id, run.found, saved, run.total("found") - saved)],
        "run_id string, products_found long, products_saved long, products_failed long",
    )
    return ledger.close_runs(opened, counts, F.lit(at), **{k: F.lit(v) for k, v in ends.items()})


def _publish(run: _Run, closed: DataFrame, complete: bool) -> None:
    store = run.store
    store.update(
        lambda basis: {
            "runs": ledger.replace_run(store.read("runs", basis), closed),
            **run.merged(basis, complete),
        }
    )


def _finish(
    run: _Run, opened: DataFrame, export_path: str | None, clock: Callable[[], datetime]
) -> DataFrame:
    options, saved, ends = run.options, run.total("saved"), {}
    if options.to_json:
        try:
            run.export(export_path)
        except Exception as error:  # noqa: BLE001 - whatever it is, the run goes on without
            saved, ends = 0, {"error": f"the export failed: {error}"[:2000]}
    closed = _closed(run, opened, clock(), saved, **ends)
    if options.to_tables:
        counts = (run.found, saved, run.total("found") - saved)
        row = run.spark.range(1).select(
            ledger.complete_scan(F.lit(options.full_scan), *map(F.lit, counts)).alias("complete")
        )
        _publish(run, closed, row.first()["complete"])
    result = run.spark.createDataFrame(closed.collect(), closed.schema)
    run.end()
    return result


def _close_broken(
    run: _Run,
    opened: DataFrame,
    export_path: str | None,
    clock: Callable[[], datetime],
    error: BaseException,
) -> None:
    """Close the ledger row of a run that did not come to its end, and keep what it has.

    Its folder stays, so that it can be started again.
    """
    cancelled = isinstance(error, KeyboardInterrupt)
    ends = {"outcome": "cancelled"} if cancelled else {"outcome": "failed", "error": str(error)}
    if run.options.to_json and run.slices:
        with suppress(Exception):
            run.export(export_path)
    if not run.options.to_tables:
        return
    try:
        _publish(run, _closed(run, opened, clock(), run.total("saved"), **ends), False)
    except Exception:  # noqa: BLE001 - then at least the ledger tells that the run is over
        run.slices, run.measured = [], []
        _publish(run, _closed(run, opened, clock(), 0, **ends), False)
