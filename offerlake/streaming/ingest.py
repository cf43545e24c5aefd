"""Incremental runs: pages are saved as they arrive, the catalog follows.

Each micro-batch appends its accepted pages to the open run and nothing else, so its cost
is that of the batch, not of the catalog. An interrupted run keeps what was saved. Reading
or closing the run merges the saved pages into the parts of the snapshot they fall into, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offerlake.operators import extract, ledger, quality
from offerlake.operators.merge import RunStamp, apply_run
from offerlake.schemas import OUTCOMES, STREAMED
from offerlake.session import materialize
from offerlake.sources.snapshots import Snapshot, SnapshotStore, part_of


def save_pages(
    pages: DataFrame, store: SnapshotStore, run: RunStamp, checkpoint: str
) -> StreamingQuery:
    """Start saving a stream of ``seq, url, html`` to the open run of the store.

    A batch is there when its outcomes are, which are written last. One that is replayed after
    a failure is known by its number: if it is there it is left alone, if it broke half way it
    is written anew. So the checkpoint belongs to the run as its batches do.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        if store.has_batch(run.run_id, "outcomes", batch_id):
            return
        checked = quality.checked(extract.extract_products(batch)).persist()
        try:
            accepted = quality.accepted(checked).withColumn("row", F.monotonically_increasing_id())
            store.write_batch(accepted, run.run_id, "accepted", batch_id)
            store.write_batch(
                checked.select("seq", "url", "reasons"), run.run_id, "outcomes", batch_id
            )
        finally:
            checked.unpersist()

    return (
        pages.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _saved(store: SnapshotStore, run: RunStamp) -> DataFrame:
    """Accepted pages of the open run; later batches come after earlier ones.

    Pages that a batch gives the same number come in the order they were written in.
    """
    outcomes = _outcomes(store, run).select("batch").distinct()
    saved = store.read_batches(run.run_id, "accepted", STREAMED)
    # Pages of a batch that broke before its outcomes were written do not count yet.
    whole = saved.join(outcomes, "batch", "left_semi")
    return whole.withColumn("seq", F.struct("batch", "seq", "row")).drop("batch", "row")


def _outcomes(store: SnapshotStore, run: RunStamp) -> DataFrame:
    return store.read_batches(run.run_id, "outcomes", OUTCOMES)


def current_catalog(store: SnapshotStore, run: RunStamp) -> tuple[DataFrame, DataFrame]:
    """Snapshot with the pages saved so far merged in, at any time during the run."""
    basis = store.current()
    products, variants = store.read("products", basis), store.read("variants", basis)
    return apply_run(products, variants, _saved(store, run), run, complete=False)


def _touched(
    store: SnapshotStore, basis: Snapshot, saved: DataFrame, run: RunStamp, complete: bool
) -> set[int]:
    """Parts of the tables that closing the run changes; at most all of them are collected."""
    urls = saved.select("source_url")
    if complete:
        unseen = store.read("products", basis).where(run.unseen())
        urls = urls.unionByName(unseen.select("source_url"))
    part = part_of(F.col("source_url"), basis.parts)
    return {row["part"] for row in urls.select(part.alias("part")).distinct().collect()}


def close_run(
    store: SnapshotStore,
    run: RunStamp,
    opened: DataFrame,
    outcome: str | None = None,
    error: str | None = None,
) -> DataFrame:
    """Merge the run into a new snapshot and close its ledger row.

    What the run did not see is switched off only here, and only after a complete scan
    without failures that was not cut short. Closing again gives the same snapshot: the
    merge is an upsert under the run's own clock.
    """
    saved_flags = _outcomes(store, run).select(
        F.lit(run.run_id).alias("run_id"), (F.size("reasons") == 0).alias("saved")
    )
    closed = materialize(
        ledger.close_runs(
            opened,
            ledger.count_outcomes(saved_flags),
            run.time(),
            None if outcome is None else F.lit(outcome),
            None if error is None else F.lit(error),
        ),
        "ledger",
    )
    counts = ("full_scan", "products_found", "products_saved", "products_failed")
    row = closed.withColumn(
        "complete", ledger.complete_scan(*(F.col(c) for c in counts))
    ).first()
    complete = row["complete"] and outcome is None
    saved = _saved(store, run)

    def changes(basis: Snapshot) -> dict[str, DataFrame]:
        ledger_now = ledger.replace_run(store.read("runs", basis), closed)
        if not row["products_saved"]:
            return {"runs": ledger_now}
        parts = _touched(store, basis, saved, run, complete)
        products, variants = apply_run(
            store.read("products", basis, parts),
            store.read("variants", basis, parts),
            saved,
            run,
            complete,
        )
        return {"runs": ledger_now, "products": products, "variants": variants}

    store.update(changes)
    return closed
