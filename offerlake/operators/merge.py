"""Merging a run into the product and variant tables.

Inside a run the last page wins. Products are keyed by ``source_url``, variants by
``(source_url, source_key)``. Both tables are matched on unique keys, so no match can be
skewed; joins on ``source_url`` alone, from pages or variants to their products, have a
unique right side and are left to adaptive skew handling.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from offerlake.functions.rows import explode_items, look_up
from offerlake.schemas import PRODUCT_VARIANTS, PRODUCTS
from offerlake.session import materialize

# Columns a later page or run replaces.
PRODUCT_VALUES = (
    "name",
    "brand",
    "description",
    "price",
    "currency",
    "available",
    "characteristics",
    "image_url",
    "content_hash",
)
VARIANT_VALUES = ("sku", "name", "price", "currency", "available")


@dataclass(frozen=True)
class RunStamp:
    """What a merge has to know of its run: one id, one scope, one clock."""

    run_id: str
    source: str
    category: str
    at: datetime

    def time(self) -> Column:
        return F.lit(self.at).cast("timestamp")

    def in_scope(self) -> Column:
        return (F.col("source") == self.source) & (F.col("category") == self.category)

    def unseen(self) -> Column:
        """Products of the scope this run did not see; never seen counts as unseen."""
        return self.in_scope() & ~F.col("last_seen_run_id").eqNullSafe(F.lit(self.run_id))


def latest_per_key(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key; ``order`` differs between the rows of a key, none is null.

    Two phases, so that wide rows are not sorted to be aggregated. The last order of each key is
    found on the key and the order alone, in hash tables where the order is a number, each task
    reducing its own rows first. Then it is joined back to the rows: they are dealt by key and
    order, so a key that holds a third of the table is spread like any other.
    """
    ordered = rows.withColumn("_order", order)
    last = ordered.groupBy(*key).agg(F.max("_order").alias("_order"))
    return ordered.join(last, [*key, "_order"]).drop("_order")


def _last_rows(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The rows of the last order of each key, all of them where several share it.

    Spark keeps the last rows of a key in every task before it shuffles, so a key with most of
    the rows sends a few from each. Rows that lie together by their key are not shuffled.
    """
    by_key = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    ranked = rows.withColumn("_rank", F.rank().over(by_key))
    return ranked.where("_rank = 1").drop("_rank")


def latest_products(accepted: DataFrame) -> DataFrame:
    """One row per product of the run, ``seq`` telling which page it came from."""
    placed = accepted.drop("variants").where(F.col("source_url").isNotNull() & F.col("seq").isNotNull())
    return _last_rows(placed, ["source_url"], "seq")


def latest_variants(accepted: DataFrame) -> DataFrame:
    """Variants of all pages of the run, values from the last place they were listed.

    The pages first meet their products. That deals them by address while their variants are
    still in one row; the keys of an address stay with it and need no shuffle of their own, here
    and in the joins by key that follow. Adaptive execution splits an address with very many pages.
    """
    pages = accepted.select("source_url", "seq", "variants").join(touched_products(accepted), "source_url")
    # True of every page that has a place. The products are needed as a merge needs them, so that
    # Spark makes their shuffle once.
    placed_pages = pages.where(F.col("seq") <= F.col("last_seq"))
    rows = explode_items(placed_pages, "variants", "v", "source_url", "seq")
    flat = rows.select("source_url", "v.source_key", "seq", "pos", *(f"v.{c}" for c in VARIANT_VALUES))
    placed = flat.where(F.col("source_key").isNotNull())
    return _last_rows(placed, ["source_url", "source_key"], "seq", "pos").drop("pos")


def _pick(present: Column, incoming: str, stored: str, names: tuple[str, ...]) -> list[Column]:
    """Whole sides are chosen by presence, so an incoming null replaces a stored value."""
    return [
        F.when(present, F.col(f"{incoming}.{n}")).otherwise(F.col(f"{stored}.{n}")).alias(n)
        for n in names
    ]


def merge_products(stored: DataFrame, incoming: DataFrame, run: RunStamp) -> DataFrame:
    """Insert or replace products; incoming keys must be unique.

    Source and category stay as inserted. The two "seen" stamps move on every upsert,
    whether the content changed or not.
    """
    new = incoming.select("source_url", F.struct(*PRODUCT_VALUES).alias("new"))
    old = stored.select(
        "source_url", F.struct(*(c for c in stored.columns if c != "source_url")).alias("old")
    )
    joined = old.join(new, "source_url", "full_outer")
    is_new, now = F.col("new").isNotNull(), run.time()
    inserted = {
        "source": F.lit(run.source),
        "category": F.lit(run.category),
        "first_seen_at": now,
        "created_at": now,
    }
    touched = {"last_seen_run_id": F.lit(run.run_id), "last_seen_at": now, "updated_at": now}
    return joined.select(
        "source_url",
        *_pick(is_new, "new", "old", PRODUCT_VALUES),
        *(F.coalesce(F.col(f"old.{n}"), first).alias(n) for n, first in inserted.items()),
        *(F.when(is_new, value).otherwise(F.col(f"old.{n}")).alias(n) for n, value in touched.items()),
    ).select(*PRODUCTS.names)


def by_address(pages: DataFrame) -> GroupedData:
    """Pages of a product, grouped by its address and a hash of it, ``_hash``.

    The hash sorts fast, where addresses differ at their ends only. And what is made of a group is
    dealt by address anew before it meets the pages: adaptive execution splits an address with very
    many pages only where both sides of a join come from a shuffle of its own.
    """
    return pages.groupBy(F.xxhash64("source_url").alias("_hash"), "source_url")


def touched_products(accepted: DataFrame) -> DataFrame:
    """Products of the run with the order of their last page: ``source_url, last_seq``."""
    return by_address(accepted).agg(F.max("seq").alias("last_seq")).drop("_hash")


def merge_variants(
    stored: DataFrame,
    incoming: DataFrame,
    touched: DataFrame,
    run: RunStamp,
    unseen: DataFrame | None = None,
) -> DataFrame:
    """Insert or replace variants and switch off those their product no longer lists.

    ``touched`` is ``source_url, last_seq`` of the products of the run. A variant is on
    offer only if the last page of its product lists it; one from an earlier page of the
    same run is kept but is not available. ``unseen`` holds the ``source_url`` of products
    a complete scan did not see; their variants are switched off in the same pass.
    """
    key = ["source_url", "source_key"]
    new = incoming.select(*key, F.struct("seq", *VARIANT_VALUES).alias("new"))
    old = stored.select(*key, F.struct(*VARIANT_VALUES, "created_at", "updated_at").alias("old"))
    state = touched.select("source_url", "last_seq", F.lit(False).alias("stale"))
    if unseen is not None:
        gone = unseen.select("source_url").join(state, "source_url", "left_anti")
        state = state.unionByName(
            gone.withColumn("stale", F.lit(True)), allowMissingColumns=True
        )
    # Each side meets the state on its own, which deals both by address; where joins may keep
    # that (``session.joins_in_place``), none of the two is shuffled again to pair their keys.
    old, new = (
        side.join(state.select("source_url", F.struct("last_seq", "stale").alias(name)), "source_url", "left")
        for side, name in ((old, "old_state"), (new, "new_state"))
    )
    joined = old.join(new, key, "full_outer").withColumn("state", F.coalesce("old_state", "new_state"))
    is_new, now = F.col("new").isNotNull(), run.time()
    last_seq = F.col("state.last_seq")
    is_touched, stale = last_seq.isNotNull(), F.coalesce("state.stale", F.lit(False))
    on_last_page = is_new & (F.col("new.seq") == last_seq)
    merged = joined.select(
        *key,
        *_pick(is_new, "new", "old", VARIANT_VALUES),
        F.coalesce("old.created_at", now).alias("created_at"),
        F.when(is_touched | stale, now).otherwise(F.col("old.updated_at")).alias("updated_at"),
        ((~is_touched | on_last_page) & ~stale).alias("listed"),
    )
    return merged.withColumn("available", F.col("available") & F.col("listed")).select(
        *PRODUCT_VARIANTS.names
    )


def missing_variants(stored: DataFrame, incoming: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored variants of products of the run that the run did not list."""
    of_run = stored.join(touched.select("source_url"), "source_url", "left_semi")
    key = ["source_url", "source_key"]
    return of_run.join(incoming.select(*key), key, "left_anti")


def _switch_off(table: DataFrame, stale: Column, run: RunStamp) -> DataFrame:
    return table.withColumn("available", F.col("available") & ~stale).withColumn(
        "updated_at", F.when(stale, run.time()).otherwise(F.col("updated_at"))
    )


def deactivate_products(products: DataFrame, run: RunStamp) -> DataFrame:
    """Products of the scope that the run did not see become unavailable."""
    return _switch_off(products, run.unseen(), run)


def deactivate_variants(variants: DataFrame, products: DataFrame, run: RunStamp) -> DataFrame:
    """Variants of the products the run did not see become unavailable.

    Those products are written out first: Spark then knows how many they are, and where they are
    few need not shuffle the variants of all others.
    """
    unseen = materialize(products.where(run.unseen()).select("source_url", F.lit(True).alias("unseen")), "unseen")
    joined = variants.join(unseen, "source_url", "left")
    stale = F.coalesce("unseen", F.lit(False))
    return _switch_off(joined, stale, run).select(*variants.columns)


def apply_run(
    products: DataFrame,
    variants: DataFrame,
    accepted: DataFrame,
    run: RunStamp,
    complete: bool,
) -> tuple[DataFrame, DataFrame]:
    """Merge the accepted pages of a run; a complete scan also switches off the unseen.

    What a complete scan did not see is known from the stored products and the touched
    addresses alone, so variants are joined to their products only once.
    """
    incoming = latest_products(accepted)
    unseen = products.where(run.unseen()) if complete else None
    merged_variants = merge_variants(
        variants, latest_variants(accepted), touched_products(accepted), run, unseen
    )
    merged = merge_products(products, incoming, run)
    return (deactivate_products(merged, run) if complete else merged), merged_variants


def replay(accepted: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog after any number of runs over any scopes, in a single pass over all of them.

    Gives what applying the runs one after the other to empty tables gives, but reads every
    run once and shuffles once per table. ``runs`` is a table, ``run_no, run_id, source,
    category, at, complete``, one row a run in the order of ``run_no``; ``accepted`` carries
    ``run_no``.

    A product belongs to the scope of the run that first saw it. A complete run of that scope
    after the last run that saw it switches it off, and every later one moves its time again;
    so of each scope the last complete run is all that counts.
    """
    numbered = runs.withColumn("run_no", F.col("run_no").cast("long"))
    made = numbered.select(F.col("run_no").alias("first_no"), "source", "category", F.col("at").alias("created_at"))
    seen = numbered.select(
        F.col("run_no").alias("last_no"), F.col("run_id").alias("last_seen_run_id"), F.col("at").alias("last_seen_at")
    )
    full = numbered.where("complete").groupBy("source", "category").agg(
        F.max("run_no").alias("full_no"), F.max_by("at", "run_no").alias("off_at")
    )
    rows = accepted.withColumn("run_no", F.col("run_no").cast("long"))

    last = F.max_by(F.struct(*PRODUCT_VALUES, "run_no", "seq"), F.struct("run_no", "seq"))
    by_product = by_address(rows).agg(
        last.alias("last"), F.min("run_no").alias("first_no"), F.max("run_no").alias("last_no")
    )
    url = F.col("source_url")
    dated = look_up(look_up(by_product, made, ["first_no"], url), seen, ["last_no"], url)
    scoped = look_up(dated, full, ["source", "category"], url)
    stale = F.coalesce(F.col("last_no") < F.col("full_no"), F.lit(False))
    stated = scoped.withColumn("stale", stale).withColumn(
        "updated_at", F.when(F.col("stale"), F.col("off_at")).otherwise(F.col("last_seen_at"))
    )
    products = stated.select(
        "source",
        "category",
        "source_url",
        *(F.col(f"last.{n}").alias(n) for n in PRODUCT_VALUES if n != "available"),
        (F.col("last.available") & ~F.col("stale")).alias("available"),
        "last_seen_run_id",
        F.col("created_at").alias("first_seen_at"),
        "last_seen_at",
        "created_at",
        "updated_at",
    ).select(*PRODUCTS.names)

    # Pages are dealt by address with their variants still in one row, and meet their product
    # there; keys of an address stay with it, so the variants are not shuffled again.
    final = stated.select(
        "source_url", F.struct("last.run_no", "last.seq").alias("last_page"), "stale", "updated_at"
    )
    pages = rows.select("source_url", "run_no", "seq", "variants").join(final, "source_url")
    state = ("on_last_page", "stale", "updated_at")
    placed = pages.withColumn("on_last_page", F.struct("run_no", "seq") == F.col("last_page"))
    flat = explode_items(placed, "variants", "v", "source_url", "run_no", "seq", *state)
    place = F.struct("run_no", "seq", "pos")
    by_variant = flat.groupBy("source_url", F.col("v.source_key").alias("source_key"), "stale", "updated_at").agg(
        F.max_by(F.struct(*(f"v.{n}" for n in VARIANT_VALUES), "on_last_page"), place).alias("v"),
        F.min("run_no").alias("first_no"),
    )
    created = made.select("first_no", "created_at")
    joined = look_up(by_variant, created, ["first_no"], F.col("source_key"))
    listed = F.col("v.on_last_page") & ~F.col("stale")
    variants = joined.select(
        "source_url",
        "source_key",
        *(F.col(f"v.{n}").alias(n) for n in VARIANT_VALUES if n != "available"),
        (F.col("v.available") & listed).alias("available"),
        "created_at",
        "updated_at",
    ).select(*PRODUCT_VARIANTS.names)
    return products, variants


def content_changes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``source_url, change``: new, changed or same by fingerprint.

    The fingerprint is stored for a later refresh of derived data; comparing it is an
    addition of this package.
    """
    old = stored.select("source_url", F.col("content_hash").alias("old_hash"))
    new = incoming.select("source_url", F.col("content_hash").alias("new_hash"))
    joined = new.join(old, "source_url", "left")
    change = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
        .otherwise("same")
    )
    return joined.select("source_url", change.alias("change"))
