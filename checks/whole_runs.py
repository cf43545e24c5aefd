"""Whole runs over a shop rendered from the part table: by walk, and as a stream of pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.operators.ledger import open_run
from offerlake.operators.merge import RunStamp
from offerlake.plans.catalog_run import RunOptions, run_catalog
from offerlake.session import scratch_path
from offerlake.sources import files
from offerlake.sources.snapshots import SnapshotStore
from offerlake.streaming.ingest import close_run, save_pages

SHOP, CATALOG = "https://shop.example", "https://shop.example/c/"
SOURCE, CATEGORY = "shop", "parts"
#: Parts on a listing page.
LISTED = 50
FIRST, SECOND, END = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)


def dealt_parts(part: DataFrame) -> DataFrame:
    """``part`` dealt to all cores before its rows become pages.

    The table is small and may be read as one split; a page takes far longer to extract than its
    part to move.
    """
    return part.repartition(part.sparkSession.sparkContext.defaultParallelism, "p_partkey")


def product_url(key: Column) -> Column:
    return F.concat(F.lit(f"{SHOP}/p/"), key)


def listing_pages(part: DataFrame) -> DataFrame:
    """``url, html`` of the listing pages of ``part``, ``LISTED`` keys to each.

    Products are linked by relative addresses, and each page begins with the first product of
    the page before. There are links that are no products: outside the list, without the class,
    in a comment. Every page names the next one, also relatively, and the last one the first.
    """
    number = F.expr(f"p_partkey div {LISTED}")
    last = part.agg(F.max(number)).first()[0]
    item = F.concat(
        F.lit('<div class="products-flex-item"><a href="/p/decoy">photo</a><a class="name" href="../p/'),
        "p_partkey",
        F.lit('">part</a></div>'),
    )
    pages = part.groupBy(number.alias("number")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("key"), item.alias("item")))).alias("items")
    )
    again = F.when(
        F.col("number") > 0,
        F.concat(
            F.lit('<div class="products-flex-item"><a class="name" href="/p/'),
            (F.col("number") - 1) * LISTED,
            F.lit('">again</a></div>'),
        ),
    ).otherwise("")
    following = F.when(
        F.col("number") < F.lit(last), F.concat(F.lit("?page="), F.col("number") + 1)
    ).otherwise("/c/")
    url = F.when(F.col("number") == 0, CATALOG).otherwise(
        F.concat(F.lit(f"{CATALOG}?page="), "number")
    )
    html = F.concat(
        F.lit("<html><head><link rel='next' href='"),
        following,
        F.lit("'></head><body><a class='name' href='/p/outside'>no</a><div id='catalog-content'>"),
        F.lit("<!-- <div class='products-flex-item'><a class='name' href='/p/comment'></a></div> -->"),
        again,
        F.array_join("items.item", ""),
        F.lit("</div></body></html>"),
    )
    return pages.select(url.alias("url"), html.alias("html"))


def product_pages(part: DataFrame, prices: int = 1, currency: Column | None = None) -> DataFrame:
    """``key, url, html`` of the product pages: two variants, the second without a name."""
    price = F.col("p_retailprice").cast("decimal(12,2)") * prices
    currency = F.lit("USD") if currency is None else currency

    def offer(price: Column, available: Column) -> Column:
        return F.struct(
            price.cast("string").alias("price"),
            currency.alias("priceCurrency"),
            F.when(available, "https://schema.org/InStock").alias("availability"),
        )

    key, size = F.col("p_partkey"), F.col("p_size")
    named = F.struct(
        F.concat(F.lit("S"), key).alias("sku"),
        F.concat("p_name", F.lit(" S")).alias("name"),
        offer(price, size > 10).alias("offers"),
    )
    bare = F.struct(
        F.concat(F.lit("N"), key).alias("sku"),
        F.lit(None).cast("string").alias("name"),
        offer(price - 1, size > 30).alias("offers"),
    )
    node = F.struct(
        F.lit("ProductGroup").alias("@type"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.array(named, bare).alias("hasVariant"),
    )
    html = F.concat(
        F.lit('<html><script type="application/ld+json">'), F.to_json(node), F.lit("</script></html>")
    )
    return part.select(key.alias("key"), product_url(key).alias("url"), html.alias("html"))


def left_in_second(part: DataFrame) -> DataFrame:
    return part.where(F.col("p_partkey") % 4 != 1)


def two_catalog_runs(spark: SparkSession, sf_dir: str) -> tuple[SnapshotStore, str]:
    """The store and the last export after two runs with tables and export.

    In the first some product pages are missing and some have a currency that no table takes.
    The second, in three slices, finds three quarters of the products, all sound, at twice the
    price; it is a complete scan.
    """
    part = dealt_parts(spark.read.parquet(f"{sf_dir}/part.parquet"))
    root = scratch_path(spark, "runs")
    store, export = SnapshotStore(spark, f"{root}/store"), f"{root}/export"
    odd = F.when(F.col("p_partkey") % 50 == 11, "EURO").otherwise("USD")
    first = product_pages(part.where(F.col("p_partkey") % 50 != 7), 1, odd).drop("key")
    rest = left_in_second(part)
    for number, listed, products, at, stages in (
        (1, part, first, FIRST, 1),
        (2, rest, product_pages(rest, 2).drop("key"), SECOND, 3),
    ):
        path = f"{root}/pages-{number}"
        listing_pages(listed).unionByName(products).write.parquet(path)
        options = RunOptions(
            f"run-{number}", SOURCE, CATEGORY, CATALOG, at, storage="both", limit=0, stages=stages
        )
        run_catalog(spark.read.parquet(path), options, store, export, lambda: END)
    return store, export


def catalog_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, export = two_catalog_runs(spark, sf_dir)
    variants = store.read("variants").groupBy("source_url").agg(
        F.count_if("available").alias("on_offer"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source_key", "name"))), ",").alias("variants"),
    )
    exported = spark.read.schema("seq long, link string, price double").json(export).select(
        F.col("link").alias("source_url"), F.col("seq").alias("export_seq"), F.col("price").alias("export_price")
    )
    products = store.read("products").join(variants, "source_url").join(exported, "source_url", "left")
    return products.select(
        "source_url", "name", "brand", "price", "currency", "available", "last_seen_run_id",
        F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen_at"),
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        "on_offer", "variants", "export_seq", "export_price",
    )


def catalog_run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = two_catalog_runs(spark, sf_dir)[0].read("runs")
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "finished_at")]
    return runs.select(*(c for c in runs.columns if c not in ("started_at", "finished_at")), *times)


def stream_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants after two streamed runs; the second has two batches, the second of them twice.

    What a batch had written when the stream broke before it was marked as done is found by the
    batch's number when it comes again. The second run lists three quarters of the products and
    is complete, so closing it switches off the others, which the first run has left.
    """
    part = dealt_parts(spark.read.parquet(f"{sf_dir}/part.parquet"))
    root = scratch_path(spark, "streams")
    store, key = SnapshotStore(spark, f"{root}/store"), F.col("p_partkey")
    rest = left_in_second(part)
    halves = [rest.where(key % 2 == 0), rest.where(key % 2 == 1)]
    for number, batches, at in ((1, [part], FIRST), (2, halves, SECOND)):
        run = RunStamp(f"run-{number}", SOURCE, CATEGORY, at)
        source, progress = f"{root}/pages-{number}", f"{root}/progress-{number}"

        def feed(run=run, source=source, progress=progress):
            pages = spark.readStream.schema("seq long, url string, html string").parquet(source)
            save_pages(pages, store, run, progress).awaitTermination()

        for rows in batches:
            product_pages(rows, number).withColumnRenamed("key", "seq").write.mode("append").parquet(source)
            feed()
        if number == 2:
            files.remove(spark, f"{progress}/commits/1")
            feed()
        opened = open_run(
            spark, run_id=run.run_id, source=SOURCE, category=CATEGORY, catalog_url=CATALOG,
            storage_mode="tables", is_full_scan=True, started_at=at,
        )
        close_run(store, run, opened)
    products = store.read("products").select(
        "source_url", F.col("available").alias("product_available"), "last_seen_run_id"
    )
    saved = store.read("runs").select(
        F.col("id").alias("last_seen_run_id"), "status", "products_found", "products_saved"
    )
    joined = store.read("variants").join(products, "source_url").join(saved, "last_seen_run_id")
    return joined.select(
        "source_url", "product_available", "last_seen_run_id", "status", "products_found", "products_saved",
        "source_key", "name", "price", "available", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
    )
