"""Product pages as a file stream into the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.whole_runs import dealt_parts
from offerlake.operators.ledger import open_run
from offerlake.operators.merge import RunStamp
from offerlake.session import scratch_path
from offerlake.sources.snapshots import SnapshotStore
from offerlake.streaming.ingest import close_run, save_pages

PART_SCHEMA = (
    "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
)


def part_page(url: Column) -> Column:
    """A product page out of a single part row, with one variant per odd and even size."""
    offer = F.struct(
        F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"),
        F.lit("USD").alias("priceCurrency"),
        F.when(F.col("p_size") > 10, "https://schema.org/InStock").alias("availability"),
    )
    node = F.struct(
        F.lit("Product").alias("@type"),
        F.col("p_name").alias("name"),
        url.alias("url"),
        F.col("p_brand").alias("brand"),
        F.concat(F.lit("P"), "p_partkey").alias("sku"),
        offer.alias("offers"),
    )
    return F.concat(
        F.lit('<html><script type="application/ld+json">'), F.to_json(node), F.lit("</script></html>")
    )


def stream_parts(spark: SparkSession, sf_dir: str, run: RunStamp) -> DataFrame:
    """Catalog after a stream over all parts; every third part repeats an address."""
    parts = dealt_parts(
        spark.readStream.schema(PART_SCHEMA)
        .option("pathGlobFilter", "part.parquet")
        .parquet(sf_dir)
    )
    key = F.col("p_partkey")
    group = F.when(key % 3 == 2, key - 1).otherwise(key)
    url = F.concat(F.lit("https://shop.example/p/"), group)
    pages = parts.select(key.alias("seq"), url.alias("url"), part_page(url).alias("html"))
    root = scratch_path(spark, "stream")
    store = SnapshotStore(spark, f"{root}/store")
    save_pages(pages, store, run, f"{root}/progress").awaitTermination()
    opened = open_run(
        spark,
        run_id=run.run_id,
        source=run.source,
        category=run.category,
        catalog_url="https://shop.example/c/",
        storage_mode="tables",
        is_full_scan=True,
        started_at=run.at,
    )
    close_run(store, run, opened)
    return (
        store.read("variants")
        .join(store.read("products").select("source_url", F.col("name").alias("product"), "brand"), "source_url")
        .select("source_url", "product", "brand", "source_key", "name", "price", "currency", "available")
    )
