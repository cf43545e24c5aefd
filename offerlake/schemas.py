"""Table schemas, defaults and constants of the catalog."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

EXTRACTED_PRICE = T.DecimalType(38, 10)
# What a number beyond the digits above is kept as; no table takes it.
TOO_LARGE = Decimal("9" * 28 + "." + "9" * 10)
STORED_PRICE = T.DecimalType(12, 2)

# The states a run can be in.
RUN_STATUSES = ("running", "completed", "partial", "failed", "cancelled")

# Fixed value: characteristics key that carries the brand.
BRAND_LABEL = "Бренд"

# Schema.org types that make a JSON-LD node a product.
GROUP_TYPE = "ProductGroup"
SINGLE_TYPE = "Product"

# Where a run can be stored.
STORAGE_MODES = ("json", "tables", "both")

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

VARIANT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("sku", T.StringType()),
        T.StructField("price", EXTRACTED_PRICE),
        T.StructField("currency", T.StringType()),
        T.StructField("available", T.BooleanType()),
    ]
)

PRODUCT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("price", EXTRACTED_PRICE),
        T.StructField("currency", T.StringType()),
        T.StructField("available", T.BooleanType()),
        T.StructField("brand", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("characteristics", T.MapType(T.StringType(), T.StringType())),
        T.StructField("variants", T.ArrayType(VARIANT)),
        T.StructField("image", T.StringType()),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("source_url", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("brand", T.StringType()),
        T.StructField("description", T.StringType(), False),
        T.StructField("price", STORED_PRICE),
        T.StructField("currency", T.StringType()),
        T.StructField("available", T.BooleanType(), False),
        T.StructField("characteristics", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField("image_url", T.StringType()),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("last_seen_run_id", T.StringType()),
        T.StructField("first_seen_at", T.TimestampType(), False),
        T.StructField("last_seen_at", T.TimestampType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

PRODUCT_VARIANTS = T.StructType(
    [
        T.StructField("source_url", T.StringType(), False),
        T.StructField("source_key", T.StringType(), False),
        T.StructField("sku", T.StringType()),
        T.StructField("name", T.StringType(), False),
        T.StructField("price", STORED_PRICE),
        T.StructField("currency", T.StringType()),
        T.StructField("available", T.BooleanType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

STORED_VARIANT = T.StructType(
    [
        T.StructField("source_key", T.StringType()),
        T.StructField("sku", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("price", STORED_PRICE),
        T.StructField("currency", T.StringType()),
        T.StructField("available", T.BooleanType()),
    ]
)

# Accepted products of a run on their way to the tables, variants still nested.
ACCEPTED = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("price", STORED_PRICE),
        T.StructField("currency", T.StringType()),
        T.StructField("available", T.BooleanType()),
        T.StructField("characteristics", T.MapType(T.StringType(), T.StringType())),
        T.StructField("image_url", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("variants", T.ArrayType(STORED_VARIANT)),
    ]
)

# The same in the batches of a stream: ``row`` tells pages of equal ``seq`` apart.
STREAMED = T.StructType([*ACCEPTED.fields, T.StructField("row", T.LongType())])

# What became of the pages of a run.
OUTCOMES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("reasons", T.ArrayType(T.StringType())),
    ]
)

SCRAPE_RUNS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("catalog_url", T.StringType(), False),
        T.StructField("storage_mode", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("full_scan", T.BooleanType(), False),
        T.StructField("products_found", T.LongType(), False),
        T.StructField("products_saved", T.LongType(), False),
        T.StructField("products_failed", T.LongType(), False),
        T.StructField("error_message", T.StringType()),
        T.StructField("started_at", T.TimestampType(), False),
        T.StructField("finished_at", T.TimestampType()),
    ]
)
