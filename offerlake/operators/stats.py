"""Catalog statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalog_stats(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Products, available products, variants: one row. Reads one column in all."""
    zero = F.lit(0).cast("long")
    counted = products.agg(
        F.count("*").alias("products"), F.count_if("available").alias("available")
    ).withColumn("variants", zero)
    listed = variants.agg(F.count("*").alias("variants")).select(
        zero.alias("products"), zero.alias("available"), "variants"
    )
    both = counted.unionByName(listed)
    return both.agg(*(F.sum(name).alias(name) for name in both.columns))
