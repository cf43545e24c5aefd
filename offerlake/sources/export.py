"""JSON export of products."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.schemas import PRODUCT
from offerlake.sources import files


def write_products(products: DataFrame, path: str) -> None:
    """Replace the export at ``path``. Nulls stay as keys, text stays readable UTF-8.

    One JSON object per line, so that an export of any size is written in parallel and
    can be read back split. With a column ``seq`` the products go out in its order: parts
    hold ranges of it, so the lines of the parts, in the order of the parts' names, are in the
    order of the walk, and each line carries its number.

    The new export is written beside the old one and takes its place when it is complete.
    """
    ordered = "seq" in products.columns
    kept = ["seq"] if ordered else []
    prices = products.select(*kept, "product.*").withColumn("price", F.col("price").cast("double"))
    exported = prices.withColumn(
        "variants",
        F.transform("variants", lambda v: v.withField("price", v["price"].cast("double"))),
    )
    if ordered:
        exported = exported.repartitionByRange("seq").sortWithinPartitions("seq")
    spark, path = products.sparkSession, path.rstrip("/")
    fresh = f"{path}.{uuid.uuid4().hex}"
    try:
        exported.write.option("ignoreNullFields", "false").json(fresh)
        files.replace(spark, fresh, path)
    finally:
        files.remove(spark, fresh)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRODUCT).json(path)
