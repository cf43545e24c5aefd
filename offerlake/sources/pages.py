"""Fetched pages as a table or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerlake.schemas import PAGES


def read_pages(spark: SparkSession, path: str, partitions: int = 0) -> DataFrame:
    """Pages of a parquet table, left where they lie.

    Reading a page takes far more time than its bytes suggest. A caller who knows that the
    table has too few splits for the cluster gives a number of ``partitions`` to deal the
    pages to; without one html is not moved.
    """
    pages = spark.read.schema(PAGES).parquet(path)
    return pages.repartition(partitions, "url") if partitions else pages


def stream_pages(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Pages as they arrive in a folder, by files."""
    return spark.readStream.schema(PAGES).option("pathGlobFilter", glob).parquet(path)
