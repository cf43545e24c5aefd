"""What the session settings bound: rows of an Arrow batch, and what one task reads."""

from __future__ import annotations

import pyarrow as pa

from offerlake.session import configure


def test_batches_that_leave_for_python_are_bounded(spark):
    configure(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = spark.range(0, 9000, 1, 1).mapInArrow(sizes, "n long").collect()
    assert sum(r["n"] for r in rows) == 9000
    assert max(r["n"] for r in rows) <= 2000


def test_tasks_are_cut_by_what_they_read_not_by_the_number_of_shuffle_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        configure(spark)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        counted = spark.range(200_000).selectExpr("sha2(string(id), 256) AS k").groupBy("k").count()
        assert counted.rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
        configure(spark)


def test_tables_are_read_in_small_splits(spark, folder):
    """What a task reads of a table grows as it is read, so a split is far below Spark's 128 MB."""
    configure(spark)
    big = spark.range(0, 9_000_000, 1, 1).selectExpr("sha2(string(id), 256) AS k")
    big.write.option("compression", "none").option("parquet.block.size", 4 << 20).parquet(folder + "/t")
    table = spark.read.parquet(folder + "/t")
    before = spark.conf.get("spark.sql.files.minPartitionNum", "1")
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        assert table.rdd.getNumPartitions() > 30
    finally:
        spark.conf.set("spark.sql.files.minPartitionNum", before)
