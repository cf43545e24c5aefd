"""Plans hold what the design promises."""

import io
import os
import re
from contextlib import redirect_stdout
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks.oracle import ORACLE
from checks.queries import QUERIES
from offerlake.operators import extract, links, merge
from offerlake.schemas import ACCEPTED, PRODUCT_VARIANTS, PRODUCTS
from offerlake.session import joins_in_place

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def physical(frame):
    text = io.StringIO()
    with redirect_stdout(text):
        frame.explain("formatted")
    return text.getvalue()


def test_extraction_has_no_shuffle(spark, folder):
    spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string").write.parquet(folder + "/p")
    pages = spark.read.parquet(folder + "/p")
    plan = physical(extract.extract_products(pages))
    assert "Exchange" not in plan
    assert len(plan) < 200_000
    rows = physical(extract.variant_rows(extract.extract_products(pages)))
    assert "Exchange" not in rows and len(rows) < 200_000


def test_listing_pages_go_to_python_once(spark, folder):
    spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string").write.parquet(folder + "/p")
    plan = physical(links.listing_pages(spark.read.parquet(folder + "/p")))
    assert plan.split("\n\n")[0].count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_latest_per_key_sorts_no_wide_rows_to_aggregate_them(spark):
    rows = spark.range(10).select((F.col("id") % 2).alias("k"), "id", F.lit("x").alias("v"))
    plan = physical(merge.latest_per_key(rows, ["k"], F.col("id")))
    assert "partial_max" in plan and "SortAggregate" not in plan and "Window" not in plan
    accepted = spark.createDataFrame([], ACCEPTED)
    assert "SortAggregate" not in physical(merge.latest_variants(accepted))
    assert "SortAggregate" not in physical(merge.latest_products(accepted))


def test_latest_per_key_with_a_key_of_a_third_of_the_rows(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        F.expr("(id * 7919) % 3001").alias("seq"), F.concat(F.lit("v"), "id").alias("v"),
    )
    got = {r["k"]: (r["seq"], r["v"]) for r in merge.latest_per_key(rows, ["k"], F.col("seq")).collect()}
    expected = {}
    for r in rows.collect():
        expected[r["k"]] = max(expected.get(r["k"], (-1, "")), (r["seq"], r["v"]))
    assert got == expected


@needs_data
@pytest.mark.parametrize("name", ["product_rollup", "catalog_after_runs", "missing_variants", "seen_history", "rejects"])
def test_no_cartesian_product_and_no_global_window(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan


@needs_data
def test_scans_read_only_what_they_need(spark):
    plan = physical(QUERIES["duplicate_keys"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@needs_data
@pytest.mark.parametrize("name", ["product_rollup", "rejects", "latest_per_key", "run_ledger", "normalize_text"])
def test_queries_match_sql(spark, name):
    from checks.compare import differences

    assert differences(spark, SF, name) == ""


def test_lines_are_not_dealt_out_before_the_merges(spark, folder):
    """The merges read the lines several times; a shuffle of the table would be made each time."""
    from checks.queries import lines_table

    spark.range(100).selectExpr("id AS l_orderkey", "id AS l_linenumber").write.parquet(f"{folder}/lineitem.parquet")
    plan = lines_table(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_parts_are_dealt_before_they_become_pages(spark, folder):
    """A part table of one split gives pages in several tasks."""
    from checks.whole_runs import dealt_parts, product_pages

    rows = spark.range(200).selectExpr(
        "id AS p_partkey", "'a' AS p_name", "'b' AS p_brand", "1 AS p_size", "2.0D AS p_retailprice"
    )
    rows.coalesce(1).write.parquet(f"{folder}/part.parquet")
    part = spark.read.parquet(f"{folder}/part.parquet")
    pages = product_pages(dealt_parts(part))
    assert pages.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(r["key"] for r in pages.collect()) == list(range(200))


@pytest.fixture()
def without_broadcast(spark):
    """Joins as large tables have them."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


BY_KEY = r"hashpartitioning\(source_url#\d+, source_key#\d+"
BY_URL = r"hashpartitioning\(source_url#\d+, \d+\)"


def listed_pages(spark, pages, variants=2, urls=50):
    """Accepted pages with an integer ``run_no``; variants differ from page to page."""
    keys = "concat('k', (id + v) % 5)"
    variant = (
        f"named_struct('source_key', {keys}, 'sku', 's', 'name', concat('n', id, '-', v), "
        "'price', CAST(id AS decimal(12,2)), 'currency', 'USD', 'available', true)"
    )
    return spark.range(pages).selectExpr(
        "id AS seq", "CAST(id % 3 AS int) AS run_no", f"concat('u', CASE WHEN id % 10 < 9 THEN 0 ELSE id % {urls} END) AS source_url",
        "'n' AS name", "CAST(NULL AS string) AS brand", "'' AS description", "CAST(id AS decimal(12,2)) AS price",
        "'USD' AS currency", "true AS available", "CAST(map() AS map<string,string>) AS characteristics",
        "CAST(NULL AS string) AS image_url", "'h' AS content_hash",
        f"transform(sequence(1, {variants}), v -> {variant}) AS variants",
    )


def test_replayed_variants_are_not_shuffled_again(spark, without_broadcast):
    runs = spark.createDataFrame(
        [(n, f"r{n}", "s", "c", datetime(2024, 1, 1 + n), True) for n in range(3)],
        "run_no long, run_id string, source string, category string, at timestamp, complete boolean",
    )
    plan = physical(merge.replay(listed_pages(spark, 100), runs)[1])
    assert not re.search(BY_KEY, plan) and re.search(BY_URL, plan)


def last_listed(pages):
    """The value of the last place of each key, by a loop."""
    last = {}
    for page in sorted(pages.collect(), key=lambda r: r["seq"]):
        for variant in page["variants"]:
            last[page["source_url"], variant["source_key"]] = (page["seq"], variant["name"])
    return last


def test_an_address_with_most_of_the_pages_is_split(spark, without_broadcast):
    """Adaptive execution deals its pages to several tasks, and the result stays."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    }
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        pages = listed_pages(spark, 6000)
        latest = merge.latest_variants(pages)
        got = {(r["source_url"], r["source_key"]): (r["seq"], r["name"]) for r in latest.collect()}
        assert "SortMergeJoin(skew=true)" in latest._jdf.queryExecution().executedPlan().toString()
        assert got == last_listed(pages)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def stored_variants(pages):
    """Variants as the tables hold them."""
    value = {"created_at": "timestamp'2024-01-01'", "updated_at": "timestamp'2024-01-01'"}
    latest = merge.latest_variants(pages)
    return latest.selectExpr(*(f"{value.get(n, n)} AS {n}" for n in PRODUCT_VARIANTS.names))


def test_merged_variants_are_shuffled_by_address_only(spark, folder, without_broadcast):
    stored_variants(listed_pages(spark, 100)).write.parquet(folder + "/v")
    pages = listed_pages(spark, 300)
    run = merge.RunStamp("r", "s", "c", datetime(2024, 2, 1))
    stored = spark.read.schema(PRODUCT_VARIANTS).parquet(folder + "/v")
    with joins_in_place(spark):
        merged = merge.apply_run(spark.createDataFrame([], PRODUCTS), stored, pages, run, False)[1]
        plan = physical(merged)
        rows = merged.collect()
    assert not re.search(BY_KEY, plan) and re.search(BY_URL, plan)
    got = {(r["source_url"], r["source_key"]): r["name"] for r in rows}
    assert len(rows) == len(got) and got == {k: v[1] for k, v in last_listed(pages).items()}


def test_products_are_reduced_before_they_are_shuffled(spark):
    """Of an address with most of the pages a task sends its last one."""
    pages = listed_pages(spark, 4000)
    latest = merge.latest_products(pages)
    plan = physical(latest)
    assert plan.count("WindowGroupLimit") >= 2
    got = {r["source_url"]: r["seq"] for r in latest.collect()}
    expected = {}
    for r in pages.collect():
        expected[r["source_url"]] = max(expected.get(r["source_url"], -1), r["seq"])
    assert got == expected


def test_places_that_come_twice_stay_and_rows_without_a_key_go(spark):
    twice = listed_pages(spark, 20).unionByName(listed_pages(spark, 20))
    assert merge.latest_variants(twice).count() == 2 * merge.latest_variants(listed_pages(spark, 20)).count()
    assert merge.latest_products(twice).count() == 2 * merge.latest_products(listed_pages(spark, 20)).count()
    for column in ("source_url", "seq"):
        gone = twice.withColumn(column, F.lit(None).cast(dict(twice.dtypes)[column]))
        assert merge.latest_variants(gone).count() == 0 and merge.latest_products(gone).count() == 0
    unkeyed = twice.withColumn("variants", F.transform("variants", lambda v: v.withField("source_key", F.lit(None).cast("string"))))
    assert merge.latest_variants(unkeyed).count() == 0


def test_few_unseen_products_are_not_met_by_a_shuffle_of_all_variants(spark, folder):
    stored_variants(listed_pages(spark, 100)).write.parquet(folder + "/v")
    names = [f"`{f.name}`" for f in PRODUCTS.fields]
    # Large enough for Spark to shuffle, before it knows that few of them were not seen.
    run = merge.RunStamp("r", "s", "c", datetime(2024, 2, 1))
    seen = "CASE WHEN id % 10000 = 0 THEN 'older' ELSE 'r' END"
    given = {"source_url": "concat('u', id)", "source": "'s'", "category": "'c'", "last_seen_run_id": seen}
    rows = spark.range(200_000).selectExpr(
        *(f"CAST({given.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {n}" for f, n in zip(PRODUCTS.fields, names, strict=True))
    )
    rows.write.parquet(folder + "/p")
    variants = spark.read.schema(PRODUCT_VARIANTS).parquet(folder + "/v")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "20k")
        off = merge.deactivate_variants(variants, spark.read.schema(PRODUCTS).parquet(folder + "/p"), run)
        assert "SortMergeJoin" not in physical(off)
        switched = {r["source_url"] for r in off.where("NOT available").collect()}
        assert switched == {"u0"}
    finally:
        spark.conf.set(name, before)
