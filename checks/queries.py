"""One query per operator, each over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import whole_runs
from checks.shop_pages import LINE_ORDER, shop_pages
from offerlake.functions import scalars
from offerlake.functions.rows import explode_items
from offerlake.functions.variant import type_names
from offerlake.operators import extract, ledger, links, merge, quality, stats
from offerlake.operators.crawl import crawl
from offerlake.schemas import PRODUCT_VARIANTS, PRODUCTS
from offerlake.session import configure, joins_in_place, materialize, scratch_path
from offerlake.sources.pages import read_pages
from offerlake.sources.export import read_products, write_products

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SOURCE, CATEGORY = "shop", "parts"
LINE_KEY = ["l_partkey", *LINE_ORDER]


def query(build: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(configure(spark), sf_dir)

    QUERIES[build.__name__] = run
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(price: Column) -> Column:
    return price.cast("decimal(12,2)")


def clock(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz").alias(name)


def clocks(rows: DataFrame) -> DataFrame:
    """Stamps without a time zone, as the given tables have them."""
    return rows.select(
        *(clock(c) if t == "timestamp" else F.col(c) for c, t in rows.dtypes)
    )


def rendered(spark: SparkSession, sf_dir: str, spoiled: bool = False) -> DataFrame:
    return shop_pages(
        table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), spoiled
    )


# Scalar functions


@query
def normalize_text(spark, sf_dir):
    injected = F.concat("text", F.lit("\u00a0 x\x1c\u2003y\u200bz \x85"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", scalars.normalize_text(injected).alias("text")
    )


@query
def parse_price(spark, sf_dir):
    plain = money(F.col("l_extendedprice")).cast("string")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    text = (
        F.when(kind == 0, F.replace(plain, F.lit("."), F.lit(",")))
        .when(kind == 1, F.concat(F.left(plain, F.lit(1)), F.lit(" "), F.substring(plain, 2, 99)))
        .when(kind == 2, F.concat(F.lit("abc"), plain))
        .when(kind == 3, F.concat(plain, F.lit("d")))
        .when(kind == 4, "")
        .when(kind == 5, F.concat(F.lit("\u00a0 +"), plain, F.lit(" \u2003")))
        .when(kind == 6, F.concat(F.left(plain, F.lit(1)), F.lit("\u00a0"), F.substring(plain, 2, 99)))
        .otherwise(plain)
    )
    return table(spark, sf_dir, "lineitem").select(
        *LINE_KEY, money(scalars.parse_price(text)).alias("price")
    )


@query
def content_hash(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    brand = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))
    described = F.concat("p_name", F.lit(' "quoted" \\ é\n'))
    properties = F.create_map(
        F.lit("Type"), "p_type", F.lit("Size"), F.col("p_size").cast("string"), F.lit("Ж"), F.lit("1")
    )
    digest = scalars.content_hash(
        F.col("p_name"),
        brand,
        described,
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice").cast("decimal(30,10)")),
        F.lit("USD"),
        properties,
    )
    return part.select("p_partkey", digest.alias("content_hash"))


@query
def variant_keys(spark, sf_dir):
    sku = F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit(" S"), "l_suppkey", F.lit(" ")))
    name = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(" Item "), "l_partkey", F.lit("\t")))
    return table(spark, sf_dir, "lineitem").select(
        *LINE_KEY, scalars.variant_source_key(sku, name).alias("source_key")
    )


@query
def redact_secrets(spark, sf_dir):
    message = F.concat(
        "text",
        F.lit(" PostgreSQL://shop:pw"),
        "doc_id",
        F.lit("@db.example/x Password = k"),
        "doc_id",
        F.lit(" end"),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", scalars.redact_secrets(message).alias("message")
    )


# Links and walks


@query
def page_links(spark, sf_dir):
    return links.page_links(read_pages(spark, f"{sf_dir}/pages.parquet", spark.sparkContext.defaultParallelism)).select("page_id", "pos", "href")


@query
def resolve_links(spark, sf_dir):
    return links.page_links(read_pages(spark, f"{sf_dir}/pages.parquet", spark.sparkContext.defaultParallelism)).select("page_id", "pos", "link")


@query
def links_dedup_first(spark, sf_dir):
    return links.distinct_page_links(read_pages(spark, f"{sf_dir}/pages.parquet", spark.sparkContext.defaultParallelism))


def event_chains(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each user's events as a chain of listing pages, each naming the following one.

    The following event is looked up within the hour, and across hours on one row per
    hour, so that no window holds all events of a user.
    """
    hourly = events.withColumn("hour", F.date_trunc("hour", "ts"))
    in_hour = Window.partitionBy("user_id", "hour").orderBy("ts")
    first = F.min(F.struct("ts", "event_id"))["event_id"]
    hours = hourly.groupBy("user_id", "hour").agg(first.alias("first_id"))
    by_hour = Window.partitionBy("user_id").orderBy("hour")
    later = hours.select("user_id", "hour", F.lead("first_id").over(by_hour).alias("next_id"))
    following = hourly.withColumn("in_hour", F.lead("event_id").over(in_hour)).join(
        later, ["user_id", "hour"]
    )
    k = F.get_json_object("props", "$.k")
    pages = following.select(
        F.col("user_id").alias("catalog"),
        F.col("event_id").alias("page"),
        F.coalesce("in_hour", "next_id").alias("next"),
        F.array(
            F.concat(F.lit("/k/"), k),
            F.concat(F.lit("/v/"), F.floor("value").cast("string")),
        ).alias("links"),
    )
    starts = hours.groupBy("user_id").agg(F.min_by("first_id", "hour").alias("page"))
    return pages, starts.withColumnRenamed("user_id", "catalog")


def _crawled(spark, sf_dir, **caps) -> DataFrame:
    pages, starts = event_chains(table(spark, sf_dir, "events"))
    walked = crawl(materialize(pages, "chains"), starts, **caps)
    return walked.select(
        "catalog", F.col("seq").cast("long").alias("seq"), "page_no", F.col("pos").cast("int").alias("pos"), "url"
    )


@query
def crawl_order(spark, sf_dir):
    return _crawled(spark, sf_dir)


@query
def crawl_max_pages(spark, sf_dir):
    return _crawled(spark, sf_dir, max_pages=5)


@query
def crawl_limit(spark, sf_dir):
    return _crawled(spark, sf_dir, limit=7)


# Extraction


@query
def jsonld_products(spark, sf_dir):
    products = extract.extract_products(rendered(spark, sf_dir))
    return products.select("url", F.col("product.name").alias("name"), F.col("product.link").alias("link"))


@query
def jsonld_graph(spark, sf_dir):
    nodes = extract.with_nodes(rendered(spark, sf_dir))
    names = f"transform(nodes, n -> array_join({type_names('n.type')}, '+'))"
    return nodes.select("url", F.expr(f"array_join({names}, '/')").alias("types"))


@query
def offers_flat(spark, sf_dir):
    pages = extract.with_variants(rendered(spark, sf_dir))
    rows = explode_items(pages, "variants", "v", "url")
    return rows.select(
        "url", "pos", "v.name", "v.sku", money(F.col("v.price")).alias("price"), "v.currency", "v.available"
    )


@query
def product_rollup(spark, sf_dir):
    pages = extract.with_variants(rendered(spark, sf_dir))
    rolled = pages.select("url", extract.rollup().alias("r"))
    return rolled.select("url", money(F.col("r.price")).alias("price"), "r.currency", "r.available")


@query
def brand_counts(spark, sf_dir):
    pages = extract.with_product_node(rendered(spark, sf_dir))
    return pages.select(extract.brand().alias("brand")).groupBy("brand").agg(
        F.count("*").alias("pages")
    )


@query
def longest_text_first(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", scalars.normalize_text(F.col("text")).alias("text")
    )
    order = F.struct(F.length("text"), -F.col("turn"))
    return merge.latest_per_key(texts.where(F.col("text") != ""), ["conv_id"], order)


@query
def characteristics_long(spark, sf_dir):
    products = extract.extract_products(rendered(spark, sf_dir))
    entries = F.map_entries("product.characteristics")
    return explode_items(products, entries, "e", "url").select("url", "e.key", "e.value").toDF(
        "url", "name", "value"
    )


@query
def extract_products(spark, sf_dir):
    p = F.col("product")
    return extract.extract_products(rendered(spark, sf_dir)).select(
        "url",
        "found",
        p["name"].alias("name"),
        p["link"].alias("link"),
        money(p["price"]).alias("price"),
        p["currency"].alias("currency"),
        p["available"].alias("available"),
        p["brand"].alias("brand"),
        p["description"].alias("description"),
        p["image"].alias("image"),
        F.size(p["variants"]).alias("variants"),
        F.size(p["characteristics"]).alias("characteristics"),
    )


@query
def json_roundtrip(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    products = part.select(
        F.struct(
            F.concat(F.lit("Деталь "), "p_name").alias("name"),
            F.concat(F.lit("https://shop.example/p/"), "p_partkey").alias("link"),
            F.col("p_retailprice").cast("decimal(38,10)").alias("price"),
            F.lit(None).cast("string").alias("currency"),
            (F.col("p_size") > 25).alias("available"),
            F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("brand"),
            F.lit("").alias("description"),
            F.create_map(F.lit("Type"), "p_type").alias("characteristics"),
            F.array().cast(
                "array<struct<name:string,sku:string,price:decimal(38,10),currency:string,available:boolean>>"
            ).alias("variants"),
            F.lit(None).cast("string").alias("image"),
        ).alias("product")
    )
    path = scratch_path(spark, "export")
    write_products(products, path)
    return read_products(spark, path).select(
        "name",
        "link",
        money(F.col("price")).alias("price"),
        "currency",
        "available",
        "brand",
        "description",
        F.col("characteristics")["Type"].alias("type"),
        F.size("variants").alias("variants"),
    )


# Constraints


@query
def rejects(spark, sf_dir):
    pages = extract.extract_products(rendered(spark, sf_dir, spoiled=True))
    return quality.rejects(quality.checked(pages))


@query
def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query
def orphan_variants(spark, sf_dir):
    key = F.col("p_partkey")
    renamed = F.when(key % 10 == 0, -1 - key).otherwise(key)
    parents = table(spark, sf_dir, "part").select(renamed.alias("l_partkey"))
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY)
    return quality.orphans(lines, parents, "l_partkey")


# Merging


def run_stamp(year: int) -> merge.RunStamp:
    return merge.RunStamp(f"run-{year}", SOURCE, CATEGORY, datetime(year, 12, 31))


@query
def latest_per_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_extendedprice", "l_quantity")
    return merge.latest_per_key(
        lines, ["l_partkey", "l_suppkey"], F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    )


def part_products(part: DataFrame, changed: bool) -> DataFrame:
    """Parts as accepted products of the first run, or of the second one.

    The second run leaves out every fourth part, changes odd ones and adds new keys.
    """
    key = F.col("p_partkey")
    price = money(F.col("p_retailprice"))
    brand = F.col("p_brand")
    url = F.concat(F.lit("https://shop.example/p/"), key)
    if changed:
        part = part.where(key % 4 != 1)
        odd = key % 2 == 1
        price = F.when(odd, money(price * 2)).otherwise(price)
        brand = F.when(~odd | (key % 3 != 0), brand)
        url = F.when(key % 6 == 0, F.concat(url, F.lit("-new"))).otherwise(url)
    properties = F.create_map(F.lit("Type"), "p_type")
    row = part.select(
        key.alias("seq"),
        url.alias("source_url"),
        F.col("p_name").alias("name"),
        brand.alias("brand"),
        F.lit("").alias("description"),
        price.alias("price"),
        F.lit("USD").alias("currency"),
        (F.col("p_size") > 10).alias("available"),
        properties.alias("characteristics"),
        F.lit(None).cast("string").alias("image_url"),
    )
    return row.withColumn(
        "content_hash",
        scalars.content_hash(*(F.col(c) for c in ("name", "brand", "description", "price", "currency", "characteristics"))),
    )


def empty_catalog(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], PRODUCTS), spark.createDataFrame([], PRODUCT_VARIANTS)


def two_product_runs(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    first = merge.merge_products(
        empty_catalog(spark)[0], part_products(part, False), run_stamp(1995)
    )
    return merge.merge_products(first, part_products(part, True), run_stamp(1996))


@query
def merge_products(spark, sf_dir):
    merged = two_product_runs(spark, sf_dir)
    type_name = F.col("characteristics")["Type"].alias("type")
    return clocks(merged).select(
        *(c for c in merged.columns if c not in ("characteristics", "content_hash")), type_name
    )


@query
def deactivate_products(spark, sf_dir):
    merged = merge.deactivate_products(two_product_runs(spark, sf_dir), run_stamp(1996))
    return merged.select("source_url", "available", "last_seen_run_id", clock("updated_at"))


@query
def changed_products(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return merge.content_changes(part_products(part, False), part_products(part, True))


def lines_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as they are read: the merges read them several times, and a shuffle here would be
    made each time, into a number of tasks that does not grow with the table."""
    return table(spark, sf_dir, "lineitem")


def line_pages(lineitem: DataFrame) -> DataFrame:
    """Every line as an accepted page, in the order of ``seq``.

    Pages of a part and a group of suppliers share their address, so within a run the last
    page decides. A page lists two variants, and one of them again where the line number
    is 1.
    """
    seq = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    currency = F.when(F.col("l_returnflag") != "R", "USD")

    def variant(sku: Column, price: Column, available: Column) -> Column:
        return F.struct(
            F.concat(F.lit("sku:"), sku).alias("source_key"),
            sku.alias("sku"),
            F.concat(F.lit("Item "), sku).alias("name"),
            money(price).alias("price"),
            currency.alias("currency"),
            available.alias("available"),
        )

    supplied = F.concat(F.lit("S"), "l_suppkey")
    open_line = F.col("l_linestatus") == "O"
    both = F.array(
        variant(supplied, F.col("l_extendedprice"), open_line),
        variant(F.concat(F.lit("L"), "l_linenumber"), F.col("l_quantity"), F.col("l_quantity") > 25),
    )
    again = F.array(variant(supplied, F.col("l_quantity"), ~open_line))
    variants = F.when(F.col("l_linenumber") == 1, F.concat(both, again)).otherwise(both)
    pages = lineitem.withColumn("variants", variants).withColumn("r", extract.rollup())
    return pages.select(
        F.year("l_shipdate").alias("year"),
        seq.alias("seq"),
        F.concat(
            F.lit("https://shop.example/p/"), "l_partkey", F.lit("/"), F.col("l_suppkey") % 4
        ).alias("source_url"),
        F.concat(F.lit("Part "), "l_partkey").alias("name"),
        F.lit(None).cast("string").alias("brand"),
        F.lit("").alias("description"),
        "r.price",
        "r.currency",
        "r.available",
        F.create_map().cast("map<string,string>").alias("characteristics"),
        F.lit(None).cast("string").alias("image_url"),
        F.sha2(F.col("l_partkey").cast("string"), 256).alias("content_hash"),
        "variants",
    )


def in_first_run() -> Column:
    """The lines of two runs: those shipped to the end of 1997, and all later ones."""
    return F.col("year") <= 1997


def two_runs(pages: DataFrame, complete: tuple[bool, bool]) -> tuple[DataFrame, DataFrame]:
    """The catalog after two runs, each written out as the snapshots are."""
    catalog = empty_catalog(pages.sparkSession)
    for year, chosen, full in zip((1995, 1996), (in_first_run(), ~in_first_run()), complete):
        of_run = pages.where(chosen).drop("year")
        merged = merge.apply_run(*catalog, of_run, run_stamp(year), full)
        with joins_in_place(pages.sparkSession):
            catalog = tuple(materialize(t, "catalog") for t in merged)
    return catalog


@query
def merge_variants(spark, sf_dir):
    pages = line_pages(lines_table(spark, sf_dir))
    return clocks(two_runs(pages, (False, False))[1])


@query
def deactivate_variants(spark, sf_dir):
    products, variants = two_runs(line_pages(lines_table(spark, sf_dir)), (False, False))
    off = merge.deactivate_variants(variants, products, run_stamp(1996))
    return off.select("source_url", "source_key", "available", clock("updated_at"))


@query
def merge_partial_run(spark, sf_dir):
    """Pages of the second run fail where the quantity is 1, so nothing is switched off."""
    lines = lines_table(spark, sf_dir).withColumn("year", F.year("l_shipdate"))
    saved = in_first_run() | (F.col("l_quantity") != 1)
    outcomes = lines.select(
        F.when(in_first_run(), "run-1995").otherwise("run-1996").alias("run_id"),
        saved.alias("saved"),
    )
    names = ("products_found", "products_saved", "products_failed")
    counted = ledger.count_outcomes(outcomes).select(
        "run_id", ledger.complete_scan(F.lit(True), *map(F.col, names)).alias("complete")
    )
    # Two rows, one per run: this is the only thing the driver reads.
    gates = {r["run_id"]: r["complete"] for r in counted.collect()}
    complete = tuple(gates.get(f"run-{y}", False) for y in (1995, 1996))
    products, _ = two_runs(line_pages(lines.where(saved)), complete)
    return products.select("source_url", "available", "last_seen_run_id", clock("updated_at"))


@query
def missing_variants(spark, sf_dir):
    pages = line_pages(lines_table(spark, sf_dir))
    old = merge.latest_variants(pages.where(in_first_run()))
    run = pages.where(~in_first_run())
    touched = run.select("source_url").distinct()
    return merge.missing_variants(old, merge.latest_variants(run), touched).select(
        "source_url", "source_key"
    )


def runs_of(numbers: DataFrame, at: Column, category: Column, complete: Column) -> DataFrame:
    """A table of runs, one for each ``run_no`` of the pages."""
    return numbers.select("run_no").distinct().select(
        F.col("run_no").cast("long").alias("run_no"),
        F.concat(F.lit("run-"), "run_no").alias("run_id"),
        F.lit(SOURCE).alias("source"),
        category.alias("category"),
        at.alias("at"),
        complete.alias("complete"),
    )


def yearly_runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All ship years as complete runs, except that the last one is partial."""
    pages = line_pages(lines_table(spark, sf_dir)).withColumnRenamed("year", "run_no")
    lines = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("run_no"))
    last = lines.agg(F.max("run_no")).first()[0]
    at = F.make_timestamp("run_no", *map(F.lit, (12, 31, 0, 0, 0)))
    complete = F.col("run_no") < F.lit(last)
    return merge.replay(pages, runs_of(lines, at, F.lit(CATEGORY), complete))


def monthly_runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A run for each ship month, in two scopes by turns; every fifth one is not complete."""

    def number(date: Column) -> Column:
        return F.year(date) * 12 + F.month(date) - 1

    lines = table(spark, sf_dir, "lineitem").select(number(F.col("l_shipdate")).alias("run_no"))
    pages = line_pages(lines_table(spark, sf_dir)).drop("year")
    numbered = pages.withColumn("run_no", number(F.col("seq.l_shipdate")))
    month = F.col("run_no") % 12 + 1
    at = F.make_timestamp(F.expr("run_no div 12").cast("int"), month, *map(F.lit, (28, 0, 0, 0)))
    category = F.when(F.col("run_no") % 2 == 0, "even").otherwise("odd")
    return merge.replay(numbered, runs_of(lines, at, category, F.col("run_no") % 5 != 0))


@query
def scoped_runs(spark, sf_dir):
    products, variants = monthly_runs(spark, sf_dir)
    counts = variants.groupBy("source_url").agg(
        F.count("*").alias("variants"),
        F.count_if("available").alias("on_offer"),
        F.min("created_at").alias("oldest"),
        F.max("updated_at").alias("newest"),
    )
    return clocks(products.join(counts, "source_url")).select(
        "source_url", "category", "available", "last_seen_run_id", "first_seen_at", "last_seen_at",
        "updated_at", "variants", "on_offer", "oldest", "newest",
    )


@query
def seen_history(spark, sf_dir):
    return clocks(yearly_runs(spark, sf_dir)[0]).select(
        "source_url", "first_seen_at", "last_seen_at", "created_at", "updated_at", "last_seen_run_id"
    )


@query
def catalog_after_runs(spark, sf_dir):
    return clocks(yearly_runs(spark, sf_dir)[1])


@query
def catalog_stats(spark, sf_dir):
    return stats.catalog_stats(*yearly_runs(spark, sf_dir))


# Run ledger


@query
def run_ledger(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    outcomes = lines.select(
        F.concat(F.lit("run-"), year).alias("run_id"),
        ((year % 2 == 1) | (F.col("l_quantity") > 1)).alias("saved"),
    )
    # One run per ship year that the data have, and one that found nothing.
    years = lines.select(year.alias("y")).distinct().union(spark.range(1).select(F.lit(2100)))
    runs = years.select(
        F.concat(F.lit("run-"), "y").alias("id"),
        F.lit(SOURCE).alias("source"),
        F.lit(CATEGORY).alias("category"),
        F.lit("https://shop.example/c/").alias("catalog_url"),
        F.lit("both").alias("storage_mode"),
        F.lit("running").alias("status"),
        (F.col("y") % 3 != 0).alias("full_scan"),
        *(F.lit(0).cast("long").alias(f"products_{n}") for n in ("found", "saved", "failed")),
        F.lit(None).cast("string").alias("error_message"),
        F.make_timestamp("y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
    )
    cancelled = F.when(F.col("id") == "run-1999", "cancelled")
    error = F.when(F.col("id") == "run-1999", "stop postgresql://u:secret@db.example/x")
    closed = ledger.close_runs(
        runs, ledger.count_outcomes(outcomes), F.lit(datetime(2003, 1, 1)), cancelled, error
    )
    return closed.withColumn(
        "complete",
        ledger.complete_scan(
            F.col("full_scan"), F.col("products_found"), F.col("products_saved"), F.col("products_failed")
        ),
    ).withColumn("refused", F.size(quality.run_reasons({c: F.col(c) for c in closed.columns}))).transform(clocks)


# Streaming


@query
def stream_merge(spark, sf_dir):
    from checks.stream_query import stream_parts

    return stream_parts(spark, sf_dir, run_stamp(1995))


@query
def stream_catalog(spark, sf_dir):
    return whole_runs.stream_catalog(spark, sf_dir)


# Whole runs


@query
def catalog_run(spark, sf_dir):
    return whole_runs.catalog_run(spark, sf_dir)


@query
def catalog_run_ledger(spark, sf_dir):
    return whole_runs.catalog_run_ledger(spark, sf_dir)
