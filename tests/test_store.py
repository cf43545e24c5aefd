"""Parts of the tables, runs that break and go on, and walks that close."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerlake import session
from offerlake.operators import crawl as walks
from offerlake.operators import ledger, merge, stats
from offerlake.plans import catalog_run
from offerlake.plans.catalog_run import run_catalog
from offerlake.schemas import PRODUCTS
from offerlake.sources import files
from offerlake.sources.export import write_products
from offerlake.sources.snapshots import SnapshotStore, StaleSnapshot, marked_parts, part_marks, part_of
from offerlake.streaming.ingest import close_run, current_catalog, save_pages
from test_runs import SHOP, chain, options, shop_site, write_site

END = datetime(2024, 6, 1)


def products(spark, urls, run="r0"):
    at = datetime(2024, 1, 1)
    rows = [("s", "c", u, "n", None, "", None, None, True, {}, None, "h", run, at, at, at, at) for u in urls]
    return spark.createDataFrame(rows, PRODUCTS)


def files_of(store, table):
    """Data files of the current parts with the time they were written."""
    found = {}
    for folder in store.current().folders[table].values():
        path = f"{store.root}/{folder}"
        found |= {f"{path}/{n}": os.stat(f"{path}/{n}").st_mtime_ns for n in os.listdir(path) if n.endswith(".parquet")}
    return found


def run(site, number, store, folder, **changes):
    return run_catalog(site, options(number, **changes), store, f"{folder}/out", lambda: END).first()


# Parts and versions


def test_a_run_over_one_product_writes_its_part_only(spark, folder):
    store = SnapshotStore(spark, f"{folder}/store", parts=16)
    site = shop_site({f"p{k}": k + 1 for k in range(20)})
    # All products on one listing page.
    listed = "".join(f'<div class="products-flex-item"><a class="name" href="/p/p{k}">x</a></div>' for k in range(20))
    site[f"{SHOP}/c/"] = f'<div id="catalog-content">{listed}</div>'
    pages = write_site(spark, site, f"{folder}/site")
    assert run(pages, 1, store, folder)["products_saved"] == 20
    before = {t: files_of(store, t) for t in ("products", "variants")}
    assert len(store.current().folders["products"]) > 8
    row = run(pages, 2, store, folder, limit=1)
    assert (row["status"], row["products_found"]) == ("completed", 1)
    for table in ("products", "variants"):
        after = files_of(store, table)
        assert len(set(before[table]) - set(after)) == 1, table
        assert all(after[f] == t for f, t in before[table].items() if f in after)
    touched = store.read("products").where("last_seen_run_id = 'r2'")
    assert [r["source_url"] for r in touched.collect()] == [f"{SHOP}/p/p0"]
    assert store.read("products").count() == 20 == store.read("variants").count()


def test_marks_of_parts(spark):
    urls = [f"u{k}" for k in range(300)]
    rows = spark.createDataFrame([(u,) for u in urls] + [(None,)], "url string")
    for parts in (1, 64, 200):
        wanted = {r["p"] for r in rows.where("url is not null").select(part_of(F.col("url"), parts).alias("p")).collect()}
        marks = part_marks(F.col("url"), parts)
        found = rows.agg(*(m.alias(n) for n, m in marks.items())).first().asDict()
        assert marked_parts(found) == wanted
        nothing = rows.limit(0).agg(*(m.alias(n) for n, m in marks.items())).first().asDict()
        assert marked_parts(nothing) == set()


def test_the_second_of_two_writers_is_refused(spark, folder):
    store = SnapshotStore(spark, f"{folder}/store", parts=4)
    basis = store.current()
    store.publish(basis, products=products(spark, ["a", "b"]))
    with pytest.raises(StaleSnapshot):
        store.publish(basis, products=products(spark, ["c"]))
    assert sorted(r["source_url"] for r in store.read("products").collect()) == ["a", "b"]
    left = {n for n in os.listdir(store.root) if n.startswith("snapshot-")}
    assert left == {f.split("/")[0] for f in store.current().folders["products"].values()}

    # A writer that was overtaken builds its rows anew on what the other has left.
    overtaken = []

    def build(snapshot):
        if not overtaken:
            overtaken.append(True)
            store.publish(snapshot, products=merge.merge_products(
                store.read("products", snapshot), products(spark, ["d"]), stamp("x")))
        return {"products": merge.merge_products(store.read("products", snapshot), products(spark, ["e"]), stamp("y"))}

    store.update(build)
    assert sorted(r["source_url"] for r in store.read("products").collect()) == ["a", "b", "d", "e"]


def stamp(run_id):
    return merge.RunStamp(run_id, "s", "c", datetime(2024, 2, 1))


def test_clean_keeps_what_a_version_names(spark, folder):
    store = SnapshotStore(spark, f"{folder}/store", parts=2)
    for urls in (["a", "b", "c", "d", "e"], ["f"], ["g"]):
        store.update(lambda basis, u=urls: {"products": merge.merge_products(
            store.read("products", basis), products(spark, u), stamp("r"))})
    assert len(os.listdir(f"{store.root}/versions")) >= 3
    store.clean(datetime.now() - timedelta(days=1))
    assert len([n for n in os.listdir(f"{store.root}/versions") if n[0] != "."]) == 3
    store.clean(datetime.now() + timedelta(days=1))
    assert [n for n in os.listdir(f"{store.root}/versions") if n[0] != "."] == ["0000000003.json"]
    assert store.read("products").count() == 7
    named = {f.split("/")[0] for f in store.current().folders["products"].values()}
    assert {n for n in os.listdir(store.root) if n.startswith("snapshot-")} == named


# Runs that break


def test_a_failed_export_makes_the_run_partial(spark, folder, monkeypatch):
    store = SnapshotStore(spark, f"{folder}/store", parts=4)
    run(write_site(spark, shop_site({"a": 1, "b": 2}), f"{folder}/one"), 1, store, folder)

    def full(*_):
        raise OSError("no space for postgresql://u:secret@h/db")

    monkeypatch.setattr(catalog_run, "write_products", full)
    second = shop_site({"a": 3})
    second[f"{SHOP}/c/"] = second[f"{SHOP}/c/"].replace("?page=2", "")
    row = run(write_site(spark, second, f"{folder}/two"), 2, store, folder)
    assert (row["status"], row["products_found"], row["products_saved"], row["products_failed"]) == ("partial", 1, 0, 1)
    assert row["error_message"].endswith("postgresql://u:***@h/db") and row["finished_at"] == END
    found = {r["source_url"][-1]: (r["available"], r["price"]) for r in store.read("products").collect()}
    assert found["b"][0] and found["a"][0] and found["a"][1] == 3
    assert store.read("runs").count() == 2
    assert len(spark.read.text(f"{folder}/out").collect()) == 2


def test_an_interrupted_run_keeps_its_slices_and_goes_on(spark, folder, monkeypatch):
    """Interrupted in its second slice of three, then started again under its id."""
    store = SnapshotStore(spark, f"{folder}/store", parts=4)
    pages = write_site(spark, shop_site({n: k + 1 for k, n in enumerate("abc")}), f"{folder}/site")
    extracted, found = [], []
    real = catalog_run.extract.extract_products

    def watched(rows):
        found.append(store.read("runs").first()["products_found"])
        if len(extracted) == 1:
            raise KeyboardInterrupt
        extracted.append(True)
        return real(rows)

    monkeypatch.setattr(catalog_run.extract, "extract_products", watched)
    with pytest.raises(KeyboardInterrupt):
        run_catalog(pages, options(1, stages=3), store, f"{folder}/out", lambda: END)
    # The number of products was known before the first of them was read.
    assert found[0] == 3
    row = store.read("runs").first()
    assert (row["status"], row["products_found"], row["products_saved"], row["finished_at"]) == ("cancelled", 3, 1, END)
    assert [r["source_url"] for r in store.read("products").collect()] == [f"{SHOP}/p/a"]
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{folder}/out").collect()]
    assert [(x["seq"], x["link"]) for x in lines] == [(1, f"{SHOP}/p/a")]

    with pytest.raises(ValueError):
        run(pages, 1, store, folder, stages=3, limit=2)
    walked = []
    monkeypatch.setattr(catalog_run, "product_urls", lambda *_: walked.append(True))
    written = []
    monkeypatch.setattr(catalog_run.extract, "extract_products", lambda rows: written.append(rows) or real(rows))
    row = run(pages, 1, store, folder, stages=3)
    assert (row["status"], row["products_saved"], row["products_failed"]) == ("completed", 3, 0)
    assert not walked
    assert tuple(stats.catalog_stats(store.read("products"), store.read("variants")).first()) == (3, 3, 3)
    assert not files.exists(spark, store.run_path("r1"))


def test_slices_without_products_and_nothing_left_behind(spark, folder, monkeypatch):
    scratch = f"{folder}/scratch"
    os.makedirs(scratch)
    monkeypatch.setattr(session, "shared_dir", lambda _: scratch)
    store = SnapshotStore(spark, f"{folder}/store", parts=2)
    pages = write_site(spark, shop_site({"a": 1, "b": 2}), f"{folder}/site")
    row = run(pages, 1, store, folder, stages=5)
    assert (row["status"], row["products_saved"]) == ("completed", 2)
    row = run(pages, 2, None, folder, storage="json", stages=2)
    assert (row["status"], row["products_saved"]) == ("completed", 2)
    left = [f for _, _, names in os.walk(scratch) for f in names]
    assert left == []
    assert not os.path.exists(f"{folder}/store/open/r1")


def test_export_in_the_order_of_the_walk(spark, folder):
    rows = spark.range(3000).select(
        F.expr("(id * 7919) % 3000 + 1").alias("seq"),
        F.struct(
            F.lit("n").alias("name"), F.col("id").cast("string").alias("link"), F.lit(None).cast("decimal(38,10)").alias("price"),
            F.array().cast("array<struct<name:string,sku:string,price:decimal(38,10),currency:string,available:boolean>>").alias("variants"),
        ).alias("product"),
    ).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_products(rows, f"{folder}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(n for n in os.listdir(f"{folder}/out") if n.startswith("part-"))
    assert len(parts) > 1
    seqs = [json.loads(line)["seq"] for n in parts for line in open(f"{folder}/out/{n}")]
    assert seqs == list(range(1, 3001))


# Walks


def test_capped_walks_write_less(spark, folder, monkeypatch):
    """A catalog closes when it has its products; only open ones take part in later rounds."""
    written = {}
    real = walks.materialize

    def counted(df, label):
        table = real(df, label)
        written[label] = [*written.get(label, []), table.count()]
        return table

    monkeypatch.setattr(walks, "materialize", counted)
    rows = [(c, p, n, ls) for c in ("x", "y") for p, (n, ls) in chain(300).items()]
    rows += [("z", p, n, ls if p != "p6" else ls[1:]) for p, (n, ls) in chain(300).items()]
    frame = spark.createDataFrame(rows, "catalog string, page string, next string, links array<string>")
    frame = real(frame, "pages")
    starts = spark.createDataFrame([(c, "p0") for c in "xyz"], "catalog string, page string")
    sums = {}
    for limit in (0, 4):
        written.clear()
        got = walks.crawl(frame, starts, 0, limit).collect()
        for catalog, whole in (("x", 300), ("y", 300), ("z", 6)):
            seqs = sorted(r["seq"] for r in got if r["catalog"] == catalog)
            assert seqs == list(range(1, (min(limit, whole) if limit else whole) + 1))
        sums[limit] = len([n for ns in written.values() for n in ns]), sum(n for ns in written.values() for n in ns)
    assert sums[4][0] < sums[0][0] / 2 and sums[4][1] < sums[0][1] / 2


# Streams


def test_a_replayed_batch_is_known_by_its_number(spark, folder):
    """A batch that is there is left alone; one that broke half way is written anew."""
    site = shop_site({n: 10 + k for k, n in enumerate("abcd")})
    pages = [(k, u, t) for k, (u, t) in enumerate(site.items()) if "/p/" in u]
    store, of_run = SnapshotStore(spark, f"{folder}/store", parts=2), stamp("r1")
    store.update(lambda basis: {"products": products(spark, [f"{SHOP}/p/old", f"{SHOP}/p/a"])})

    def feed(rows):
        schema = "seq long, url string, html string"
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        save_pages(stream, store, of_run, f"{folder}/progress").awaitTermination()

    def written():
        top = store.run_path("r1")
        return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(top) for n in names}

    def saved():
        found = current_catalog(store, of_run)[0].where("last_seen_run_id = 'r1'")
        return sorted(r["source_url"][-1] for r in found.collect())

    feed(pages[:2])
    feed(pages[2:])
    before = written()
    files.remove(spark, f"{folder}/progress/commits/1")
    feed([])
    assert written() == before and saved() == ["a", "b", "c", "d"]
    files.remove(spark, store.batch_path("r1", "outcomes", 1))
    assert saved() == ["a", "b"]
    files.remove(spark, f"{folder}/progress/commits/1")
    feed([])
    assert set(written()) != set(before) and saved() == ["a", "b", "c", "d"]

    opened = ledger.open_run(
        spark, run_id="r1", source="s", category="c", catalog_url="u", storage_mode="tables",
        is_full_scan=True, started_at=of_run.at,
    )
    assert close_run(store, of_run, opened).first()["status"] == "completed"
    states = {r["source_url"].rsplit("/")[-1]: r["available"] for r in store.read("products").collect()}
    assert states == {"a": True, "b": True, "c": True, "d": True, "old": False}
