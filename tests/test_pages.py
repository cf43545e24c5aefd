import html
import json

import pytest
from pyspark.sql import functions as F

from offerlake.functions.dom import read_fields
from offerlake.operators import extract, links, quality
from offerlake.schemas import BRAND_LABEL

def page(node, extra="", kind="application/ld+json"):
    text = node if isinstance(node, str) else json.dumps(node, ensure_ascii=False)
    return f'<html><body><script type="{kind}">{text}</script>{extra}</body></html>'


def products(spark, *pages):
    rows = [(i, f"https://s.example/p{i}", text) for i, text in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = extract.extract_products(frame).orderBy("page_id").collect()
    return [r["product"] for r in found]


def listing(*items, before="", after="", head=""):
    """A listing page: items inside the catalog, anything before and after it."""
    inside = "".join(f'<section><div class="x products-flex-item y">{i}</div></section>' for i in items)
    return f'<title>t</title>{head}<main>{before}<article><div ID=catalog-content>{inside}</div></article>{after}</main>'


# What a catalog holds, and the links a run follows from it.
LISTINGS = {
    "only named anchors of items": (
        listing(
            '<a class="photo" href="/1">no</a><span><a title="t" class="  name " href="/2">yes</a></span>',
            '<a class="names" href="/3">no</a><a class="name" name="anchor">no</a>',
            before='<a class="name" href="/4">no</a>',
            after='<div class="products-flex-item"><a class="name" href="/5">no</a></div>',
        ),
        ["/2"], None,
    ),
    "each address once, first place": (
        listing(*(f'<a class="name" href="{h}">x</a>' for h in ("/b", "../u/v", "/b", "?q=1&amp;r=&#50;", "../u/v"))),
        ["/b", "/shop/u/v", "/shop/list/?q=1&r=2"], None,
    ),
    "next by anchor": (listing(after='<a REL="nofollow  NEXT" href="/no"></a><a rel=next href=p2>2</a>'), [], "/shop/list/p2"),
    "next is a word of its own": (listing(after='<a rel="nextpage" href="/no">next</a> the next one'), [], None),
    "first next counts": (listing(head='<link href="/a" rel="next"><link rel="next" href="/b">'), [], "/a"),
    "nothing in comments and scripts": (
        listing('<!-- <a class="name" href="/1"> --><script>"<a class=name href=/2>"</script>', head='<!-- <link rel=next href=/3> -->'),
        [], None,
    ),
    "no page of a catalog": ('<p>the next one is <a class="name" href="/1">here</a>', [], None),
}


def test_listing_pages(spark):
    base = "https://s.example/shop/list/"
    rows = [(name, base, text) for name, (text, _, _) in LISTINGS.items()]
    frame = spark.createDataFrame(rows, "name string, url string, html string")
    for name, (_, expected, following) in LISTINGS.items():
        got = links.listing_pages(frame.where(F.col("name") == name)).first()
        host = "https://s.example"
        assert got["links"] == [host + e for e in expected], name
        assert got["next"] == (following and host + following), name


def test_character_references_in_links(spark):
    given = ["/x?a=1&#x26;b=2", "/&#1078;", "/&#X41;&#x42;", "/a&amp;amp;b", "/&eacute;&copy;&nbsp;", "/&#38;lt;", "/a&b=c", "/&#0;&#xD800;&#x110000;"]
    text = "".join(f'<a href="{h}">x</a>' for h in given)
    frame = spark.createDataFrame([(1, "https://s.example/", text)], "page_id long, url string, html string")
    got = [r["href"] for r in links.page_links(frame).orderBy("pos").collect()]
    assert got == [html.unescape(h) for h in given]


def test_product_in_several_blocks(spark):
    """The group is in the second block, its offers are lists, its types lists of types."""
    review = {"@type": "Review", "name": "not this"}
    group = {
        "@type": ["Thing", "ProductGroup"],
        "name": "\tDesk\u00a0lamp ",
        "url": " https://s.example/lamp ",
        "brand": "Lux",
        "image": {"url": "ignored"},
        "additionalProperty": [{"name": "watt", "value": 40}, {"name": "watt", "value": "60"}],
        "hasVariant": [
            {"sku": " L-1 ", "offers": [{"price": "1 019,90", "priceCurrency": "EUR"}, {"price": 5}]},
            {"name": "red", "offers": {"price": "899.00", "availability": "http://schema.org/InStock"}},
        ],
    }
    text = page([review], page([review, group], '<p itemprop="description">short</p>'))
    (found,) = products(spark, text)
    assert found["name"] == "Desk lamp"
    assert found["characteristics"] == {"watt": "60", BRAND_LABEL: "Lux"}
    assert found["available"] is True
    assert [v["name"] for v in found["variants"]] == [None, "red"]
    assert found["description"] == "short"


def test_choice_of_the_product_node(spark):
    group, single = {"@type": ["Thing", "ProductGroup"], "name": "group"}, {"@type": "Product", "name": "single"}
    nested = {"@type": "WebPage", "@graph": [{"@graph": {"@type": "Product", "name": "inner"}}, group]}
    deep = single
    for _ in range(9):
        deep = {"@graph": [[deep]]}
    cases = [
        page(single, page(group)),
        page([1, "x", None, single]),
        page(nested),
        page('{"@type":"Product","name":"tail"} x', page(single)),
        page('{"@type":"Product","name":"a"};{"@type":"Product"}'),
        page('{"@type":"Product","name":"old","name":"new"}'),
        page('{"@type":"Product","name":"n","offers":{"price":NaN}}'),
        page(deep),
        page({"@type": "product", "name": "case"}),
        page(single, kind="application/json"),
        "<!-- " + page(single) + " -->",
        '<script data-x="1" TYPE = application/ld+json >' + json.dumps(single) + "</SCRIPT >",
        "",
        page({"wrapped": single}),
    ]
    names = [p and p["name"] for p in products(spark, *cases)]
    assert names == [
        "group", "single", "group", "single", None, "new", "n", "single", None, None, None, "single", None, None,
    ]


def test_offers_and_rollup(spark):
    def variant(price=None, currency=None, stock=None, **more):
        offer = {"price": price, "priceCurrency": currency, "availability": stock}
        return {"offers": {k: v for k, v in offer.items() if v is not None}, **more}

    inst = "https://schema.org/InStock"
    cases = [
        [variant("1 234,50", None, inst + "/"), variant(900, "USD", "https://schema.org/OutOfStock"), variant(2000, "EUR", inst)],
        [variant(7, None, "instock"), variant(5, "RUB"), variant(3, "USD")],
        [variant(None, "RUB", inst)],
        [{"offers": [1, {"price": "8"}, {"price": 2}], "sku": 12}, {"sku": 0, "name": False}, {"sku": "0", "name": True}],
        [],
        [5, "text"],
    ]
    found = products(spark, *(page({"@type": "ProductGroup", "name": "g", "hasVariant": c}) for c in cases))
    rolled = [(None if p["price"] is None else float(p["price"]), p["currency"], p["available"]) for p in found]
    assert rolled == [
        (1234.5, "EUR", True), (3.0, "RUB", False), (None, None, True), (8.0, None, False), (None, None, False), (None, None, False),
    ]
    assert [(v["sku"], v["name"]) for v in found[3]["variants"]] == [("12", None), (None, None), ("0", "True")]
    (alone,) = products(spark, page({"@type": "Product", "name": "p", "sku": "s", "offers": {"price": 1, "availability": "InStock"}}))
    assert [(v["sku"], v["available"]) for v in alone["variants"]] == [("s", True)]
    (one,) = products(spark, page({"@type": "ProductGroup", "name": "g", "hasVariant": variant(4, "USD", inst)}))
    assert (one["price"], len(one["variants"])) == (4, 1)


def test_brand_image_characteristics(spark):
    table = """<div class="product-specification"><p>x</p><table><tr><td> <b>Вес</b> <i>г</i></td><td>85 <b>г</b></td></tr>
      <tr><td>alone</td></tr><tr><th>h</th><th>v</th></tr><tr><td>Вес</td><td>90</td><td>z</td></tr><tr><td> </td><td>v</td></tr></table>
      <table><tr><td>second</td><td>no</td></tr></table></div>"""
    base = {"@type": "ProductGroup", "name": "g"}
    found = products(
        spark,
        page({**base, "brand": "Plain", "image": "one.jpg"}, table),
        page({**base, "brand": {"name": ""}, "image": [0, None]}, table),
        page({**base, "brand": 0, "additionalProperty": [{"name": "a", "value": "1"}, {"name": " a ", "value": 9.0}, {"name": "b"}, 3]}, table),
        page({**base, "brand": "B", "additionalProperty": {"name": BRAND_LABEL, "value": "own"}}),
    )
    assert [p["brand"] for p in found] == ["Plain", None, None, "B"]
    assert [p["image"] for p in found] == ["one.jpg", None, None, None]
    assert [p["characteristics"] for p in found] == [
        {"Вес": "90", BRAND_LABEL: "Plain"}, {"Вес": "90"}, {"a": "9.0"}, {BRAND_LABEL: "own"},
    ]


def test_description_longest_then_first(spark):
    def texts(*parts):
        return "".join(f'<p itemprop="description">{t}</p>' for t in parts)

    base = {"@type": "Product", "name": "g", "description": " from\n json "}
    found = products(
        spark, page(base, texts("aa", " bbb ", "ccc", "")), page(base, texts(" ", "")), page(base), page({**base, "description": None})
    )
    assert [p["description"] for p in found] == ["bbb", "from json", "from json", ""]


def test_silent_and_nested_text():
    fields = read_fields(
        '<div itemprop="description">a<script>no</script><style>no</style><!-- no -->b'
        '<template><b>no</b></template>&lt;c&gt;<div itemprop="description">in</div></div> out'
    )
    assert fields["descriptions"] == ["a b <c> in", "in"]


def test_rejects_and_stored_shape(spark):
    def group(name="n", variants=(), **more):
        return page({"@type": "ProductGroup", "name": name, "hasVariant": list(variants), **more})

    def priced(price, currency="USD"):
        return {"name": "", "offers": {"price": price, "priceCurrency": currency, "availability": "InStock"}}

    pages = [
        group(variants=[priced(1234.565)]),
        group(name="  "),
        group(url="  "),
        group(variants=[priced(5), priced(-1)]),
        group(variants=[priced(10**10), priced(1)]),
        group(variants=[priced(3, "EURO")]),
        group(name="nul\x00"),
        group(variants=[priced(-0.001)]),
        "<html></html>",
        group(variants=[priced("1e30"), priced(1)]),
        group(variants=[priced(-1e30)]),
        page('{"@type":"Product","name":"n"}]'),
        page('{"@type":"Product","name":"n"}],[{"@type":"Product","name":"m"}'),
        page('{"@type":"Product","name":"n"},{"@type":"Product","name":"m"}'),
        page('{"@type":"Product","name":"n"} \n'),
        page('[{"@type":"Product","name":"n"},"x"]'),
        page('{"@type":"Product","name":"n"},"mark"],['),
    ]
    rows = [(i, f"https://s.example/{i}", text) for i, text in enumerate(pages)]
    frame = spark.createDataFrame(rows, "seq long, url string, html string")
    checked = quality.checked(extract.extract_products(frame)).persist()
    reasons = {r["seq"]: sorted(r["reasons"]) for r in checked.collect()}
    assert reasons == {
        0: [],
        1: ["blank_name"],
        2: ["blank_link"],
        3: ["price_negative", "variant_price_negative"],
        4: ["variant_price_overflow"],
        5: ["currency_length", "variant_currency_length"],
        6: ["nul_character"],
        7: [],
        8: ["no_product"],
        9: ["variant_price_overflow"],
        10: ["price_overflow", "variant_price_overflow"],
        11: ["no_product"],
        12: ["no_product"],
        13: ["no_product"],
        14: [],
        15: [],
        16: ["no_product"],
    }
    stored = {r["seq"]: r for r in quality.accepted(checked).collect()}
    assert sorted(stored) == [0, 7, 14, 15]
    assert str(stored[0]["price"]) == "1234.57"
    assert stored[0]["variants"][0]["name"] == "n"
    assert len(stored[0]["content_hash"]) == 64
    assert quality.rejects(checked).count() == sum(map(len, reasons.values()))
    checked.unpersist()


@pytest.mark.parametrize("partitions", [1, 7])
def test_links_do_not_depend_on_partitions(spark, partitions):
    text = '<a href="/a">1</a><a name="n">2</a><a href="b?x=1&amp;y=2">3</a><area href="/c">'
    rows = [(i, f"https://s.example/{i}/", text) for i in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)
    got = links.page_links(frame).orderBy("page_id", "pos").collect()
    assert [(r["page_id"], r["href"]) for r in got] == [(i, h) for i in range(20) for h in ("/a", "b?x=1&y=2")]


def test_kinds_are_read_only_where_they_matter(spark):
    """Most texts are their own value; only those that may be rendered or dropped ask for a kind."""
    from offerlake.functions import variant

    values = [
        '""', '"0"', '"false"', '"[]"', '" "', '"\\n"', '"-"', '"a\\n1"', '"Item 3"', '"12\\n"', "0", "-0", "0.0",
        "-0.0", "0e5", "12", "-7", "12.0", "12.50", "1e3", "123456789012345678", "1234567890123456789.0",
        "true", "false", "null", "[]", "{}", "[1]", '{"a":0}', "99999999999999999999999999999999999999999",
    ]
    rows = spark.createDataFrame([(v,) for v in values], "t string").selectExpr("t", "parse_json(t) AS v")
    always = {
        "text": variant.let("read", variant._read("v"), variant._RENDERED),
        "truthy": variant.let(
            "read", variant._read("v"), f"CASE WHEN NOT ({variant._FALSY}) THEN {variant._RENDERED} END"
        ),
    }
    found = rows.selectExpr(
        "t",
        f"{variant.text_of('v')} AS text",
        f"{variant.truthy_text('v')} AS truthy",
        *(f"{e} AS always_{n}" for n, e in always.items()),
    ).collect()
    for row in found:
        assert (row["text"], row["truthy"]) == (row["always_text"], row["always_truthy"]), row["t"]
    for read in (variant.text_of("v"), variant.truthy_text("v")):
        assert read.index("RLIKE") < read.index("schema_of_variant")


def test_script_bodies_are_taken_in_runs(spark):
    from offerlake.functions import markup

    assert "(.*?)" not in markup._JSON_LD
    open_tag = '<script type="application/ld+json">'
    bodies = ['{"a":"<b>x</b><"}', "{}</scriptx>{}", "<" * 50_000, 'a</Script', "{\n}"]
    pages = [f"{open_tag}{b}</SCRIPT ><p></script>" for b in bodies] + [f"{open_tag}{b}" for b in bodies]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    found = rows.select("i", markup.jsonld_blocks(F.col("html")).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in found] == [[b] for b in bodies + bodies]
