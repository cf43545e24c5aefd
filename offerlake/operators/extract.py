"""Product pages to products and variants.

Everything about a page is computed inside its row, on arrays: from raw html to the
finished product there is no shuffle, however many variants a page lists. Rows are only
exploded where a table of variants is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.functions import scalars
from offerlake.functions.dom import dom_fields, nodes_of_blocks
from offerlake.functions.markup import jsonld_blocks
from offerlake.functions.rows import explode_items
from offerlake.functions.variant import (
    as_list,
    as_record,
    as_records,
    let,
    text_of,
    truthy_text,
    type_names,
)
from offerlake.schemas import BRAND_LABEL, GROUP_TYPE, SINGLE_TYPE, VARIANT

# Containers inside containers that are searched with expressions. Pages nested deeper
# are flattened by a Python function instead, so depth is no limit on the result.
NESTING = 4

# Marks of a description: the attribute with its value, or with a value that has a character
# reference and may be read as it.
_DESCRIPTION = r"""itemprop\s*=\s*["']?(?:description|[^"'>\s]*&)"""

_NODE = "struct<node:variant,type:variant,more:boolean>"
_NODE_FIELDS = (
    "name",
    "url",
    "brand",
    "image",
    "description",
    "hasVariant",
    "additionalProperty",
    "offers",
    "sku",
)
_VARIANT_FIELDS = ("name", "sku", "offers")
_OFFER_FIELDS = ("price", "priceCurrency", "availability")
_ENTRIES = "array<struct<name:string,value:string>>"


def _flatten(value: str, depth: int) -> str:
    """Objects under ``value``, each before the members of its list or ``@graph``."""
    record, member = f"record{depth}", f"member{depth}"
    graph = f"{record}.`@graph`"
    none = f"CAST(array() AS array<{_NODE}>)"
    own = (
        f"CASE WHEN {record} IS NOT NULL THEN array(named_struct("
        f"'node', {value}, 'type', {record}.`@type`, 'more', false)) ELSE {none} END"
    )
    members = (
        f"coalesce(try_variant_get({value}, '$', 'array<variant>'), "
        f"try_variant_get({graph}, '$', 'array<variant>'), "
        f"CASE WHEN {graph} IS NOT NULL THEN array({graph}) END, "
        "CAST(array() AS array<variant>))"
    )
    if depth:
        below = f"flatten(transform({members}, {member} -> {_flatten(member, depth - 1)}))"
    else:
        unread = (
            "array(named_struct('node', CAST(NULL AS variant), "
            "'type', CAST(NULL AS variant), 'more', true))"
        )
        below = f"CASE WHEN size({members}) > 0 THEN {unread} ELSE {none} END"
    return let(record, as_record(value, ("@type", "@graph")), f"concat({own}, {below})")


def with_nodes(pages: DataFrame) -> DataFrame:
    """Adds ``nodes``: all JSON-LD objects of the page in document order.

    Spark's JSON parser stops after the first value and ignores what follows. Each block is
    therefore parsed inside brackets and followed by a mark made from its own text: only a
    block that is one whole value gives a list of exactly two elements with its mark at the
    end. Other blocks, and those nested deeper than ``NESTING``, send the blocks of their page
    through the Python function, which takes nothing but whole values.
    """
    blocks = pages.withColumn("blocks", jsonld_blocks(F.col("html"))).drop("html")
    marked = "transform(blocks, b -> named_struct('text', b, 'mark', CAST(xxhash64(b) AS string)))"
    read = (
        "try_variant_get(try_parse_json(concat('[', m.text, ',\"', m.mark, '\"]')), "
        "'$', 'array<variant>')"
    )
    whole = (
        "CASE WHEN size(p) = 2 AND try_variant_get(p[1], '$', 'string') = m.mark "
        "THEN array(p[0]) END"
    )
    parsed = blocks.withColumn(
        "parsed", F.expr(f"transform({marked}, m -> {let('p', read, whole)})")
    )
    flat = parsed.withColumn(
        "nodes",
        F.expr(
            "flatten(transform(flatten(filter(parsed, p -> p IS NOT NULL)), "
            f"v -> {_flatten('v', NESTING)}))"
        ),
    )
    plain = "forall(parsed, p -> p IS NOT NULL) AND NOT exists(nodes, n -> n.more)"
    hard = flat.withColumn("plain", F.expr(plain)).withColumn(
        "hard_nodes", nodes_of_blocks(F.when(~F.col("plain"), F.col("blocks")))
    )
    reread = (
        "transform(filter(transform(hard_nodes, t -> try_parse_json(t)), n -> n IS NOT NULL), "
        "n -> named_struct('node', n, 'type', try_variant_get(n, r'$[\"@type\"]', 'variant'), 'more', false))"
    )
    return hard.withColumn(
        "nodes", F.expr(f"CASE WHEN plain THEN nodes ELSE {reread} END")
    ).drop("blocks", "parsed", "plain", "hard_nodes")


def with_product_node(pages: DataFrame) -> DataFrame:
    """Adds ``node`` and ``types``: the first product group, else the first product.

    Pages without either keep a null node; they are failures to report, not to drop.
    """
    products = (
        "filter(transform(nodes, n -> named_struct("
        f"'node', n.node, 'types', {type_names('n.type')})), "
        f"n -> arrays_overlap(n.types, array('{GROUP_TYPE}', '{SINGLE_TYPE}')))"
    )
    first_group = f"get(filter(products, n -> array_contains(n.types, '{GROUP_TYPE}')), 0)"
    return (
        with_nodes(pages)
        .withColumn("products", F.expr(products))
        .withColumn("chosen", F.expr(f"coalesce({first_group}, get(products, 0))"))
        .withColumn("node", F.expr(as_record("chosen.node", _NODE_FIELDS)))
        .withColumn("types", F.col("chosen.types"))
        .drop("nodes", "products", "chosen")
    )


def with_variants(pages: DataFrame) -> DataFrame:
    """Adds ``variants``; a single product without variants is its own variant."""
    itself = ", ".join(f"'{name}', node.{name}" for name in _VARIANT_FIELDS)
    sources = (
        "CASE WHEN size(listed) = 0 AND node IS NOT NULL "
        f"AND array_contains(types, '{SINGLE_TYPE}') THEN array(named_struct({itself})) "
        "ELSE listed END"
    )
    offer = let(
        "offer",
        f"get({as_records('v.offers', _OFFER_FIELDS)}, 0)",
        "named_struct("
        f"'name', {truthy_text('v.name')}, "
        f"'sku', {truthy_text('v.sku')}, "
        f"'price', {text_of('offer.price')}, "
        f"'currency', {truthy_text('offer.priceCurrency')}, "
        "'available', endswith(rtrim('/', "
        f"coalesce({text_of('offer.availability')}, '')), 'InStock'))",
    )
    read = (
        with_product_node(pages)
        .withColumn("listed", F.expr(as_records("node.hasVariant", _VARIANT_FIELDS)))
        .withColumn("listed", F.expr(sources))
        .withColumn("offers", F.expr(f"transform(listed, v -> {offer})"))
    )
    priced = F.transform(
        "offers", lambda v: v.withField("price", scalars.parse_price(v["price"]))
    )
    return read.withColumn("variants", priced.cast(T.ArrayType(VARIANT))).drop("listed", "offers")


def rollup(variants: str = "variants") -> Column:
    """Price, currency and availability of a product from its variants, as one struct.

    The price is the lowest of the available variants, or of all when none of those is
    priced. The currency is the first one named within the same set, not the one of the
    cheapest variant.
    """
    priced = f"filter({variants}, v -> v.price IS NOT NULL)"
    in_stock = f"filter({variants}, v -> v.price IS NOT NULL AND v.available)"
    chosen = f"CASE WHEN exists({variants}, v -> v.price IS NOT NULL AND v.available) THEN {in_stock} ELSE {priced} END"
    return F.expr(
        let(
            "chosen",
            chosen,
            "named_struct('price', array_min(chosen.price), "
            "'currency', get(filter(chosen.currency, c -> c IS NOT NULL), 0), "
            f"'available', exists({variants}, v -> v.available))",
        )
    )


def brand(node: str = "node") -> Column:
    """Name of a brand object, or the brand itself."""
    named = as_record(f"{node}.brand", ("name",))
    return F.expr(
        f"CASE WHEN {named} IS NOT NULL THEN {truthy_text(named + '.name')} "
        f"ELSE {truthy_text(node + '.brand')} END"
    )


def image(node: str = "node") -> Column:
    images = f"transform({as_list(node + '.image')}, i -> {truthy_text('i')})"
    return F.expr(f"get(filter({images}, i -> i IS NOT NULL), 0)")


def longest_first(texts: str) -> Column:
    """The longest non-empty text of an array, the first one on ties."""
    ranked = (
        f"transform({texts}, (t, pos) -> named_struct('rank', -length(t), 'pos', pos, 'text', t))"
    )
    return F.expr(f"array_min(filter({ranked}, r -> r.rank < 0)).text")


def last_wins(entries: str) -> Column:
    """Map of name-value entries without blank ones; of repeated names the last value stays."""
    numbered = (
        f"array_sort(transform(filter({entries}, e -> e.name <> '' AND e.value <> ''), "
        "(e, pos) -> named_struct('name', e.name, 'pos', pos, 'value', e.value)))"
    )
    last = "filter(sorted, (e, i) -> NOT coalesce(get(sorted, i + 1).name = e.name, false))"
    pairs = f"transform({last}, e -> named_struct('name', e.name, 'value', e.value))"
    return F.expr(let("sorted", numbered, f"map_from_entries({pairs})"))


def _property_entries(node: str = "node") -> Column:
    """Entries of ``additionalProperty``, texts normalised."""
    raw = F.expr(
        f"transform({as_records(node + '.additionalProperty', ('name', 'value'))}, "
        f"p -> named_struct('name', {text_of('p.name')}, 'value', {text_of('p.value')}))"
    )
    return F.transform(
        raw,
        lambda p: F.struct(
            *(
                scalars.normalize_text(F.coalesce(p[n], F.lit(""))).alias(n)
                for n in ("name", "value")
            )
        ),
    )


def extract_products(pages: DataFrame) -> DataFrame:
    """Products of the pages: ``pages`` without html, plus ``found`` and ``product``.

    ``product`` has the schema :data:`offerlake.schemas.PRODUCT`. Characteristics come from
    the JSON-LD, or from the specification table when there are none; the brand is added
    under its label where that is missing. The description is the longest one in the page
    text, or that of the JSON-LD.

    Write the result or cache it before filtering on it: Spark moves a filter below the
    projections it depends on and would evaluate them twice.
    """
    kept = [name for name in pages.columns if name != "html"]
    dom = dom_fields(F.col("html"), _DESCRIPTION, "product-specification")
    fields = with_variants(pages.withColumn("dom", dom)).select(
        *kept,
        "node",
        "variants",
        rollup().alias("offer"),
        brand().alias("brand"),
        _property_entries().alias("properties"),
        F.expr(f"coalesce(dom.specification, CAST(array() AS {_ENTRIES}))").alias("table_rows"),
        longest_first("dom.descriptions").alias("page_text"),
        F.expr(f"coalesce({text_of('node.description')}, '')").alias("own_text"),
        F.expr(f"coalesce({text_of('node.name')}, '')").alias("raw_name"),
        F.expr(f"coalesce({truthy_text('node.url')}, url)").alias("link"),
        image().alias("image"),
    )
    mapped = fields.withColumn("from_node", last_wins("properties")).withColumn(
        "characteristics",
        F.when(F.size("from_node") > 0, F.col("from_node")).otherwise(last_wins("table_rows")),
    )
    labelled = F.expr(
        f"CASE WHEN brand IS NOT NULL AND NOT map_contains_key(characteristics, '{BRAND_LABEL}') "
        f"THEN map_concat(map('{BRAND_LABEL}', brand), characteristics) ELSE characteristics END"
    )
    product = F.struct(
        scalars.normalize_text(F.col("raw_name")).alias("name"),
        "link",
        "offer.price",
        "offer.currency",
        "offer.available",
        "brand",
        F.coalesce("page_text", scalars.normalize_text(F.col("own_text"))).alias("description"),
        labelled.alias("characteristics"),
        "variants",
        "image",
    )
    found = F.col("node").isNotNull()
    return mapped.select(*kept, found.alias("found"), F.when(found, product).alias("product"))


def variant_rows(products: DataFrame) -> DataFrame:
    """One row per variant, with its position on the page."""
    kept = [name for name in products.columns if name not in ("product", "found")]
    of_product = (F.col("product.link").alias("link"), F.col("product.name").alias("product_name"))
    rows = explode_items(products, "product.variants", "variant", *kept, *of_product)
    return rows.select(*kept, "link", "product_name", "pos", "variant.*")
