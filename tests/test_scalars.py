import hashlib
from decimal import Decimal
from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from offerlake.functions import scalars
from offerlake.functions.urls import resolve, url_parts


def column(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, v {kind}").select("i", expression(F.col("v")).alias("r"))
    return [r["r"] for r in frame.orderBy("i").collect()]


def test_normalize_matches_split_and_join(spark):
    texts = ["  a \t b\n", "a\u00a0b\u2003c\x1cd\x85e", "zero\u200bwidth", "", "\u00a0", "x"]
    assert column(spark, texts, scalars.normalize_text) == [" ".join(t.split()) for t in texts]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \t\n\x0b\x1c\x1f\x85\u00a0\u2003\u3000\u200baéЖ", max_size=12), min_size=1, max_size=40))
def test_text_functions_match_python(spark, texts):
    assert column(spark, texts, scalars.normalize_text) == [" ".join(t.split()) for t in texts]
    assert column(spark, texts, scalars.strip) == [t.strip() for t in texts]


LARGEST = "9" * 28 + "." + "9" * 10


def test_parse_price(spark):
    cases = {
        "1 234,50": "1234.5", "1,234.50": None, "": None, "0": "0", "-3": "-3", "abc": None,
        "nan": None, "inf": None, "1e3": "1000", "+5": "5", ".5": "0.5", "5.": "5", "1234d": None,
        "12\u00a0": "12", "1\u00a0234": None, "1_000": "1000", "_1": None, "99.990": "99.99",
        "1e30": LARGEST, "-1e30": f"-{LARGEST}", "9" * 40: LARGEST, "1e400": LARGEST, "0e99": "0", "1e-40": "0",
        "1e": None, "e5": None, ".": None, "9" * 28: "9" * 28,
    }
    got = column(spark, list(cases), scalars.parse_price)
    assert got == [None if v is None else Decimal(v) for v in cases.values()]
    assert column(spark, [None], scalars.parse_price) == [None]


# What is fingerprinted, written by hand, and its SHA-256 as a checksum tool gives it.
FINGERPRINTS = [
    (
        (None, None, None, None, None, None),
        '{"brand":null,"characteristics":{},"currency":null,"description":null,"name":null,"price":null}',
    ),
    (
        ("Lamp", "Lux", "", "19.9000000000", "EUR", {"watt": "40"}),
        '{"brand":"Lux","characteristics":{"watt":"40"},"currency":"EUR","description":"","name":"Lamp","price":19.9}',
    ),
    (
        ("Щётка \"XL\"", None, "a\\b\n\u001f", "0", None, {"я": "2", "b": "1", "B": ""}),
        '{"brand":null,"characteristics":{"B":"","b":"1","я":"2"},"currency":null,'
        '"description":"a\\\\b\\n\\u001f","name":"Щётка \\"XL\\"","price":0}',
    ),
    (
        ("1000", "\u007f/", None, "1000.0000000000", "USD", {}),
        '{"brand":"\u007f/","characteristics":{},"currency":"USD","description":null,"name":"1000","price":1000}',
    ),
]


@pytest.mark.parametrize("row,text", FINGERPRINTS)
def test_content_hash_is_of_this_text(spark, row, text):
    schema = "name string, brand string, description string, price decimal(38,10), currency string, characteristics map<string,string>"
    price = None if row[3] is None else Decimal(row[3])
    frame = spark.createDataFrame([(*row[:3], price, *row[4:])], schema)
    digest = frame.select(scalars.content_hash(*map(F.col, frame.columns))).first()[0]
    assert digest == hashlib.sha256(text.encode()).hexdigest()


def test_content_hash_does_not_depend_on_map_order(spark):
    digest = "sha2(concat_ws(',', transform(map_keys(m), k -> k)), 256)"
    maps = ["map('x', '1', 'a', '2')", "map('a', '2', 'x', '1')"]
    nothing = [F.lit(None).cast("string")] * 3
    rows = [
        spark.range(1).select(F.expr(m).alias("m")).select(
            scalars.content_hash(*nothing, F.lit(None).cast("decimal(38,10)"), F.lit(None).cast("string"), F.col("m")),
            F.expr(digest),
        ).first()
        for m in maps
    ]
    assert rows[0][0] == rows[1][0] and rows[0][1] != rows[1][1]


# Keys of variants: a number where there is one, else the SHA-256 of the name.
VARIANT_KEYS = {
    (" 0 ", "any"): "sku:0",
    ("A\tB", ""): "sku:A\tB",
    ("", "Blue  one"): "name:2be0a9541b1fa666",
    (None, None): "name:e3b0c44298fc1c14",
}


def test_variant_keys(spark):
    for (sku, name), start in VARIANT_KEYS.items():
        frame = spark.createDataFrame([(sku, name)], "sku string, name string")
        key = frame.select(scalars.variant_source_key(F.col("sku"), F.col("name"))).first()[0]
        assert key.startswith(start), (sku, name, key)


def test_variant_name_falls_back_to_product(spark):
    got = column(spark, ["a", "", None], lambda c: scalars.variant_name(c, F.lit("P")))
    assert got == ["a", "P", "P"]


def test_redaction(spark):
    got = column(
        spark,
        ["postgresql://u:p%20w@h:5/db", "POSTGRES://u:x@h", "host=h PASSWORD = secret;x next", "nothing"],
        scalars.redact_secrets,
    )
    assert got == ["postgresql://u:***@h:5/db", "POSTGRES://u:***@h", "host=h PASSWORD = *** next", "nothing"]


TARGETS = [
    "/x", "y.html", "?P=2", "#t", "//o/z", "https://other.example/a?b#c", "mailto:a@b", "../u", "", "./a/../b",
    "../../../up", "a//b/./c", "/a//b", ".", "..", "a/..", "/a/./b/../c?d=1#e", "javascript:void(0)", "?", "x y",
    "HTTPS://h.example/Q", "tel:1", "a?x=/../y", "/..", "é/ж", "a;b", " /lead", "/ta\tb",
]


@pytest.mark.parametrize(
    "base", ["https://h.example/c/b/?q=1#f", "https://h.example/c/b", "https://h.example", "http://h.example/?a"]
)
def test_resolve_matches_urljoin(spark, base):
    got = column(spark, TARGETS, lambda c: resolve(url_parts(F.lit(base)), c))
    assert got == [urljoin(base, t) for t in TARGETS]
