"""Scalar functions on columns: text, prices, keys, fingerprints, redaction."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.schemas import EXTRACTED_PRICE, TOO_LARGE

# Unicode white space plus the four separators U+001C to U+001F.
_SPACE = r"[\s\x1c-\x1f]"

# A number in figures, and one whose figures before the exponent are all zero.
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_ZERO = r"^[+-]?[0.]+(?:[eE][+-]?[0-9]+)?$"
# A number that is read as it is and always fits.
_PLAIN_NUMBER = r"^[0-9]{1,20}(?:\.[0-9]{1,10})?\z"

# What counts as a secret in a message.
_URL_PASSWORD = r"(?iU)(postgres(?:ql)?://[^:/?#\s]+:)[^@/\s]+@"
_PASSWORD_SETTING = r"(?iU)(password\s*=\s*)\S+"


def normalize_text(text: Column) -> Column:
    """Collapse every run of white space to one blank and trim the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def strip(text: Column) -> Column:
    """Trim white space of any kind, where ``trim`` only knows the blank."""
    return F.regexp_replace(
        text, rf"(?U)\A{_SPACE}+|(?<!{_SPACE}){_SPACE}+\z", ""
    )


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def parse_price(text: Column) -> Column:
    """Price text to a decimal; null when it is no number.

    Blanks inside are dropped and the comma is the decimal point. NaN and infinities have
    no decimal, so they are null too. A number with more digits than the type has is kept as
    the largest one of its sign: it must not pass for a missing price, and it is larger than
    any table takes.
    """
    compact = strip(F.replace(text, F.lit(" "), F.lit("")))
    pointed = F.replace(compact, F.lit(","), F.lit("."))
    digits = F.regexp_replace(pointed, r"(?<=\d)_(?=\d)", "")
    beyond = (
        F.when(digits.rlike(_ZERO), F.lit(Decimal(0)).cast(EXTRACTED_PRICE))
        .when(F.startswith(digits, F.lit("-")), F.lit(TOO_LARGE.copy_negate()))
        .otherwise(F.lit(TOO_LARGE))
    )
    cleaned = F.coalesce(digits.try_cast(EXTRACTED_PRICE), F.when(digits.rlike(_NUMBER), beyond))
    return F.when(text.rlike(_PLAIN_NUMBER), text.try_cast(EXTRACTED_PRICE)).otherwise(cleaned)


def price_text(price: Column) -> Column:
    """A price as JSON writes it: no exponent, no trailing zeros, no lone point."""
    plain = F.regexp_replace(price.cast(EXTRACTED_PRICE).cast("string"), r"\.?0+$", "")
    return F.when(price == 0, "0").otherwise(plain)


def _lower_hex_escapes(json: Column) -> Column:
    # Jackson writes the hex digits of control characters in upper case; the stored
    # fingerprints use lower case. Only an odd number of backslashes starts an escape.
    fixed = json
    for digit in "ABCDEF":
        fixed = F.regexp_replace(
            fixed, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}"
        )
    return F.when(json.rlike(r"\\u00[01][A-F]"), fixed).otherwise(json)


def sorted_map(entries: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(entries)))


def content_hash(
    name: Column,
    brand: Column,
    description: Column,
    price: Column,
    currency: Column,
    characteristics: Column,
) -> Column:
    """SHA-256 of the compact JSON, keys in order, of the fields that describe a product."""
    empty = F.create_map().cast("map<string,string>")
    head = F.to_json(
        F.struct(
            brand.alias("brand"),
            sorted_map(F.coalesce(characteristics, empty)).alias("characteristics"),
            currency.alias("currency"),
            description.alias("description"),
            name.alias("name"),
        ),
        {"ignoreNullFields": "false"},
    )
    # "price" is the last key in order. It is appended as text because a decimal or a
    # double rendered by Spark carries trailing zeros or an exponent.
    body = F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1),
        F.lit(',"price":'),
        F.coalesce(price_text(price), F.lit("null")),
        F.lit("}"),
    )
    return F.sha2(_lower_hex_escapes(body), 256)


def variant_source_key(sku: Column, name: Column) -> Column:
    """Key of a variant within its product: the SKU, or a digest of the name."""
    sku_text = non_empty(strip(sku))
    name_text = strip(F.coalesce(name, F.lit("")))
    return F.coalesce(
        F.concat(F.lit("sku:"), sku_text),
        F.concat(F.lit("name:"), F.sha2(name_text, 256)),
    )


def variant_name(name: Column, product_name: Column) -> Column:
    return F.coalesce(non_empty(name), product_name)


def redact_secrets(message: Column) -> Column:
    """Mask passwords in database addresses and in ``password=`` settings."""
    masked = F.regexp_replace(message, _URL_PASSWORD, "$1***@")
    return F.regexp_replace(masked, _PASSWORD_SETTING, "$1***")
