"""SQL text for JSON-LD values of unknown shape, held as VARIANT.

These expressions nest lambdas several levels deep. As SQL text each of them is parsed by
Spark in one go; built call by call, the plan would take longer than many a query.
"""

from __future__ import annotations

from collections.abc import Sequence


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def record_type(fields: Sequence[str]) -> str:
    return "struct<" + ",".join(f"`{name}`:variant" for name in fields) + ">"


def as_record(value: str, fields: Sequence[str]) -> str:
    """The named fields of an object; null when the value is no object."""
    return f"try_variant_get({value}, '$', '{record_type(fields)}')"


def as_records(value: str, fields: Sequence[str]) -> str:
    """The objects among a scalar-or-list value, in order."""
    listed = f"try_variant_get({value}, '$', 'array<{record_type(fields)}>')"
    single = f"array({as_record(value, fields)})"
    return f"filter(coalesce({listed}, {single}), item -> item IS NOT NULL)"


def as_list(value: str) -> str:
    """Null gives the empty list, a list stays, anything else is wrapped."""
    return (
        f"CASE WHEN {value} IS NULL OR is_variant_null({value}) THEN CAST(array() AS array<variant>) "
        f"ELSE coalesce(try_variant_get({value}, '$', 'array<variant>'), array({value})) END"
    )


def type_names(value: str) -> str:
    """The ``@type`` of a node, a scalar or a list, as an array of names."""
    return (
        f"coalesce(try_variant_get({value}, '$', 'array<string>'), "
        f"array(try_variant_get({value}, '$', 'string')))"
    )


def _read(value: str) -> str:
    return (
        f"named_struct('kind', schema_of_variant({value}), "
        f"'text', try_variant_get({value}, '$', 'string'))"
    )


# Booleans are capitalised, and a whole decimal keeps the ".0" it was written with.
_RENDERED = (
    "CASE WHEN read.kind = 'BOOLEAN' THEN initcap(read.text) "
    r"WHEN startswith(read.kind, 'DECIMAL') AND read.text RLIKE r'^-?\d{1,18}$' "
    "THEN concat(read.text, '.0') ELSE read.text END"
)

# The *text* "0" or "false" is a value like any other, hence the look at the kind.
_FALSY = (
    "CASE WHEN read.kind = 'STRING' THEN read.text = '' "
    "WHEN read.kind = 'BOOLEAN' THEN read.text = 'false' "
    "WHEN startswith(read.kind, 'ARRAY') THEN read.text = '[]' "
    "WHEN startswith(read.kind, 'OBJECT') THEN read.text = '{}' "
    "ELSE try_cast(read.text AS double) = 0 END"
)


# Texts that may be rendered or judged by their kind; superset, any other text is the value.
# Asking each value for its kind costs several times what reading its text does.
_BY_KIND = r"^(?:true|false|-?\d{1,18})$"
_MAYBE_FALSY = r"^(?:$|(?:true|false|\[\]|\{\})$|[-+.\d])"


def _unless_plain(value: str, special: str, body: str) -> str:
    rendered = let("read", _read(value), body)
    return let(
        "shown",
        f"try_variant_get({value}, '$', 'string')",
        f"CASE WHEN shown RLIKE r'{special}' THEN {rendered} ELSE shown END",
    )


def text_of(value: str) -> str:
    """Text of a scalar."""
    return _unless_plain(value, _BY_KIND, _RENDERED)


def truthy_text(value: str) -> str:
    """Text of a value, or null when it is null, empty, zero or false."""
    return _unless_plain(
        value, _MAYBE_FALSY, f"CASE WHEN NOT ({_FALSY}) THEN {_RENDERED} END"
    )
