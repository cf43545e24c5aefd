"""Resolution of link targets against the address of their page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generic URI syntax: scheme, authority with its slashes, path, query, fragment.
_URI = (
    r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
_RELATIVE_SCHEMES = ("http", "https", "ftp", "file")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "(?s)" + _URI, group)


def url_parts(url: Column) -> Column:
    """Scheme, authority, path, query of an address; kept once per page."""
    return F.struct(
        url.alias("url"),
        F.lower(_part(url, 1)).alias("scheme"),
        _part(url, 2).alias("authority"),
        _part(url, 3).alias("path"),
        _part(url, 4).alias("query"),
    )


def _prefixed(mark: str, text: Column) -> Column:
    return F.when(text == "", "").otherwise(F.concat(F.lit(mark), text))


def _without_dots(path: Column) -> Column:
    """Apply ``.`` and ``..`` segments."""
    segments = F.split(path, "/")

    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return (
            F.when(segment == "..", up)
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    closing = F.element_at(segments, -1).isin(".", "..")
    full = F.when(closing, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.array_join(full, "/")
    resolved = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), resolved).otherwise(path)


def resolve(base: Column, target: Column) -> Column:
    """Absolute form of ``target``; ``base`` comes from :func:`url_parts`."""
    # Browsers and URL libraries drop line breaks, tabs and leading control characters.
    link = F.regexp_replace(target, r"[\t\r\n]|^[\x00-\x20]+", "")
    scheme, authority, path, query = (_part(link, i) for i in range(1, 5))
    fragment = _prefixed("#", _part(link, 5))
    scheme = F.lower(scheme)
    prefix = F.concat(base["scheme"], F.lit(":"))

    folder = F.regexp_replace(base["path"], "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    below = F.regexp_replace(F.concat(folder, path), "//+", "/")
    full_path = _without_dots(F.when(path.startswith("/"), path).otherwise(below))

    same_page = F.concat(
        prefix,
        base["authority"],
        base["path"],
        _prefixed("?", F.when(query == "", base["query"]).otherwise(query)),
        fragment,
    )
    foreign = (scheme != "") & (
        (scheme != base["scheme"]) | ~scheme.isin(*_RELATIVE_SCHEMES)
    )
    return (
        F.when(target == "", base["url"])
        .when(base["url"] == "", target)
        .when(foreign, target)
        .when(
            authority != "",
            F.concat(prefix, authority, path, _prefixed("?", query), fragment),
        )
        .when(path == "", same_page)
        .otherwise(
            F.concat(
                prefix, base["authority"], full_path, _prefixed("?", query), fragment
            )
        )
    )
